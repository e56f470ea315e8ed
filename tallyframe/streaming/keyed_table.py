"""The latest row of each key of a table that a stream changes, kept as Parquet in a fixed number of folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

KEEP = 8
EPOCH = "_epoch"


class KeyedTable:
    """Rows merged by key, the last epoch wins.

    A batch writes only its changed rows, into a folder numbered by its epoch modulo 2 * keep, so a batch repeated after a failure
    replaces its own rows. Every ``keep`` epochs the latest rows go to one of two snapshot folders, in turn. What a folder held
    before is older than a snapshot that stays, so old epochs go as new ones come, and nothing is deleted by name. A
    reader gets the same rows while up to ``keep`` further batches are written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], keep: int = KEEP):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys, keep
        columns = T.StructType.fromDDL(schema)
        self.values = [f.name for f in columns if f.name not in keys]
        self.names = columns.fieldNames()
        self.schema = T.StructType([*columns.fields, T.StructField(EPOCH, T.LongType())])

    def _rows(self, *folders: str) -> DataFrame:
        found = self.spark.createDataFrame([], self.schema)
        for folder in folders:
            try:
                found = found.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select(*self.names, EPOCH))
            except AnalysisException as e:  # not written yet
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return found

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.values, EPOCH), EPOCH).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*").select(*self.names, EPOCH)

    def read(self, before: int | None = None) -> DataFrame:
        """The rows as they are, or as they were before an epoch of the last ``keep``."""
        rows = self._rows("changes", "snapshot")
        return self._latest(rows if before is None else rows.filter(F.col(EPOCH) < before)).drop(EPOCH)

    def merge(self, rows: DataFrame, epoch: int) -> None:
        """Rows of a batch, one per key, become the latest of their keys."""
        changed = rows.select(*self.names, F.lit(epoch).cast("long").alias(EPOCH))
        changed.write.mode("overwrite").parquet(f"{self.path}/changes/slot={epoch % (2 * self.keep)}")
        if (epoch + 1) % self.keep == 0:
            turn = epoch // self.keep % 2
            all_rows = self._rows("changes", f"snapshot/slot={1 - turn}")
            self._latest(all_rows).write.mode("overwrite").parquet(f"{self.path}/snapshot/slot={turn}")
