"""Readers: CSV with encoding fallback, registered datasets, the JSON Lines event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyframe.functions.columns import normalise_missing

ENCODINGS = ("utf-8", "gb18030", "ISO-8859-1")  # tried in this order; the byte-order mark is part of utf-8

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_name", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("project_id", T.StringType()), T.StructField("dataset_type", T.StringType()),
    T.StructField("page", T.StringType()), T.StructField("success", T.BooleanType()),
    T.StructField("error_type", T.StringType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("properties", T.StringType()),
])


def fits_encoding(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether every line of the files decodes; tested on the executors, only a yes or no comes back."""
    lines = spark.read.text(path)  # the text source keeps the bytes as they are
    if encoding == "utf-8":
        return lines.filter(~F.is_valid_utf8("value")).limit(1).count() == 0
    if encoding != "gb18030":
        return True
    lenient = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    before = {k: spark.conf.get(k) for k in lenient}
    for k, v in lenient.items():
        spark.conf.set(k, v)
    try:  # bytes that do not fit decode to the replacement character
        text = F.decode(F.col("value").cast("binary"), "gb18030")
        return lines.filter(text.contains("\ufffd")).limit(1).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             encodings=ENCODINGS, **options: str) -> DataFrame:
    """CSV with a header; the first encoding that fits the bytes is used. Give a schema to avoid the inference scan."""
    for encoding in encodings:
        if not fits_encoding(spark, path, encoding):
            continue
        if encoding == "gb18030" and spark.conf.get("spark.sql.legacy.javaCharsets") != "true":
            raise ValueError("reading gb18030 needs spark.sql.legacy.javaCharsets, which build_session sets")
        reader = spark.read.options(header=True, encoding=encoding, **options)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return normalise_missing(reader.csv(path))
    raise ValueError(f"none of the encodings {', '.join(encodings)} fits {path}")


def read_dataset(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """One registered dataset."""
    if kind == "csv":
        return read_csv(spark, path, **options)
    return normalise_missing(spark.read.options(**options).format(kind).load(path))


def read_events(spark: SparkSession, path: str, last: int | None = None, order: str = "timestamp") -> DataFrame:
    """Event log; malformed lines are dropped. ``last``: only the latest events."""
    events = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    events = events.filter(F.col("event_name").isNotNull() | F.col("timestamp").isNotNull())
    return events if last is None else events.orderBy(F.desc(order)).limit(max(int(last), 0))


