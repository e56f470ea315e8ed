"""Words, hashes and small helpers shared by the operators of this subpackage.

A word is a maximal run of bytes other than space and 0x09-0x0D, as bytes.split() finds them. Words are compared by a
64-bit hash of their bytes; no position, batch or process enters it, so it means the same in every task.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C13 | 3)  # 3 modulo 8: differences of its powers keep nearly all bits
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
SLICE_BYTES = 1 << 19  # texts are worked on in slices of about this size, whatever an Arrow batch holds


def ready(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one the cluster names, or a private one for a session in a single process."""
    context = spark.sparkContext
    small_batches(spark)
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyframe-llm-"))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch: both the executor and the worker hold a batch, for every task."""
    now = spark.conf.get(BATCH_SETTING, None)
    if now is not None and now.removesuffix("b").lstrip("-").isdigit() and not 0 < int(now.removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Hands memory that Arrow and the allocator keep for later back to the system; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    system = ctypes.CDLL(None)
    if hasattr(system, "malloc_trim"):
        system.malloc_trim(0)


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, safe against lost executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def process_store() -> dict:
    """A dict that lives as long as the Python process: what one task has learned serves the next ones in the same worker."""
    return sys.modules.setdefault("tallyframe_process_store", types.ModuleType("tallyframe_process_store")).__dict__


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = U64(1)
    return np.cumprod(out, dtype=U64)[:n]


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each span, independent of where the span lies."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * powers(BASE, n), out=sums[1:], dtype=U64)
    inverse = powers(BASE_INVERSE, n + 1)
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U64))


@dataclass
class Words:
    """The words of some texts: raw[starts[i]:ends[i]] is word i."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray  # of each word
    bounds: np.ndarray  # of each text: its words are bounds[i]:bounds[i + 1]

    def text(self, first: int, last: int) -> bytes:
        """Words first:last joined by one blank."""
        return b" ".join(self.raw[self.starts[first]:self.ends[last - 1]].split()) if last > first else b""


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """raw must go on for 8 bytes after the last word."""
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    size = ends - starts
    h = mix((eight[starts] & LOW_BYTES[np.minimum(size, 8)]) * BASE + size.astype(U64))
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        part = eight[starts[more] + done] & LOW_BYTES[np.minimum(size[more] - done, 8)]
        h[more] = mix(h[more] * BASE + part)
        done += 8
        more = more[size[more] > done]
    return h


def split_words(texts: list[bytes | None]) -> Words:
    raw = b"".join((b" ", b" ".join(t or b"" for t in texts), b" ", bytes(8)))
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    blank = BLANK[np.frombuffer(raw, dtype=np.uint8)[:-8]]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(sizes) + 1)))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(raw, starts, ends, word_hashes(raw, starts, ends), doc, bounds)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows with their texts as bytes, in slices of about `size` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
        part = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, column.slice(a, b - a).cast(pa.large_binary()).to_pylist()
    give_back()
