"""Deterministic WARC archives: range-sorted shards, files rolled by compressed size, temporary names and a manifest."""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.text import pinned, ready
from tallyframe.operators.ranking import with_global_order

SHARD_BYTES = 16 << 20  # of payload; more where that would give over MOST_SHARDS shards
MOST_SHARDS = 65_536
ROLL_BYTES = 256 << 20  # compressed; the record that passes it is the last of its file
LEAST_REVISIT = 100  # payloads below this are always written in full
ORDER_RANGES = 4096  # ranges of the global order at most
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ["page_id", "url", "digest"]
MANIFEST = "file string, shard int, records long, bytes long, payload_bytes long, sha256 string"
READ_BYTES = 1 << 20
OUT_BYTES = 16 << 20  # payloads handed on at once by the reader


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Of the folder, as any task can open it."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri.split("/")[0] else os.path.abspath(uri))


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((page_id, url, digest, copy)).encode()).digest()[:16], version=5)}>"


def target(url: str | None) -> str:
    """The address without characters that a header cannot hold."""
    return re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url or "urn:unknown")


def head(lines: list[tuple[str, object]]) -> bytes:
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n"


def record(row: dict, copy: int, kind: str, payload: bytes | None, date: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head only, with the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    known = copy == 0 or kind == "response"
    first = row["refers"] if known else {"page_id": row["page_id"], "url": row["url"]}
    refers = first if kind == "revisit" else None
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"], row["url"], row["digest"], copy)), ("WARC-Date", date),
        ("WARC-Target-URI", target(row["url"])), ("X-Page-ID", row["page_id"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", PROFILE if refers else None),
        ("WARC-Refers-To", record_id(refers["page_id"], refers["url"], row["digest"], 0) if refers else None),
        ("X-Refers-To-Page-ID", refers["page_id"] if refers else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return member(head(lines) + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)  # zlib writes no time into the head: equal data, equal bytes
    return press.compress(data) + press.flush()


class ShardFiles:
    """The files of one shard. Each is written under a name of its own attempt and then renamed, so an attempt that dies leaves no
    file under a final name, and a repeated one replaces it by equal bytes."""

    def __init__(self, folder: str, shard: int, roll: int, date: str):
        self.fs, self.path = file_system(folder)
        self.shard, self.roll, self.date, self.done, self.out = shard, roll, date, [], None

    def write(self, data: bytes, payload_bytes: int) -> None:
        if self.out is not None and self.size >= self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.done):04d}.warc.gz"
            self.temporary = f"{self.path}/temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/temporary", recursive=True)
            self.out, self.sum, self.size, self.records, self.payload = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0, 0
            info = b"software: tallyframe\r\nformat: WARC File Format 1.1\r\n"
            self.put(member(head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "", 0)), ("WARC-Date", self.date),
                                  ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"))
        self.put(data)
        self.records += 1
        self.payload += payload_bytes

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.path}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # a file system that does not rename onto a file: an earlier attempt left the same bytes
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        self.done.append((self.name, self.shard, self.records, self.size, self.payload, self.sum.hexdigest()))
        self.out = None


def with_shard(starts: list[tuple]):
    """Adds the shard that a key falls in, from the smallest key of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in KEY))
            shard = [max(0, bisect.bisect_right(starts, sortable(*key)) - 1) for key in keys]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))
    return run


def sortable(page_id: int | None, url: str | None, digest: str) -> tuple:
    """A key whose order is Spark's: nulls first, text by its bytes."""
    return (page_id is not None, page_id or 0, url is not None, (url or "").encode(), digest)


def archive(folder: str, roll: int, least: int, date: str):
    """Writes the records of sorted rows: each key's decision (kind 0) comes before its payloads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, row = None, None
        for batch in batches:
            done = []
            small = batch.drop_columns(["payload"]).to_pylist()
            payloads = batch.column("payload")
            for i, new in enumerate(small):
                if new["kind"] == 0:
                    row = new
                    continue
                if row is None:
                    continue  # a further copy: its records have been written
                if files is None or files.shard != row["shard"]:
                    if files is not None:
                        files.close()
                        done += files.done
                    files = ShardFiles(folder, row["shard"], roll, date)
                payload = payloads[i].as_buffer().to_pybytes()
                for copy in range(row["copies"]):
                    kind = "response" if row["bytes"] < least or copy == 0 and row["refers"] is None else "revisit"
                    files.write(record(row, copy, kind, payload, date), row["bytes"])
                row = None
            yield manifest_rows(done)
        if files is not None:
            files.close()
            yield manifest_rows(files.done)
    return run


def manifest_rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)],
                                      ["file", "shard", "records", "bytes", "payload_bytes", "sha256"])


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
               least_revisit: int = LEAST_REVISIT, date: str = DATE) -> DataFrame:
    """Writes a WARC 1.1 record per row of pages (page_id, url, html) into folder; returns the manifest, also kept there.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least least_revisit bytes, that with the
    smallest page_id is a response and the others revisit it; smaller payloads are all responses. The records lie in the
    order of page_id, url and payload digest (nulls first), cut into shards of about shard_bytes of payload by exact running sums;
    a shard's files are rolled once roll_bytes compressed bytes are reached. Each record is a gzip member. Ids, digests, lengths and
    HTTP heads are made anew; the date is a parameter. So equal pages give equal files, byte for byte, however they are dealt to tasks.

    Files are written under temporary names and renamed when whole. manifest/ is written after all of them, and readers take
    only the files that it lists: an interrupted run leaves no archive. folder must be one that every task can write to, by a
    file system that Arrow knows, and must hold no manifest.

    Payloads are shuffled once, by shard; the decisions travel in the same shuffle, each ahead of its payload. Digests are joined in rows
    without payload. The shards' first keys (at most 65,536) are sent to the tasks.

    A null page_id counts as larger than any other for the choice of the response, and has no id in its records. A null url becomes
    urn:unknown. Rows with equal page_id, url and payload are copies: one payload, and a record each. An empty table
    gives an empty manifest. Other columns are not written.
    """
    spark = pages.sparkSession
    html = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = html.select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.col("html").cast("binary").alias("payload"))
    facts = base.select(*KEY, F.octet_length("payload").cast("long").alias("bytes"))
    each = pinned(facts.groupBy(*KEY, "bytes").agg(F.count("*").cast("int").alias("copies")))
    by_page = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url")
    several = pinned(each.filter(F.col("bytes") >= least_revisit).groupBy("digest", "bytes")
                     .agg(F.min(by_page).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    own = (F.col("page_id").eqNullSafe(F.col("first.page_id"))) & (F.col("url").eqNullSafe(F.col("first.url")))
    decided = each.join(several, ["digest", "bytes"], "left").select(
        *KEY, "bytes", "copies", F.when(F.col("first").isNotNull() & ~own, F.struct("first.page_id", "first.url")).alias("refers"))
    total = each.agg(F.count("*").alias("n"), F.sum(F.col("bytes") * F.col("copies")).alias("bytes")).first()
    a_shard = max(shard_bytes, -(-(total["bytes"] or 0) // MOST_SHARDS))
    order = [F.col(c) for c in KEY]
    placed = with_global_order(decided.withColumn("payload_sum", F.col("bytes") * F.col("copies")), order, "payload_sum",
                               max(5000, -(-total["n"] // ORDER_RANGES)))
    placed = pinned(placed.select(*KEY, "bytes", "copies", "refers",
                                  F.expr(f"cast((running - payload_sum) div {a_shard} as int)").alias("shard")))
    shards = placed.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("first")).orderBy("shard").collect()  # at most MOST_SHARDS + 1
    # shards that a large payload passes over are left out, so that their numbers are those of the list
    starts = [sortable(*s["first"]) for s in shards]
    columns = "page_id long, url string, digest string, payload binary, shard int"
    payloads = base.mapInArrow(with_shard(starts), columns).withColumns({
        "kind": F.lit(1), "bytes": F.lit(None).cast("long"), "copies": F.lit(None).cast("int"),
        "refers": F.lit(None).cast(placed.schema["refers"].dataType)})
    decisions = placed.select(*KEY, "bytes", "copies", "refers").mapInArrow(
        with_shard(starts), "page_id long, url string, digest string, bytes long, copies int, refers struct<page_id: long, url: string>, shard int")
    decisions = decisions.withColumns({"kind": F.lit(0), "payload": F.lit(None).cast("binary")})
    rows = decisions.unionByName(payloads).repartitionById(max(1, len(shards)), F.col("shard")).sortWithinPartitions("shard", *KEY, "kind")
    files = rows.mapInArrow(archive(folder, roll_bytes, least_revisit, date), MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def records(fs: arrow_fs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of a file of gzip members, one at a time."""
    with fs.open_input_stream(path, compression=None) as source:
        data, opened, text = b"", None, bytearray()
        while True:
            if not data:
                data = source.read(READ_BYTES)
                if not data:
                    break
            opened = opened or zlib.decompressobj(31)
            text += opened.decompress(data)
            data = opened.unused_data if opened.eof else b""
            if opened.eof:
                lines, _, rest = bytes(text).partition(b"\r\n\r\n")
                top = dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
                size = int(top["Content-Length"])
                if rest[size:] != b"\r\n\r\n":
                    raise ValueError(f"{path}: a record is not as long as it says")
                yield top, rest[:size]
                opened, text = None, bytearray()
        if opened is not None:
            raise ValueError(f"{path}: the last record is cut off")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_files(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        for files in batches:
            for name, want in zip(files.column("file").to_pylist(), files.column("records").to_pylist()):
                rows, size, seen = [], 0, 0
                for top, block in records(fs, f"{path}/{name}"):
                    if top["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = top["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f"sha256:{hashlib.sha256(block).hexdigest()}" != top["WARC-Block-Digest"] or top["WARC-Type"] == "response" and (
                            len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: a record does not match its digest")
                    ids = [int(top[k]) if k in top else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                    rows.append((ids[0], top["WARC-Target-URI"], length, digest, top["WARC-Type"], ids[1],
                                 payload if top["WARC-Type"] == "response" else None))
                    seen, size = seen + 1, size + (len(block) if with_payload else 300)
                    if size > OUT_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if seen != want:
                    raise ValueError(f"{name}: {seen} records, the manifest has {want}")
                yield batch(rows)
    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """READ (and payload, null for revisits): a row per record of the files that the folder's manifest lists, checked against their
    digests. One task reads whole files, record by record."""
    files = spark.read.parquet(f"{folder}/manifest")
    return files.select("file", "records").repartition(max(1, min(files.count(), 10_000))).mapInArrow(
        read_files(folder, with_payload), READ + ", payload binary" * with_payload)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared folder."""
    ready(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/warc-{os.urandom(6).hex()}"
