"""WARC round trips, byte-for-byte repeatable files, and what an interrupted run leaves."""

import gzip
import hashlib
from pathlib import Path

import pytest

from tallyframe.llm.warc import KEY, file_system, read_warc, record, records, write_warc

SCHEMA = "page_id long, url string, html string"


def pages(n=300):
    rows = [(i, f"http://a.example/{i % 7}", f"<p>{'é' * (i % 40)} page {i % 90}</p>" + "body " * (i % 60)) for i in range(n)]
    return rows + [(900, None, None), (901, "http://b.example/x y\r\nz", ""), (None, "u", "<i>no id</i>" * 20), (None, "v", "<i>no id</i>" * 20),
                   (910, "w", "<i>no id</i>" * 20), (920, "s", "same row " * 20), (920, "s", "same row " * 20), (920, "t", "same row " * 20),
                   (930, "s", "tiny"), (930, "s", "tiny"), (940, "long", "x" * 300_000)]


def plain(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out, seen = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (html or "").encode()
        revisit = len(data) >= 100 and data in seen
        seen.add(data)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first.get(data) if revisit else None))
    return sorted(out, key=str)


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


@pytest.mark.parametrize("shard, roll", [(1 << 20, 1 << 20), (4000, 600)])
def test_round_trip(spark, tmp_path, shard, roll):
    rows = pages()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS digest", "1 AS shard", "'y' AS kind", "'z' AS payload").repartition(5)
    manifest = write_warc(frame, str(tmp_path / "a"), shard, roll).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == plain(rows)
    payloads = {r.payload_digest: bytes(r.payload) for r in read_warc(spark, str(tmp_path / "a"), True).collect() if r.payload is not None}
    assert {d: hashlib.sha256(p).hexdigest() for d, p in payloads.items()} == {d: d for d in payloads}
    # the manifest tells the truth, and other files for other partitionings are equal byte for byte
    there = files(tmp_path / "a")
    assert {m.file: (m.bytes, m.sha256) for m in manifest} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in there.items()}
    assert sum(m.records for m in manifest) == len(rows)
    write_warc(frame.repartition(2, "url"), str(tmp_path / "b"), shard, roll)
    assert files(tmp_path / "b") == there
    if roll == 600:
        assert len(there) > 20 and {m.file[-12:-8] for m in manifest} > {"0000", "0001"}


def test_records_are_in_order_and_point_to_others(spark, tmp_path):
    write_warc(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "a"), 3000, 500)
    fs, path = file_system(str(tmp_path / "a"))
    heads = [top for name in sorted(files(tmp_path / "a")) for top, _ in records(fs, f"{path}/{name}") if top["WARC-Type"] != "warcinfo"]
    ids = [int(h.get("X-Page-ID", -1)) for h in heads]
    assert ids == sorted(ids)  # rows without an id first
    of = {h["WARC-Record-ID"]: h for h in heads}
    assert len(of) == len(heads)
    for h in heads:
        assert h["WARC-Type"] == "response" or (of[h["WARC-Refers-To"]]["WARC-Payload-Digest"], of[h["WARC-Refers-To"]]["WARC-Type"]) == (
            h["WARC-Payload-Digest"], "response")


def test_an_interrupted_run_is_no_archive(spark, tmp_path):
    write_warc(spark.createDataFrame(pages(20), SCHEMA), str(tmp_path / "a"))
    (tmp_path / "a" / "part-000007-0000.warc.gz").write_bytes(b"left by an attempt that the manifest does not know")
    (tmp_path / "a" / "temporary").mkdir(exist_ok=True)
    (tmp_path / "a" / "temporary" / "part-000000-0000.warc.gz.1").write_bytes(b"half")
    assert read_warc(spark, str(tmp_path / "a")).count() == len(pages(20))
    name = sorted(files(tmp_path / "a"))[0]
    whole = (tmp_path / "a" / name).read_bytes()
    (tmp_path / "a" / name).write_bytes(whole[:len(whole) // 2])
    with pytest.raises(Exception, match="cut off|Error"):
        read_warc(spark, str(tmp_path / "a")).count()


def test_empty_table(spark, tmp_path):
    assert write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).collect() == []
    assert read_warc(spark, str(tmp_path / "a")).collect() == []


def test_a_record_by_hand():
    row = dict(zip(KEY, (5, "http://a.example/", hashlib.sha256(b"hi").hexdigest())), bytes=2, refers=None)
    text = gzip.decompress(record(row, 0, "response", b"hi", "2020-01-01T00:00:00Z"))
    head, http, payload = text.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and payload == b"hi\r\n\r\n" and http.endswith(b"Content-Length: 2")
    assert f"Content-Length: {len(http) + 4 + 2}".encode() in head
