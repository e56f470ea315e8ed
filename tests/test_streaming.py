"""Streams against the batch result: any cut of the log, repeated batches, late rows, folders that do not grow."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.events import event_dedup_once
from tallyframe.streaming.event_counts import run_counts, run_window_counts, stream_events
from tallyframe.streaming.keyed_table import KeyedTable
from tallyframe.streaming.state_changes import run_dedup_once

START = datetime(2024, 1, 1)
ROWS = "event_id string, event_name string, timestamp string, session_id string, success boolean"


def append(spark, log, rows):
    out = [(str(i), name, at if at is None or isinstance(at, str) else at.isoformat(sep=" "), session, ok) for i, name, at, session, ok in rows]
    spark.createDataFrame(out, ROWS).coalesce(1).write.mode("append").json(log)


def folders(path):
    return {p.relative_to(path).as_posix() for p in Path(path).rglob("slot=*")}


def test_keyed_table_keeps_the_last_row_in_few_folders(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, j int, v double", ["k", "j"], keep=3)
    assert table.read().collect() == []
    rng, now, past = random.Random(1), {}, []
    for epoch in range(20):
        past.append(dict(now))
        new = {(rng.choice(["a", "b", "c", None]), rng.randint(0, 4)): rng.random() for _ in range(rng.randint(0, 4))}
        now.update(new)
        frame = spark.createDataFrame([(k, j, v) for (k, j), v in new.items()], "k string, j int, v double")
        for _ in range(1 + epoch % 2):  # every second batch is repeated
            table.merge(frame, epoch)
    read = lambda f: {(r["k"], r["j"]): r["v"] for r in f.collect()}
    assert read(table.read()) == now
    for back in range(1, 4):
        assert read(table.read(before=20 - back)) == past[20 - back]
    assert folders(tmp_path / "t") == {f"changes/slot={i}" for i in range(6)} | {"snapshot/slot=0", "snapshot/slot=1"}


def test_an_unfinished_snapshot_loses_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k int, v int", ["k"], keep=2)
    for epoch in range(6):
        table.merge(spark.createDataFrame([(epoch, epoch)], "k int, v int"), epoch)
    for part in (tmp_path / "t" / "snapshot" / "slot=0").glob("*"):  # the newest, of epochs 0 to 5, as an overwrite that died leaves it
        part.unlink()
    assert {r["k"] for r in table.read().collect()} == set(range(6))
    table.merge(spark.createDataFrame([(5, 50)], "k int, v int"), 5)  # the batch is repeated
    assert {r["k"]: r["v"] for r in table.read().collect()} == {**{k: k for k in range(5)}, 5: 50}


def test_counts_over_many_batches(spark, tmp_path):
    rng = random.Random(3)
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    want = {}
    for batch in range(7):
        rows = [(i, rng.choice(["view", "click", "", None]), START, "s", rng.choice([True, False, None])) for i in range(rng.randint(1, 9))]
        for _, name, _, _, ok in rows:
            want[name or "unknown", ok] = want.get((name or "unknown", ok), 0) + 1
        append(spark, log, rows)
        if batch % 2:
            got = run_counts(spark, log, out, check, files_per_batch=1, keep=2)
            assert {(r["event_name"], r["success"]): r["count"] for r in got.collect()} == want
    assert len(folders(out)) <= 6 and run_counts(spark, log, out, check, keep=2).agg(F.sum("count")).first()[0] == sum(want.values())


def test_late_rows_leave_windows_by_rule(spark, tmp_path):
    rng = random.Random(5)
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    want, mark, late = {}, None, 0
    for batch in range(4):
        rows = []
        for i in range(60):
            at = START + timedelta(hours=10 * batch + rng.random() * 10 - (rng.random() < 0.3) * rng.random() * 25, microseconds=7)
            rows.append((i, "view", at, "s", True))
        rows.append((99, "view", "no time", "s", True))
        rows.append((99, "view", None, "s", True))
        for _, _, at, _, _ in rows[:-2]:
            start = at.replace(hour=at.hour // 2 * 2, minute=0, second=0, microsecond=0)
            if mark is None or start + timedelta(hours=2) > mark:
                want[start] = want.get(start, 0) + 1
            else:
                late += 1
        newest = max(r[2] for r in rows[:-2])
        newest = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - timedelta(hours=6)
        mark = newest if mark is None else max(mark, newest)
        append(spark, log, rows)
        got = run_window_counts(spark, log, out, check, "2 hours", "6 hours", keep=2)
        assert {r["window_start"]: r["count"] for r in got.collect()} == want
    assert late > 10 and len(folders(out)) <= 6


@pytest.mark.parametrize("cut", [1, 3, 11])
def test_changes_in_any_cut_are_those_of_the_batch(spark, tmp_path, cut):
    rng = random.Random(7)
    rows = [(i, "e", START + timedelta(seconds=40 * i // 3), rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([True, False, None])) for i in range(160)]
    log, out, state, check = (str(tmp_path / n) for n in ("log", "out", "state", "check"))

    def shaped(frame):
        return frame.select(F.col("event_id").cast("int"), "session_id", F.to_timestamp("timestamp").alias("ts"), "success", F.lit("k").alias("key"))

    args = ("session_id", "key", "success", "ts", "event_id")
    edges = sorted(rng.sample(range(1, 160), cut - 1))
    for a, b in zip([0, *edges], [*edges, 160]):
        append(spark, log, rows[a:b])
    got = run_dedup_once(shaped(stream_events(spark, log, files_per_batch=1)), out, state, check, *args, keep=2)
    want = event_dedup_once(shaped(spark.read.schema(ROWS).json(log)), *args)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # rows that are not after the last of their session are late, others go on from the state
    append(spark, log, [(500, "e", START, "hot", None), (501, "e", START + timedelta(days=1), "hot", rows[-1][4]), (502, "e", START, "new", True)])
    again = run_dedup_once(shaped(stream_events(spark, log, files_per_batch=1)), out, state, check, *args, keep=2)
    ids = {r["event_id"] for r in again.collect()} - {r["event_id"] for r in want.collect()}
    last = [r for r in rows if r[3] == "hot"][-1]
    assert ids == {502} | ({501} if last[4] != rows[-1][4] else set())


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    log, out, state, check = (str(tmp_path / n) for n in ("log", "out", "state", "check"))
    merge, died = KeyedTable.merge, []

    def dies_once(self, rows, epoch):
        merge(self, rows, epoch)
        if epoch == 1 and not died:
            died.append(epoch)
            raise RuntimeError("lost after the state was written")
    monkeypatch.setattr(KeyedTable, "merge", dies_once)
    for batch in range(3):
        append(spark, log, [(10 * batch + i, "e", START + timedelta(hours=batch, minutes=i), "s", i % 3 == 0) for i in range(6)])

    def run():
        events = stream_events(spark, log, files_per_batch=1).select("event_id", "session_id", F.to_timestamp("timestamp").alias("ts"), "success", F.lit("k").alias("key"))
        return run_dedup_once(events, out, state, check, "session_id", "key", "success", "ts", "event_id")
    with pytest.raises(Exception, match="lost after"):
        run()
    assert sorted(int(r["event_id"]) for r in run().collect()) == [0, 1, 3, 4, 10, 11, 13, 14, 20, 21, 23, 24] and died
