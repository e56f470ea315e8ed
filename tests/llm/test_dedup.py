"""Repeated windows and near copies against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import anchors, graph, minhash
from tallyframe.llm.anchors import covered
from tallyframe.llm.fm_index import FMIndex, substring_dedup
from tallyframe.llm.graph import components
from tallyframe.llm.minhash import band_keys, near_duplicates, shingle_sets, signatures
from tallyframe.llm.suffix_array import passage_dedup
from tallyframe.llm.text import split_words

from .data import SCHEMA, corpus


def removed_by_hand(rows, length):
    first, out = {}, {}
    split = {r[0]: (r[1] or "").encode().split() for r in rows}
    for d, w in split.items():
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            first[key] = min(first.get(key, d), d)
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < d:
                gone[i:i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
@pytest.mark.parametrize("operator, length", [(substring_dedup, 13), (passage_dedup, 50)])
def test_windows(spark, monkeypatch, operator, length, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "SHARD_WORDS", 3000)
    rows = [*corpus(), (1000, "the " * 900, "en", "s", 0), (1001, "the " * 300, "en", "s", 0)]
    got = operator(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed_by_hand(rows, length)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed
        if r.n_removed:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        else:
            assert r.kept_text == texts[r.doc_id]


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 5, rng.integers(3, 30)) for _ in range(40)]
    flat = np.concatenate([np.append(t, 0) for t in texts])
    index = FMIndex(flat, np.flatnonzero(flat == 0), max(map(len, texts)))
    for n in (1, 2, 4):
        for _ in range(30):
            pattern = rng.integers(1, 5, n)
            low, high = index.first(pattern[-1:])
            for symbol in pattern[-2::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            want = sum(np.array_equal(t[i:i + n], pattern) for t in texts for i in range(len(t) - n + 1))
            assert int(high[0] - low[0]) == want


def linked_by_hand(rows):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_near_duplicates(spark):
    import random

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 300)}" for _ in range(160)]
    rows = corpus()
    for d in range(2000, 2040):  # copies whose similarity to each other lies around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"n{d}"
        rows.append((d, " ".join(words).upper() if d % 7 == 0 else " ".join(words), "en", "s", 0))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_densified_bins_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(1)
    a = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(300)]
    b = [t.rsplit(" ", 9)[0] for t in a]  # 47 of 56 shingles are left
    value, bounds = shingle_sets([t.encode() for t in a + b], 5)
    sig = signatures(value, bounds, 128)
    assert abs((sig[:300] == sig[300:]).mean() - 47 / 56) < 0.02
    assert band_keys(sig, 32).shape == (600, 32)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    parent = list(range(700))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert max(Counter(got.values()).values()) > 2


@pytest.mark.parametrize("rare", [2, 12])
def test_a_group_whose_edits_are_shared_by_few(spark, monkeypatch, rare):
    """Near copies of one text, with 0 to 12 edits each out of a pool, so that pairs below and above the threshold share edits."""
    monkeypatch.setattr(minhash, "RARE", rare)
    rng = random.Random(12)
    base = [f"word{i}" for i in range(150)]
    pool = [(rng.randrange(150), f"edit{i}") for i in range(60)]
    rows = []
    for i in range(220):
        words = list(base)
        for at, word in rng.sample(pool, rng.randint(0, 12)):
            words[at] = word
        rows.append((i, " ".join(words), None, None, None))
    for i in range(40):  # pairs that only their own edits bring together
        words = list(base)
        for at in rng.sample(range(150), 14):
            words[at] = f"pair{i // 2}"
        words = words[:140] + [f"tail{i // 2}-{j}" for j in range(60)]
        words[rng.randrange(150)] = "own"
        rows.append((1000 + i, " ".join(words), None, None, None))
    sets = {r[0]: {tuple(r[1].split()[j:j + 5]) for j in range(len(r[1].split()) - 4)} for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: find(d) for d in sets} and len(set(got.values())) > 20


@pytest.mark.parametrize("operator, length", [(substring_dedup, 13), (passage_dedup, 50)])
def test_one_id_with_different_texts(spark, operator, length):
    def words(prefix, n):
        return [f"{prefix}{i}" for i in range(n)]
    p, q, z = (words(c, 90) for c in "pqz")
    rows = [(1, " ".join(p), None, None, None), (5, " ".join(q + p), None, None, None), (5, " ".join(z), None, None, None),
            (5, " ".join(z[:60]), None, None, None), (5, " ".join(z[:60]), None, None, None), (5, None, None, None, None),
            (7, " ".join(z[10:80]), None, None, None), (None, " ".join(z), None, None, None), (None, " ".join(p), None, None, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in operator(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == sorted([("1", 90, 0), ("5", 180, 90), ("5", 90, 0), ("5", 60, 0), ("5", 60, 0), ("5", 0, 0), ("7", 70, 70), ("None", 90, 0), ("None", 90, 0)])


def test_small_and_large_graphs_have_equal_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (320, 2))] + [(1000 - i, 999 - i) for i in range(90)] + [(3, 3)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    small = sorted(map(tuple, components(frame).collect()))
    monkeypatch.setattr(graph, "SMALL", 10)
    assert sorted(map(tuple, components(frame).collect())) == small
    assert components(frame.limit(0)).collect() == []


def test_removed_words_from_flat_columns():
    """Against a plain count: windows that touch a document's ends, neighbours that both lose words, a null id, documents without hits."""
    rng = random.Random(8)
    texts = [" ".join(f"w{j}" for j in range(rng.randint(0, 30))).encode() or None for _ in range(60)]
    ids = [None if i % 17 == 5 else i for i in range(60)]
    words = split_words(texts)
    hits = []
    for t in texts:
        n = len((t or b"").split()) - 3
        hits.append(None if n < 1 or rng.random() < 0.2 else [
            {"start": s, "seen": [rng.randint(0, 60) for _ in range(rng.randint(1, n - s))]} for s in rng.sample(range(n), min(n, 3))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("seen", pa.list_(pa.int64()))]))
    want = []
    for d, t, h in zip(ids, texts, hits):
        gone = [False] * len((t or b"").split())
        for x in h or ():
            for k, low in enumerate(x["seen"]):
                if d is not None and low < d:
                    gone[x["start"] + k:x["start"] + k + 4] = [True] * 4
        want += gone
    assert covered(words, pa.array(ids, pa.int64()), pa.array(hits, kind), 4).tolist() == want and 0 < sum(want) < len(want)


def test_few_rows_take_few_tasks(spark):
    """The rounds over a group of near copies: tasks follow the rows, not the partitions that a shuffle is set to."""
    rng = random.Random(3)
    base = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join(f"edit{rng.randrange(50)}" if rng.random() < 0.04 else w for w in base), None, None, None) for i in range(150)]
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    context.setJobGroup("few-rows", "near copies")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    told = context.statusTracker()
    stages = {s: told.getStageInfo(s) for j in told.getJobIdsForGroup("few-rows") for s in told.getJobInfo(j).stageIds}
    tasks = sum(s.numCompletedTasks for s in stages.values() if s)
    print("tasks", tasks)
    assert tasks < 3000
