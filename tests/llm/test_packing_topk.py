"""Packing round trip and exact search against brute force."""

import numpy as np
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.packing import BM25, Statistics, WordTokenizer, best_two, candidates, fill_order, pack, window_cuts
from tallyframe.llm.topk import exact_top_k

from .data import EDGES, SCHEMA, corpus


def test_every_id_lies_in_one_piece(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = corpus() + [(1000 + i, t, None, None, None) for i, (_, t, *_) in enumerate(EDGES)]
    pieces = pack(spark.createDataFrame(rows, SCHEMA), path, window=256, shard_bytes=20_000).collect()
    tokenizer = Tokenizer.from_file(path)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, text, *_ in rows:
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        place, parts = 0, sorted(by_doc[doc_id], key=lambda p: p.start)
        for p in parts:
            assert p.start == place and p.doc_tokens == len(want) and len(p.ids) == 4 * p.length
            place += p.length
        assert b"".join(p.ids for p in parts) == want.tobytes()
    for parts in by_sequence.values():
        place = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == place
            place += p.length
        assert place == 256 or place < 256 and place & (place - 1) == 0


def test_neighbours_come_by_bm25():
    docs = [[5, 6, 7, 8], [1, 2, 3], [5, 6, 7, 9], [1, 2, 4], [10, 11]]
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    index = BM25(np.concatenate(docs).astype(np.int32), bounds)
    assert index.neighbours(0, np.array([True, False, False, False, False])) == [2]
    assert index.neighbours(4, np.zeros(5, dtype=bool)) == []
    assert fill_order(index, np.array([5, 4, 5, 4, 3]), 4096) == [0, 2, 1, 3, 4]
    assert window_cuts(4096 * 2 + 1030, 4096).tolist() == [4096, 8192, 9216, 9220, 9222]


def test_all_terms_and_all_neighbours_count():
    # document 0 shares 40 rare terms with document 1, and only its commonest term with the last 60
    docs = [[*range(100, 140), 7], list(range(100, 140)), [500, 501], *[[7, 1000 + i] for i in range(60)]]
    size = np.array([len(d) for d in docs])
    index = BM25(np.concatenate(docs).astype(np.int32), np.concatenate(([0], np.cumsum(size))))
    assert index.neighbours(0, np.arange(len(docs)) == 0) == [1, *range(3, 63)]
    assert fill_order(index, size + 1, 4096) == [0, 1, *range(3, 63), 2]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 3]) for i in range(400)]  # many equal scores
    rows += [(1000, None), (1001, [1.0, None]), (1020, [float("nan")] * 6), (1040, [float("inf")] * 6), (1060, []), (1080, [0.5, -0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(tuple(r) for r in exact_top_k(frame, F.col("vec_id") % 20 == 0, k=7).collect())
    good = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int) for i, v in rows
            if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(good):
        if q % 20 == 0:
            n = {i: int(np.dot(good[q][:len(v)], v[:len(good[q])])) for i, v in good.items() if i != q}
            want += [(q, k + 1, i, n[i]) for k, i in enumerate(sorted(n, key=lambda i: (-n[i], i))[:7])]
    assert got == sorted(want)


def test_top_k_large_components(spark):
    rows = [(20, [3e7, 1.0]), (1, [2e7, 5.0]), (2, [2e7, 6.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got)] == [
        (2, int(64 * 3e7) * int(64 * 2e7) + 64 * 384), (1, int(64 * 3e7) * int(64 * 2e7) + 64 * 320)]


def plain_bm25(docs):
    """Every document's scores against all others, by the formula, in plain loops."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: np.log1p((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    return [[sum(idf[t] * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in set(a) if t in b) if a is not b else 0.0
             for b in docs] for a in docs]


def test_scores_are_bm25_of_the_corpus():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30, rng.integers(1, 40)).tolist() for _ in range(40)]
    want, part = plain_bm25(docs), docs[:15]  # a shard of the corpus, whose statistics hold
    df = np.array([sum(t in d for d in docs) for t in range(30)], dtype=float)
    corpus = Statistics.of(df, len(docs), sum(map(len, docs)))
    index = BM25(np.concatenate(part).astype(np.int32), np.concatenate(([0], np.cumsum([len(d) for d in part]))), corpus)
    for a in range(len(part)):
        ranked = sorted((-want[a][b], b) for b in range(len(part)) if want[a][b] > 1e-12)
        assert index.neighbours(a, np.arange(len(part)) == a) == [b for _, b in ranked]


def test_anchors_meet_as_often_as_weights_overlap():
    rng = np.random.default_rng(8)
    df = rng.integers(2, 500, 5000).astype(float)
    corpus = Statistics.of(df, 1000, 100_000)
    shared, alone, same = 30, 10, 0
    for _ in range(600):
        terms = rng.choice(5000, shared + 2 * alone, replace=False).astype("<u2")
        pair = [terms[:shared + alone].tobytes(), np.concatenate((terms[:shared], terms[shared + alone:])).tobytes()]
        first = candidates(pair, corpus.race, "<u2")[:, 0]
        same += first[0] == first[1]
    assert abs(same / 600 - shared / (shared + 2 * alone)) < 0.08
    lonely = Statistics.of(np.ones(4), 4, 4)
    assert (candidates([b"", np.array([1, 2], "<u2").tobytes()], lonely.race, "<u2") == -1).all()
    followers = np.array([20, 9, 3, 8, 5])
    found = np.array([[0, 1, 2, 3], [2, 4, -1, -1], [0, -1, -1, -1], [-1, -1, -1, -1]])
    assert best_two(found, followers).tolist() == [[3, 1], [4, 2], [0, -1], [-1, -1]]


def test_neighbours_come_from_the_whole_corpus(spark):
    """80 groups of near-alike documents, spread over the input: with 40 shards, 0.9 of the documents lie in a sequence with one of
    the nine nearest by BM25 over the corpus."""
    path, rng = tokenizer_path("word_bpe_49k.json"), np.random.default_rng(2)
    tokenizer = Tokenizer.from_file(path)
    words = [w for w, i in tokenizer.get_vocab().items() if w.isalpha() and w.isascii() and 4 <= len(w) <= 9][:6000]
    words.sort()
    common, texts = words[:200], []
    for g in range(80):
        own = [words[200 + 60 * g + i] for i in range(60)]
        for _ in range(10):
            text = own + [common[i] for i in rng.integers(0, 200, 60)]
            for i in rng.integers(0, 60, 3):  # small changes
                text[i] = common[i]
            texts.append(" ".join(text))
    rows = [(int(i), texts[i]) for i in rng.permutation(len(texts))]
    size = sum(map(len, texts)) // 40
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, window=2048, shard_bytes=size).collect()
    docs = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    together = {}
    for p in pieces:
        together.setdefault(p.sequence_id, set()).add(p.doc_id)
    index = BM25(np.concatenate(docs).astype(np.int32), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    met = {d: set().union(*(s for s in together.values() if d in s)) - {d} for d in range(len(docs))}
    found = [bool(met[d] & set(index.neighbours(d, np.arange(len(docs)) == d)[:9])) for d in range(len(docs))]
    assert np.mean(found) >= 0.9


def test_packing_of_repeated_rows_and_missing_ids(spark):
    rows = [(None, "some words here", 1)] * 50 + [(7, "some words here", 2)] * 50 + [(None, None, 3), (8, "", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("ids", F.lit(1)).withColumn("anchor", F.lit("x"))
    got = pack(frame, tokenizer_path("word_bpe_49k.json"), window=16, shard_bytes=64).collect()
    assert sum(p.length for p in got if p.doc_id is None and p.doc_tokens > 1) == 50 * max(p.doc_tokens for p in got)
    assert sorted((p.doc_id, p.length) for p in got if p.doc_tokens == 1 and p.doc_id is not None) == [(8, 1)]
    assert pack(frame.limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []


def test_words_of_letters_go_straight_to_the_model():
    """Ids are those of the whole tokenizer, which only sees what is no word of small letters."""
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = WordTokenizer(path)
    texts = ["plain words, straße; olé. naïve!", "it's ÿ¿ a×b ab1 d'accord 'tis don't! q|| --a caffè‘ ªº µ é\u0301t\u00e9", "CAPS École <|startoftext|>abc x<|endoftext|>,", ""]
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokenizer.by_letters
    seen, encode = [], tokenizer.tokenizer.encode_batch_fast

    class Told:
        model = tokenizer.tokenizer.model

        def encode_batch_fast(self, parts, **options):
            seen.extend(parts)
            return encode(parts, **options)
    tokenizer.tokenizer = Told()
    ids, bounds = tokenizer.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert not {"plain", "straße", "olé", "naïve"} & set(seen) and "it's" in seen
