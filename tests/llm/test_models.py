"""Language identification, lattice scores, quality rules and mixing against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from tallyframe.llm import lattice
from tallyframe.llm.gru import ByteTagger, fit, identify_languages
from tallyframe.llm.lattice import Pieces, arc_weights, expected_uses, score_texts, spelled
from tallyframe.llm.licenses import scan_licenses
from tallyframe.llm.quality import judge_quality, log_ratios
from tallyframe.llm.raking import MARGINS, mix_to_targets, rake, smoothed_targets
from tallyframe.llm.text import split_words

from .data import SCHEMA, corpus

DATA = "/root/testdata/sf0.001/documents.parquet"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    tagger = ByteTagger.fresh(["a", "b", "c"], 4, 1)
    for g in (tagger.forward, tagger.backward, tagger.head):
        for k in g:
            g[k] = g[k].astype(np.float64)
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)

    def loss():
        return -np.log(tagger.positions(x)[0][:, np.arange(5), y]).mean()

    from tallyframe.llm.gru import back_direction

    kept = ([], [])
    chance, _ = tagger.positions(x, kept)
    chance[:, np.arange(5), y] -= 1
    down = (chance / (6 * 5)) @ tagger.head["v"].T
    grads = {"f": back_direction(tagger.forward, x, kept[0], down[:, :, :4]),
             "b": back_direction(tagger.backward, x[::-1], kept[1], down[::-1, :, 4:])}
    for name, group in (("f", tagger.forward), ("b", tagger.backward)):
        for k, at in (("u", (1, 5)), ("u", (3, 11)), ("b", (2,)), ("w", (int(x[2, 1]), 7))):
            old = group[k][at]
            group[k][at] = old + 1e-3
            up = loss()
            group[k][at] = old - 1e-3
            low = loss()
            group[k][at] = old
            assert (up - low) / 2e-3 == pytest.approx(grads[name][k][at], rel=0.05, abs=2e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(DATA)
    tagger = fit(docs, steps=200)
    rows = identify_languages(docs, tagger).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 20
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_model_reads_training_rows_only(spark):
    rows = corpus(120)
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    wrong = [(d, t, "xx" if d in held else lang, s, n) for d, t, lang, s, n in rows]
    a = identify_languages(spark.createDataFrame(rows, SCHEMA), fit(spark.createDataFrame(rows, SCHEMA), steps=20)).collect()
    b = identify_languages(spark.createDataFrame(wrong, SCHEMA), fit(spark.createDataFrame(wrong, SCHEMA), steps=20)).collect()
    assert sorted(a) == sorted(b)


def segmentations(word):
    if not word:
        return [[]]
    return [[word[:n], *rest] for n in range(1, min(16, len(word)) + 1) for rest in segmentations(word[n:])]


def test_lattice_sums_all_segmentations():
    pieces = Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    weight, stop = arc_weights(pieces, np.zeros(len(pieces.prior)), 0.0)
    texts = [b"water", "étés".encode(), b"a", b"zqxjk", b"therein"]
    words = split_words(texts)
    got = spelled(pieces, [(weight, stop)], words, np.arange(len(texts)))[:, 0]
    uses = np.zeros(len(pieces.prior))
    for text, value in zip(texts, got):
        total = 0.0
        for parts in segmentations(text):
            ways = [[]]
            for i, part in enumerate(parts):
                number = int(pieces.find(int(i > 0), np.array([lattice.piece_key(part)], dtype=np.uint64))[0])
                arcs = ([number] if number >= 0 else []) + ([pieces.byte(int(i > 0)) + part[0]] if len(part) == 1 else [])
                ways = [[*w, a] for w in ways for a in arcs]
            for w in ways:
                chance = math.exp(sum(weight[a] for a in w))
                total += chance
                np.add.at(uses, w, chance * math.exp(stop) / 10 ** value)
        assert math.log10(total * math.exp(stop)) == pytest.approx(value, abs=1e-9)
    assert np.allclose(expected_uses(pieces, weight, words, np.arange(len(texts))), uses)
    assert np.exp(weight[:pieces.first]).sum() == pytest.approx(1)


def test_lattice_of_long_words_and_long_pieces():
    path = tokenizer_path("piece_bpe_32k.model")
    pieces = Pieces.load(path)
    weight, stop = arc_weights(pieces, np.zeros(len(pieces.prior)), 0.0)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    start = {p[1:].encode() for p in names if p.startswith("▁") and len(p) > 1 and "▁" not in p[1:]}
    onward = {p.encode() for p in names if "▁" not in p}
    long = max(len(p) for p in start | onward)
    texts = [b"abcdefghij" * 1000, max(start | onward, key=lambda p: (len(p), p))]
    assert long > 16
    got = spelled(pieces, [(weight, stop)], split_words(texts), np.arange(2))[:, 0]
    for text, value in zip(texts, got):
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            ways = [alpha[end - 1] + weight[pieces.byte(int(end > 1)) + text[end - 1]]]
            for a in range(max(0, end - long), end):
                if text[a:end] in (onward if a else start):
                    ways.append(alpha[a] + weight[int(pieces.find(int(a > 0), np.array([lattice.piece_key(text[a:end])], dtype=np.uint64))[0])])
            alpha.append(float(np.logaddexp.reduce(ways)))
        assert value == pytest.approx((alpha[-1] + stop) / math.log(10), rel=1e-9)


def test_long_unknown_words_cost_their_length(spark):
    held = [d for d in range(2000, 3000) if zlib.crc32(str(d).encode()) % 10 == 0][:3]  # not learned from
    rows = corpus(60) + [(d, "ж" * n, "en", "a", n) for d, n in zip(held, (500, 1000, 5000))]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, SCHEMA), tokenizer_path("piece_bpe_32k.model")).collect()}
    a, b, c = (got[d] for d in held)
    assert c < b < a < -300 and (b - c) / (a - b) == pytest.approx(8, rel=1e-3)


def test_lattice_does_not_depend_on_file_splits(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    one, many = [{r.doc_id: r.score for r in score_texts(docs.repartition(n, "doc_id"), tokenizer_path("piece_bpe_32k.model")).collect()}
                 for n in (1, 12)]
    assert all(one[d] == pytest.approx(many[d], rel=1e-9) for d in one)


@pytest.mark.parametrize("block_bytes", [24 << 20, 20_000])
def test_lattice_scores(spark, block_bytes):
    rows = corpus() + [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "THE The the", "en", "a", 11)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, SCHEMA), tokenizer_path("piece_bpe_32k.model"),
                                            block_bytes=block_bytes).collect()}
    split = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    training = [d for d in split if zlib.crc32(str(d).encode()) % 10]
    count = Counter(w for d in training for w in split[d]) + Counter({"end": len(training)})
    n, v = sum(count.values()), len(count)
    for d, words in split.items():
        tokens = [*words, "end"]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            d not in set(training), len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert got[902].n_known == 4 or count[b"the"] == 0


def test_lattice_beats_plain_counts(spark):
    rows = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path("piece_bpe_32k.model")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_raking_both_ways(spark):
    cells = spark.createDataFrame([(s, lang, t, 10 + 7 * i * j + t) for i, s in enumerate("abc") for j, lang in enumerate(("en", "fr")) for t in range(2)],
                                  "source string, lang string, topic int, tokens long")
    aims = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double"),
            "lang": spark.createDataFrame([("en", 0.6), ("fr", 0.4)], "lang string, share double"),
            "topic": spark.createDataFrame([(0, 0.25), (1, 0.75)], "topic int, share double")}
    arrays = sorted(tuple(r) for r in rake(cells, aims).select(*MARGINS, "weight").collect())
    tables = sorted(tuple(r) for r in rake(cells, aims, tolerance=1e-4, driver_cells=0).select(*MARGINS, "weight").collect())
    assert [r[:3] for r in arrays] == [r[:3] for r in tables]
    assert np.allclose([r[3] for r in arrays], [r[3] for r in tables], atol=1e-3)
    assert sum(r[3] for r in arrays if r[0] == "a") == pytest.approx(0.5, abs=1e-6)
    assert sum(r[3] for r in arrays if r[2] == 1) == pytest.approx(0.75, abs=1e-6)


def test_mixture_is_calibrated(spark):
    rows = mix_to_targets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len(rows) == 1000
    for name in MARGINS:
        tokens, expected = Counter(), Counter()
        for r in rows:
            tokens[r[name]] += r.n_tokens
            expected[r[name]] += r.n_tokens * r.probability if r.n_tokens else 0
        tokens = {k: v for k, v in tokens.items() if v}
        raised = {k: (v / sum(tokens.values())) ** 0.8 for k, v in tokens.items()}
        for k in tokens:
            assert expected[k] / sum(expected.values()) == pytest.approx(raised[k] / sum(raised.values()), abs=1e-5)
    kept, mean = sum(r.kept for r in rows), sum(r.probability for r in rows)
    assert abs(kept - mean) < 4 * math.sqrt(sum(r.probability * (1 - r.probability) for r in rows)) + 1


def test_a_few_words_do_not_fix_the_size_of_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(90_000, "Re. A.", "de", "src0", 6), (90_001, "A.", "xx", "rare", 2), (90_002, "", "en", "src1", 0)], SCHEMA)
    rows = mix_to_targets(docs.union(odd)).collect()
    words = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) / words > 0.5
    assert sum(r.kept for r in rows) / len(rows) > 0.5
    got = {r.doc_id: r for r in rows}
    assert (got[90_001].source, got[90_001].lang) == ("rare", "xx") and got[90_000].topic >= 0 and got[90_002].topic == -1
    assert max(r.multiplier for r in rows) <= 4


def test_raking_within_bounds(spark):
    cells = spark.createDataFrame([("a", "en", 0, 10), ("a", "fr", 0, 90), ("b", "en", 0, 100), ("b", "fr", 1, 800)],
                                  "source string, lang string, topic int, tokens long")
    aims = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.7)], "source string, share double"),
            "lang": spark.createDataFrame([("en", 0.4), ("fr", 0.6)], "lang string, share double")}
    assert max(1000 * r.weight / r.tokens for r in rake(cells, aims).collect()) > 5
    arrays, tables = [{tuple(r[:3]): 1000 * r.weight / r.tokens for r in rake(cells, aims, sweeps=6, most=4.0, driver_cells=n).collect()}
                      for n in (100, 0)]
    assert max(arrays.values()) <= 4 + 1e-9 and all(arrays[k] == pytest.approx(tables[k], abs=1e-6) for k in arrays)
    uneven = spark.createDataFrame([("a", "en", 0, 1), ("b", "en", 0, 99), ("c", "en", 0, 9900)], cells.schema)
    share = {r.source: r.share for r in smoothed_targets(uneven, "source", 0.5).collect()}
    assert share["a"] == pytest.approx(2e-4) and share["b"] == pytest.approx(0.0198) and sum(share.values()) == pytest.approx(1)


def test_quality_counts_and_scores(spark):
    rows = corpus(100) + [(500, "a b c d e f g h i a b c d e f g h i\nx\n\nx\n x", "en", "s", 0), (501, "# x# $ | <>", "en", "s", 0),
                          (502, "z " * 40, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in (*range(0, 100, 2), 4, 4, 777)], "doc_id long")
    ratios = log_ratios(docs, trusted, buckets=64)
    got = {r.doc_id: r for r in judge_quality(docs, trusted, buckets=64, threshold=0.0).collect()}
    raw, good = Counter(), Counter()
    bucket = {}
    for d, text, *_ in rows:  # hashes come from Spark, the counting is done here
        words = [w.decode() for w in text.encode().split()]
        bucket[d] = words
    pairs = spark.createDataFrame([(w,) for w in {w.lower() for ws in bucket.values() for w in ws}], "w string").select("w", F.xxhash64("w").alias("h"))
    h = {r.w: r.h for r in pairs.collect()}
    grams = {(a, b) for ws in bucket.values() for a, b in zip(ws, ws[1:])}
    two = spark.createDataFrame([(a, b, h[a.lower()], h[b.lower()]) for a, b in grams], "a string, b string, x long, y long")
    pair = {(r.a, r.b): r.k for r in two.select("a", "b", F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("k")).collect()}
    lists = {d: [h[w.lower()] % 64 for w in ws] + [pair[p] for p in zip(ws, ws[1:])] for d, ws in bucket.items()}
    for d, ks in lists.items():
        raw.update(ks)
        if d % 2 == 0 and d < 100:
            good.update(ks)
    want = [math.log((good[k] + 1) / (sum(good.values()) + 64)) - math.log((raw[k] + 1) / (sum(raw.values()) + 64)) for k in range(64)]
    assert np.allclose(ratios, want)
    for d, text, *_ in rows:
        w = text.encode().split()
        c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = [False] * len(w)
        for i in range(len(w) - 7):
            if c[tuple(w[i:i + 8])] > 1:
                hit[i:i + 8] = [True] * 8
        lines = [x for x in text.split("\n") if x.split()]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(len(x.decode()) for x in w), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit))
        assert r.base_failed == (len(w) < 20 or 100 * sum(hit) > 30 * len(w))
        assert r.score == pytest.approx(sum(want[k] for k in lists[d]) / len(lists[d]), abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= 0)


def test_licenses(spark):
    rows = [(1, "Some words.\nReleased under the MIT License.\nMore words follow here", "en", "s", 0),
            (2, "This work is licensed under the GNU General Public License, version 3", "en", "s", 0),
            (3, "this WORK is Licensed under the GNU general public license - version 2!", "en", "s", 0),
            (4, "Permission is granted. The licence is unclear.", "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    got = {(r.doc_id, r.line): (r.license, r.dice) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2): ("MIT", 1.0), (2, 1): ("GPL-3.0", 1.0), (3, 1): ("GPL-2.0", 1.0)}


def test_license_scan_reads_a_text_once(spark):
    """One pass serves the lines and the whole; a long text with few different bigrams is still compared as a whole."""
    notice, prose = "Licensed under the MIT License.", " ".join(f"w{i}" for i in range(500))
    rows = [(1, "Licensed under\nthe MIT License", "en", "s", 0), (2, (notice + " ") * 60, "en", "s", 0),
            (3, (notice + "\n") * 60, "en", "s", 0), (4, prose + " " + notice, "en", "s", 0), (5, prose + "\n" + notice, "en", "s", 0)]
    found = scan_licenses(spark.createDataFrame(rows, SCHEMA))
    got = {(r.doc_id, r.line): (r.template, r.n_bigrams, r.shared) for r in found.collect()}
    again = {(3, line): ("MIT/1", 4, 4) for line in range(1, 61)}
    assert got == {(1, 0): ("MIT/1", 4, 4), (2, 1): ("MIT/1", 5, 4), (3, 0): ("MIT/1", 5, 4), (5, 2): ("MIT/1", 4, 4), **again}
    assert "Union" not in str(found._jdf.queryExecution().optimizedPlan())  # the documents are scanned once


def test_arcs_are_all_pieces_that_stand_there():
    """The look-up leaves out places by their first bytes: against a plain search, and few places are looked up for long pieces."""
    path = tokenizer_path("piece_bpe_32k.model")
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=path), Pieces.load(path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    start = {p[1:].encode() for p in plain if p.startswith("▁") and len(p) > 1 and "▁" not in p[1:]}
    onward = {p.encode() for p in plain if "▁" not in p}
    looked_up, find = Counter(), Pieces.find
    for words in ([b"international", b"constitution_", b"xqzkvwjxqzkvw"], ["населения".encode(), "übergäbeförmi".encode()[:18].ljust(18, b"e")], [b"ab"], [b"a"]):
        size = len(words[0])
        matrix = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, size)
        pieces.find = lambda onward, key: (looked_up.update({size: key.size}), find(pieces, onward, key))[1]
        got = {(n, w, p) for n, number in lattice.arcs_of(pieces, matrix)[1:] for w, p in zip(*np.nonzero(number >= 0))}
        want = {(n, w, p) for w, word in enumerate(words) for p in range(size) for n in range(1, size - p + 1)
                if word[p:p + n] in (start if p == 0 else onward)}
        assert got == want
    assert looked_up[13] < 3 * 13 * 14 / 2


def test_words_of_several_classes_are_spelled_once():
    pieces = Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    weight, _ = arc_weights(pieces, np.zeros(len(pieces.prior)), 0.0)
    words = split_words([b"water", b"therein", b"zqxjk", "étés".encode(), b"a"])
    member = np.array([[1, 0, 1], [1, 0, 0], [0, 0, 1], [1, 0, 1], [1, 0, 0]], dtype=bool)
    got = expected_uses(pieces, weight, words, np.arange(5), member)
    assert got.shape == (3, len(pieces.prior)) and not got[1].any()
    for k in (0, 2):
        assert np.allclose(got[k], expected_uses(pieces, weight, words, np.flatnonzero(member[:, k])))


def test_a_blocks_words_come_once_whatever_the_slices(monkeypatch):
    monkeypatch.setattr(lattice, "COUNT_BYTES", 20)
    texts, block, kind = [b"a b a", b"b c", None, b"a The", b"the b"] * 3, [0] * 6 + [3] * 9, [0, -1, 2, 2, 0] * 3
    rows = pa.RecordBatch.from_pydict({
        "text": pa.array([t if t is None else zstandard.ZstdCompressor().compress(t) for t in texts], pa.binary()),
        "class": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int32())})
    got = [tuple(r.values()) for out in lattice.block_words([0, 2])(iter([rows])) for r in out.to_pylist()]
    want = {}
    for text, b, k in zip(texts, block, kind):
        for word in (text or b"").lower().split():
            own = want.setdefault((b, int(split_words([word]).hashes.view(np.int64)[0])), [0, 0])
            if k >= 0:
                own[k // 2] += 1
    assert len(got) == len(want) and {(b, w): [x, y] for b, w, x, y in got} == want


def test_texts_are_split_once_for_their_counts(spark):
    """One pass over the dealt texts for the blocks' words and one for the scores; three passes and shuffles of words before."""
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    plan = score_texts(docs, tokenizer_path("piece_bpe_32k.model"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Join" not in plan  # the dealt texts, read by both sides, and the words
