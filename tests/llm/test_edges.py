"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names in every operator."""

import corpus_pipeline
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from tallyframe.llm.fm_index import substring_dedup
from tallyframe.llm.gru import fit, identify_languages, keep_identified
from tallyframe.llm.lattice import score_texts
from tallyframe.llm.licenses import scan_licenses
from tallyframe.llm.minhash import keep_one, near_duplicates
from tallyframe.llm.packing import pack
from tallyframe.llm.quality import judge_quality
from tallyframe.llm.raking import keep_mixture, mix_to_targets
from tallyframe.llm.suffix_array import passage_dedup
from tallyframe.llm.topk import exact_top_k

from .data import CLASHES, EDGES, SCHEMA

OPERATORS = {
    "passages": passage_dedup, "substrings": substring_dedup,
    "lattice": lambda d: score_texts(d, tokenizer_path("piece_bpe_32k.model")),
    "mixing": mix_to_targets, "licenses": scan_licenses,
    "languages": lambda d: identify_languages(d, fit(d, steps=3)),
    "packing": lambda d: pack(d, tokenizer_path("word_bpe_49k.json")).groupBy("doc_id").agg(F.count("*")),
    "near": near_duplicates,
    "quality": lambda d: judge_quality(d, d.select("doc_id")),
}
FILTERS = {"keep_identified": keep_identified, "keep_one": keep_one, "keep_mixture": keep_mixture}


def clashing(df):
    return df.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    got = OPERATORS[name](clashing(spark.createDataFrame(EDGES, SCHEMA))).collect()
    if name == "licenses":
        assert got == []
        return
    ids = [r.doc_id for r in got]
    want = sorted({r[0] for r in EDGES}, key=str) if name == "packing" else [r[0] for r in EDGES]
    assert sorted(ids, key=str) == sorted(want, key=str)
    rows = {r.doc_id: r for r in got}
    if name in ("passages", "substrings"):
        assert rows[1].kept_text is None and rows[2].kept_text == "" and rows[5].n_removed == 0
        assert rows[10].n_removed == 0  # eleven words: shorter than a window
    if name == "near":
        assert rows[10].component_id == 8 and rows[1].component_id == 1 and rows[1].n_shingles == 0 and rows[1].kept
        assert rows[8].kept and rows[None].kept
    if name == "languages":
        assert rows[1].lang_pred == rows[7].lang_pred == "und" and rows[1].score == 0
    if name == "quality":
        assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[5].n_repeat_words == 20000
    if name == "mixing":
        assert rows[1].n_tokens == 0 and rows[1].probability == 1 and rows[1].topic == -1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, name):
    docs = clashing(spark.createDataFrame([r for r in EDGES if r[0] is not None], SCHEMA))
    out = FILTERS[name](docs)
    assert out.dtypes == docs.dtypes
    assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    empty = FILTERS[name](docs.limit(0))
    assert empty.dtypes == docs.dtypes and empty.collect() == []


@pytest.mark.parametrize("name", ["keep_one", "keep_mixture", "substrings"])
def test_filters_keep_rows_without_id(spark, name):
    known = "a text that another row has with an id, and which is long enough to have some shingles in it"
    rows = [r for r in EDGES if r[0] is None or r[0] in (8, 10)] + [(20, known, "en", "a", 0), (None, known, "en", "a", 0), (None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stage = FILTERS.get(name) or (lambda d: corpus_pipeline.substring(d.sparkSession, d, ""))
    got = sorted((tuple(r) for r in stage(docs).collect() if r.doc_id is None), key=str)
    want = [r for r in rows if r[0] is None]
    if name == "keep_mixture":  # all draw one number, and each meets the probability of its own cell
        flags = [r for r in mix_to_targets(docs).collect() if r.doc_id is None]
        assert len(flags) == 3 and len(got) == sum(r.kept for r in flags) > 0
    else:
        assert got == sorted(want, key=str)


def test_search_on_empty_table(spark):
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 20 == 0).collect() == []
