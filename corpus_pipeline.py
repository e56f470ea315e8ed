"""From documents to packed training sequences: five stages, each an operator of tallyframe.llm over all that is left.

Every stage's rows are written as Parquet in the shared folder and read again by the next one. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

import os

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.fm_index import substring_dedup
from tallyframe.llm.gru import keep_identified
from tallyframe.llm.minhash import keep_one
from tallyframe.llm.packing import pack
from tallyframe.llm.raking import keep_mixture
from tallyframe.llm.text import ready


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the later documents; n_chars follows, and documents with no word left go. Rows with a null
    doc_id stay as they are."""
    kept = substring_dedup(docs)
    rest = kept.filter("n_words = 0 OR n_removed < n_words").select("doc_id", "n_removed", "kept_text")
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    joined = docs.select(*columns, *(["n_chars"] if "n_chars" in docs.columns else [])).join(rest, "doc_id")
    out = {"text": F.col("kept_text"),
           "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))}
    done = joined.select(*[(out[c].cast(docs.schema[c].dataType).alias(c) if c in out else F.col(c)) for c in docs.columns])
    return done.union(docs.filter("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares of source, language and topic meet the targets."""
    return keep_mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; the rows are pieces of documents."""
    pieces = pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # trained and iterative stages: tests/llm compares them with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of a directory; returns the rows of the last."""
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{os.urandom(6).hex()}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
