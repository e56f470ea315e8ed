"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
PRIOR = 1.0  # added to every bucket's count in both distributions
THRESHOLD = -0.25
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words (never null) and their hashes."""
    found = F.filter(F.split(F.coalesce("text", F.lit("")), WORD_GAP), lambda w: w != "")
    return docs.select("*", found.alias("words")).select("*", F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("word_hashes"))


def gram_buckets(buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    h = F.col("word_hashes")
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(1), F.size(h) - 1),
                      lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(buckets)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log p_trusted - log p_raw of each bucket; counts cover all documents, the result has `buckets` numbers.

    trusted holds the doc_ids of trusted documents. If none of them is there, every ratio is 0.
    """
    good = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(1))
    # trusted ids have no size bound: always a merge join, never a broadcast
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))
    grams = with_words(marked).select("good", F.explode(gram_buckets(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("trusted")).collect()  # at most `buckets` rows
    from math import log

    raw, target = [prior] * buckets, [prior] * buckets
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["trusted"]
    if not any(row["trusted"] for row in counts):
        return [0.0] * buckets
    log_raw, log_target = log(sum(raw)), log(sum(target))
    return [(log(t) - log_target) - (log(r) - log_raw) for t, r in zip(target, raw)]


def base_counts(words: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to a frame of with_words."""
    h = F.col("raw_hashes")
    windows = F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce("text", F.lit(""))
    some = (words.withColumn("raw_hashes", F.transform("words", lambda w: F.xxhash64(w)))
            .withColumn("windows", windows).withColumn("lines", lines))
    # windows sorted by hash, then place: equal ones are neighbours; only texts that repeat one come to this
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    some = some.withColumn("ordered", F.when(repeats, F.array_sort(F.transform(
        "windows", lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))))
    ordered = F.col("ordered")
    twice = F.filter(ordered, lambda x, j: (x["hash"] == F.get(ordered, j - 1)["hash"]) | (x["hash"] == F.get(ordered, j + 1)["hash"]))
    some = some.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["place"])))
    places = F.col("places")
    covered = F.transform(places, lambda p, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(places, j - 1))))
    return some.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, c: a + c), F.lit(0)).cast("long").alias("n_repeat_words"))


def judge_quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score is the mean over a text's words and word pairs (lower case, hashed to buckets) of log p_trusted - log p_raw; a
    document that passes the base rules is kept if it is at least threshold. Distributions are multinomials counted over all
    documents, trusted ones being those whose doc_id is in `trusted`.

    A null text counts as empty: no words, base_failed, score 0, not kept. Repeated rows are judged one by one (and counted
    each); ids in `trusted` may repeat or be unknown. No trusted document: all scores are 0. An empty table gives an empty
    result. Extra columns are not read; a null doc_id stays null and is never trusted.
    """
    ratios = log_ratios(docs, trusted, buckets, prior)
    table = docs.sparkSession.createDataFrame([(ratios,)], "ratios array<double>")  # one row of a fixed size
    words = base_counts(with_words(docs.select("doc_id", "text"))).withColumn("grams", gram_buckets(buckets))
    n = F.size("grams")
    scored = words.crossJoin(F.broadcast(table)).withColumn("score", F.when(n > 0, F.aggregate(
        "grams", F.lit(0.0), lambda a, b: a + F.get(F.col("ratios"), b)) / n).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                         "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
