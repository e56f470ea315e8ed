"""Relationship discovery, join checks, left joins, and the analysis dataset."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C, names as N
from tallyframe.operators import profiling as P, roles as R

KEEP_SCORE = 70


@dataclass(frozen=True)
class Relationship:
    """table_a.field_a -> table_b.field_b; kind: one_to_one, one_to_many, many_to_one or many_to_many."""

    table_a: str
    field_a: str
    table_b: str
    field_b: str
    kind: str = "many_to_one"
    confidence: float | None = None


# ---- discovery: works on profile rows only -----------------------------------------------------------

def relationship_profile(df: DataFrame, confirmed: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """column, dtype, type_family, mapped_type, distinct_count, unique_ratio, row_count; of some columns, if given."""
    df = df.select(*[C.quoted(c) for c in columns]) if columns is not None else df
    profile = P.pinned(P.column_profile(df))
    mapping = R.infer_field_mapping(df, confirmed, profile).select("column", F.col("confirmed_type").alias("mapped_type"))
    return profile.join(F.broadcast(mapping), "column").select(  # one row per column
        "position", "column", "dtype", F.col("family").alias("type_family"), "mapped_type", "distinct_count",
        P.unique_ratio().alias("unique_ratio"), F.col("total").alias("row_count"))


def connectable_columns(profile: DataFrame) -> DataFrame:
    """column, preference: 1 for id/date columns, 2 for other non-amount columns with nearly unique values."""
    preferred = F.col("mapped_type").isin("id", "date")
    second = (F.col("mapped_type") != "amount") & (F.col("unique_ratio") >= 0.8)
    rank = F.when(preferred, 1).when(second, 2)
    return profile.select("position", "column", rank.alias("preference")).filter("preference IS NOT NULL").orderBy(
        "preference", "position").select("column", "preference")


def name_key(column: str | Column = "column") -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def discover_relationships(profiles: dict[str, DataFrame]) -> DataFrame:
    """Scored column pairs across tables.

    Profiles have one row per column. A pair reaches the threshold only with equal normalised names
    (20 + 20 + 10 points without that), so the pairs come from an equi join on the name.
    """
    rows = reduce(DataFrame.unionByName, [
        p.select(F.lit(i).alias("t"), F.lit(name).alias("table"), "column", "type_family", "mapped_type",
                 "unique_ratio", "row_count", name_key().alias("key"))
        for i, (name, p) in enumerate(profiles.items())])
    rows = P.pinned(rows)
    left = rows.select(F.struct(*rows.columns).alias("l"), "key")
    right = rows.select(F.struct(*rows.columns).alias("r"), "key")
    pairs = left.join(right, "key").filter(F.col("l.t") < F.col("r.t"))
    score = (
        F.lit(50)
        + F.when(F.col("l.mapped_type") == F.col("r.mapped_type"), 20).otherwise(0)
        + F.when(F.col("l.type_family") == F.col("r.type_family"), 20).otherwise(0)
        + F.when(F.abs(F.col("l.unique_ratio") - F.col("r.unique_ratio")) <= 0.2, 10).otherwise(0))
    a_first = F.struct(F.col("l.unique_ratio"), -F.col("l.row_count")) <= F.struct(F.col("r.unique_ratio"), -F.col("r.row_count"))
    scored = pairs.filter((F.col("l.mapped_type") != "amount") & (F.col("r.mapped_type") != "amount")).select(
        F.when(a_first, F.col("l")).otherwise(F.col("r")).alias("a"),
        F.when(a_first, F.col("r")).otherwise(F.col("l")).alias("b"), score.alias("score"))
    advice = F.when(F.col("score") >= 90, "accept").when(F.col("score") >= 75, "check").otherwise("caution")
    return scored.filter(F.col("score") >= KEEP_SCORE).select(
        F.col("a.table").alias("table_a"), F.col("a.column").alias("field_a"), F.col("b.table").alias("table_b"),
        F.col("b.column").alias("field_b"), F.lit("many_to_one").alias("relationship_type"), "score",
        advice.alias("advice")).orderBy(F.desc("score"), "table_a", "field_a", "table_b", "field_b")


def shared_names(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Per table the columns whose normalised name another table has, too; reads no data."""
    named = [(i, j, t, c) for i, (t, df) in enumerate(tables.items()) for j, c in enumerate(P.data_columns(df))]
    if not named:
        return {}
    rows = next(iter(tables.values())).sparkSession.createDataFrame(named, "i int, j int, table string, column string").withColumn("key", name_key())
    several = rows.groupBy("key").agg(F.count_distinct("table").alias("n")).filter("n > 1").select("key")
    out: dict[str, list[str]] = {}
    for r in rows.join(several, "key").orderBy("i", "j").collect():  # names only
        out.setdefault(r["table"], []).append(r["column"])
    return out


def discover_in_tables(tables: dict[str, DataFrame], confirmed: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """discover_relationships on tables: names are matched first, and only columns that occur in two tables are profiled, as no
    other can reach the threshold. A table without such a column is not read."""
    columns = shared_names(tables)
    profiles = {t: relationship_profile(tables[t], (confirmed or {}).get(t), c) for t, c in columns.items()}
    if not profiles:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table_a string, field_a string, table_b string, field_b string, relationship_type string, score int, advice string")
    return discover_relationships(profiles)


# ---- checks before a join ----------------------------------------------------------------------------

STAT_COLUMNS = ("left_rows", "right_rows", "match_rate", "expansion_factor", "left_unique_ratio", "right_unique_ratio")


def join_stats(left: DataFrame, field_a: str, right: DataFrame, field_b: str) -> DataFrame:
    """One row: sizes, match rate over non-null keys, row expansion of the left join, unique ratios.

    Both sides are reduced to one row per key before they meet, so a key holding a third of the rows is one row
    in the shuffle.
    """
    if field_a not in left.columns or field_b not in right.columns:
        sizes = left.agg(F.count(F.lit(1)).alias("left_rows")).withColumn("right_rows", right.agg(F.count(F.lit(1))).scalar())
        zero = {k: F.lit(0.0) for k in STAT_COLUMNS[2:]}
        return sizes.withColumns({**zero, "missing_field": F.lit(True)})
    a = left.groupBy(C.present(left, field_a).alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(C.present(right, field_b).alias("k")).agg(F.count(F.lit(1)).alias("b"))
    if C.dtype_of(left, field_a) != C.dtype_of(right, field_b):
        a, b = a.withColumn("k", F.col("k").cast("string")), b.withColumn("k", F.col("k").cast("string"))
    joined = a.join(b.filter("k IS NOT NULL"), "k", "left")
    keyed = F.col("k").isNotNull()
    sums = joined.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"),
        F.sum(F.when(keyed, F.col("a"))).alias("keyed_rows"),
        F.count(F.when(keyed, F.lit(1))).alias("left_keys"),
        F.sum(F.when(F.col("b").isNotNull(), F.col("a"))).alias("matched"),
        F.sum(F.col("a") * F.coalesce(F.col("b"), F.lit(1))).alias("joined_rows"))
    r = b.agg(F.struct(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows"), F.sum(F.when(keyed, F.col("b"))).alias("keyed"),
        F.count(F.when(keyed, F.lit(1))).alias("keys"))).scalar()
    zero = F.lit(0.0)
    return sums.withColumn("r", r).select(
        "left_rows", F.col("r.rows").alias("right_rows"),
        F.coalesce(F.try_divide(F.coalesce("matched", F.lit(0)), F.col("keyed_rows")), zero).alias("match_rate"),
        F.coalesce(F.try_divide(F.col("joined_rows"), F.col("left_rows")), zero).alias("expansion_factor"),
        F.coalesce(F.try_divide(F.col("left_keys"), F.col("keyed_rows")), zero).alias("left_unique_ratio"),
        F.coalesce(F.try_divide(F.col("r.keys"), F.col("r.keyed")), zero).alias("right_unique_ratio"),
        F.lit(False).alias("missing_field"))


def join_risk(stats: DataFrame, kind: str = "many_to_one") -> DataFrame:
    """Adds risk (low | medium | high) and the reasons, as codes joined by ';'."""
    many = F.lit(kind == "many_to_many")
    exp, match = F.col("expansion_factor"), F.col("match_rate")
    loose_key = F.lit(kind == "many_to_one") & (F.col("right_unique_ratio") < 0.98)
    high = many | (exp > 2) | (match < 0.6)
    medium = (exp > 1.2) | (match < 0.85) | loose_key
    reasons = F.concat_ws(
        ";",
        F.when(many, "many_to_many"),
        F.when(exp > 2, "expansion_over_2").when((exp > 1.2) & ~many, "expansion_over_1_2"),
        F.when(match < 0.6, "match_under_60").when((match < 0.85) & ~many & (exp <= 2), "match_under_85"),
        F.when(loose_key, "right_key_not_unique"))
    return stats.withColumns({
        "risk": F.when(F.col("missing_field"), "high").when(high, "high").when(medium, "medium").otherwise("low"),
        "reasons": F.when(F.col("missing_field"), "missing_field").otherwise(F.when(reasons == "", "ok").otherwise(reasons)),
    })


def join_plan(tables: dict[str, DataFrame], relationships: list[Relationship]) -> DataFrame:
    """One row per relationship with its stats and risk; an unreadable table is a high risk."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for i, rel in enumerate(relationships):
        if rel.table_a in tables and rel.table_b in tables:
            stats = join_stats(tables[rel.table_a], rel.field_a, tables[rel.table_b], rel.field_b)
            part = join_risk(stats, rel.kind)
        else:
            part = spark.range(1).select(
                *[F.lit(0).cast("bigint").alias(c) for c in STAT_COLUMNS[:2]],
                *[F.lit(0.0).alias(c) for c in STAT_COLUMNS[2:]],
                F.lit("high").alias("risk"), F.lit("table_missing").alias("reasons"))
        parts.append(part.select(
            F.lit(i).alias("position"), F.lit(rel.table_a).alias("table_a"), F.lit(rel.field_a).alias("field_a"),
            F.lit(rel.table_b).alias("table_b"), F.lit(rel.field_b).alias("field_b"),
            F.lit(rel.kind).alias("relationship_type"), *STAT_COLUMNS, "risk", "reasons"))
    return reduce(DataFrame.unionByName, parts)


def join_health(plan: DataFrame) -> DataFrame:
    """table_a, table_b, check, risk: one row per finding, or a single ok row."""
    match, exp = F.bround(F.col("match_rate") * 100, 2), F.bround(F.col("expansion_factor"), 2)
    found = F.array(
        F.when(F.col("relationship_type") == "many_to_many", _check("many_to_many", "high")),
        F.when(match < 60, _check("match_rate_too_low", "high")).when(match < 85, _check("match_rate_low", "medium")),
        F.when(exp > 2, _check("row_expansion", "high")).when(exp > 1.2, _check("row_expansion", "medium")))
    rows = plan.select("table_a", "table_b", F.explode(found).alias("c")).filter("c IS NOT NULL").select(
        "table_a", "table_b", "c.check", "c.risk")
    none = plan.sparkSession.range(1).filter(~rows.limit(1).exists()).select(
        F.lit("*").alias("table_a"), F.lit("*").alias("table_b"), F.lit("ok").alias("check"), F.lit("low").alias("risk"))
    return rows.unionByName(none)


def _check(name: str, risk: str) -> Column:
    return F.struct(F.lit(name).alias("check"), F.lit(risk).alias("risk"))


# ---- joins -------------------------------------------------------------------------------------------

def left_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_name: str = "right",
              null_keys_match: bool = False, how: str = "left") -> DataFrame:
    """Equi join; clashing right columns get the suffix __<table>; equal key names keep one key column.

    Missing keys match nothing. ``null_keys_match`` lets them match each other, as data-frame libraries do: then missing keys
    of both sides multiply. Hot keys are split by adaptive skew-join handling; small right tables become broadcasts by their
    measured size.
    """
    if left_on not in left.columns or right_on not in right.columns:
        raise KeyError(f"join key not found: {left_on} or {right_on}")
    suffix = f"__{N.table_suffix(right_name)}"
    same = left_on == right_on
    taken = set(left.columns)
    renamed, key = [], None
    for c in right.columns:
        new = "_right_key" if same and c == right_on else (c + suffix if c in taken else c)
        renamed.append(C.quoted(c).alias(new))
        key = new if c == right_on else key
    r = right.select(*renamed)
    lk, rk = C.quoted(left_on), C.quoted(key)
    if C.is_text(C.dtype_of(left, left_on)) != C.is_text(C.dtype_of(right, right_on)):
        lk, rk = lk.cast("string"), rk.cast("string")
    joined = left.join(r, lk.eqNullSafe(rk) if null_keys_match else lk == rk, how)
    return joined.drop("_right_key") if same else joined


def inner_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_name: str = "right",
               null_keys_match: bool = False) -> DataFrame:
    return left_join(left, right, left_on, right_on, right_name, null_keys_match, "inner")
