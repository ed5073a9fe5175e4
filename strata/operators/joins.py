"""Joins (J1-J8). Physical strategy is Catalyst's and AQE's: a side is broadcast only when it is
bounded by construction (a literal list, a spine, one row per nation) or when its *measured* size
after a shuffle stage is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the join
stays a shuffle (sort-merge) join and AQE splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_dim(fact: DataFrame, dim: DataFrame, key) -> DataFrame:
    """Fact ⋈ dimension on the surrogate key (inner)."""
    return fact.join(dim, _keys(key), "inner")


def enrich(fact: DataFrame, dim: DataFrame, key, cols: list[str]) -> DataFrame:
    """Left lookup of ``cols`` from a dimension that is unique on ``key``."""
    k = _keys(key)
    return fact.join(dim.select(*k, *[c for c in cols if c not in k]), k, "left")


def join_facts_raw(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Row-level left join of two facts on several keys (many-to-many: sums over it fan out, T3)."""
    return a.join(b, _keys(keys), "left")


def drill_across(parts: list[tuple[DataFrame, list[Column]]], grain: list[str]) -> DataFrame:
    """Aggregate every fact to the shared grain first, then FULL OUTER JOIN on the grain.

    ``join(..., on=[names], how="full_outer")`` coalesces the grain columns (USING semantics), so a
    grain value present on one side only keeps its value. Each side is pre-aggregated with a partial
    (map-side) aggregate, so only one row per grain value and map task is shuffled.
    """
    aggs = [df.groupBy(*grain).agg(*measures) for df, measures in parts]
    return reduce(lambda l, r: l.join(r, grain, "full_outer"), aggs)


def grain_left_join(owner: DataFrame, others: list[DataFrame], grain: list[str]) -> DataFrame:
    """The table that defines the grain stays on the left; others are left-joined on it."""
    return reduce(lambda l, r: l.join(r, grain, "left"), others, owner)


def interval_join(df: DataFrame, hist: DataFrame, key, date_col: str, row_keys: list[str],
                  value_cols: list[str], eff: str = "EFFECTIVE_DATE", exp: str = "EXPIRY_DATE",
                  how: str = "left") -> DataFrame:
    """Attach the ``hist`` row valid on ``df.date_col`` (eff ≤ date ≤ exp); latest effective wins, equal
    effective dates are decided by the later expiry and then by the smallest attached values.

    The history becomes one row per key: its intervals as an array in order of validity. Each row of
    ``df`` looks its date up in the array of its key, so ``df`` is shuffled by the key once and no row is
    multiplied. The arrays are never broadcast: the plan's estimate counts neither the intervals that an explode
    made nor those that an array holds, and took hundreds of MB for less than 10. The last interval of the
    array that began by the date and has not ended is the one. ``row_keys`` (what identifies a row of ``df``) is not needed
    for it and kept for callers.
    """
    k = _keys(key)
    # of intervals with the same ends the smallest values count; then (eff, exp) orders a key's intervals
    once = (hist.filter(F.col(eff).isNotNull() & F.col(exp).isNotNull()).groupBy(*k, F.col(eff).alias("_eff"), F.col(exp).alias("_exp"))
            .agg(F.min(F.struct(*value_cols)).alias("_values")))
    arrays = once.groupBy(*[F.col(c).alias(f"_h_{c}") for c in k]).agg(
        F.array_sort(F.collect_list(F.struct("_eff", "_exp", "_values"))).alias("_intervals"))
    j = df.join(arrays.hint("merge"), reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_h_{c}") for c in k]), "left")
    day = F.col(date_col)
    valid = F.filter("_intervals", lambda x: (x["_eff"] <= day) & (x["_exp"] >= day))
    j = j.withColumn("_valid", F.try_element_at(valid, F.lit(-1)))
    if how == "inner":
        j = j.filter(F.col("_valid").isNotNull())
    return j.select(*[F.col(c) for c in df.columns], *[F.col(f"_valid._values.{c}").alias(c) for c in value_cols])


def month_join(left: DataFrame, right: DataFrame, keys, left_date: str, right_date: str,
               how: str = "left", month_col: str = "_MONTH") -> DataFrame:
    """Join on keys and on the month of two dates, as an equi join on ``trunc(date, 'MM')``."""
    k = _keys(keys)
    l = left.withColumn(month_col, F.trunc(F.col(left_date), "MM"))
    r = right.withColumn(month_col, F.trunc(F.col(right_date), "MM"))
    if right_date in l.columns and right_date != left_date:
        r = r.drop(right_date)
    return l.join(r, k + [month_col], how).drop(month_col)


def missing_members(expected: DataFrame, actual: DataFrame, key) -> DataFrame:
    """Members of ``expected`` absent from ``actual`` (null-safe NOT IN = left anti join)."""
    return expected.join(actual.select(*_keys(key)).distinct(), _keys(key), "left_anti")
