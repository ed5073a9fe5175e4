"""Aggregations (A1-A9), ordering and top-k (O1-O3), unions.

Every grouped aggregate is a partial (map-side) + final hash aggregate, so the shuffle carries at
most one row per group and map task — a hot key costs one row per task, not a third of the data.
Money is summed as exact decimals; floating measures are summed as decimal(20,6) so the result does
not depend on the order rows arrive in.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import categorize_messages, safe_divide

EPOCH = dt.datetime(1970, 1, 1)


def exact_sum(c) -> Column:
    """Order-independent sum of a floating column (via decimal(20,6))."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(20,6)")).cast("double")


def rollup_sales(fact: DataFrame, dims: list, qty: str = "ORDER_QTY", value: str = "ORDER_VALUE") -> DataFrame:
    """A1: order lines, total quantity and total value per group."""
    return fact.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("order_lines"),
        F.sum(qty).cast("bigint").alias("total_qty"),
        F.sum(F.col(value).cast("decimal(18,2)")).alias("total_value"))


def count_distinct(c, approx: bool = False, rsd: float = 0.01) -> Column:
    """A2: COUNT DISTINCT; ``approx`` switches to HyperLogLog++ (``approx_count_distinct``), one
    fixed-size sketch per group and task instead of a second shuffle of (group, value) pairs."""
    col = F.col(c) if isinstance(c, str) else c
    return F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)


def ratio_of_sums(n, d) -> Column:
    """A3: SAFE_DIVIDE(SUM(n), SUM(d))."""
    return safe_divide(F.sum(n), F.sum(d))


def null_counts(df: DataFrame, cols: list[str] | None = None, suffix: str = "_nulls") -> DataFrame:
    """A5: one pass, one row: COUNTIF(c IS NULL) per column (plus the row count as ``cnt``)."""
    cols = cols or df.columns
    return df.agg(F.count(F.lit(1)).alias("cnt"),
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}{suffix}") for c in cols])


def high_water_mark(df: DataFrame, col: str, floor: dt.datetime = EPOCH) -> DataFrame:
    """COALESCE(MAX(col), floor) as a one-row DataFrame (``.scalar()`` turns it into a Column)."""
    return df.agg(F.coalesce(F.max(col).cast("timestamp"), F.lit(floor).cast("timestamp")).alias("high_water_mark"))


def duplicate_keys(df: DataFrame, keys: list[str], limit: int | None = 5) -> DataFrame:
    """Key groups with more than one row; ``limit`` samples (ordered by count desc, keys)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)
    if limit is None:
        return g
    return g.orderBy(F.col("cnt").desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(limit)


LESSON_GROUP = ["error_category", "error_message", "fix_description", "context"]


def top_lessons(lessons: DataFrame, n: int = 10, example_chars: int = 200) -> DataFrame:
    """A8 + W3: count identical lessons, keep the ``n`` most frequent, then the first per category.

    Two phases: 128-bit digests of the lessons are counted, and texts are fetched for those alone that can be
    among the first ``n``, so no long text is shuffled to be counted. The digests of more than ``n`` lessons that
    tie at the ``n``-th count cannot tell which come first; then all texts of that count or more are compared.
    """
    # the category has a digest of its own: it may be derived from the text, and is then computed once more for the chosen rows only
    texts = [x for c in LESSON_GROUP[1:] for x in (F.col(c), F.col(c).isNull())]
    category = F.xxhash64(F.col(LESSON_GROUP[0]), F.col(LESSON_GROUP[0]).isNull())
    digest = ["_a", "_b", "_c"]
    keyed = lessons.select(*LESSON_GROUP, F.xxhash64(F.lit(1), *texts).alias("_a"), F.xxhash64(F.lit(2), *texts).alias("_b"), category.alias("_c"))
    counts = keyed.groupBy(*digest).agg(F.count(F.lit(1)).alias("occurrences"))
    head = counts.orderBy(F.col("occurrences").desc()).limit(n + 1).collect()  # n + 1 digests
    tied = len(head) > n and head[n - 1]["occurrences"] == head[n]["occurrences"]
    once = F.first(F.struct(*LESSON_GROUP)).alias("_x")
    if tied:
        g = keyed.groupBy(*digest).agg(F.count(F.lit(1)).alias("occurrences"), once).filter(F.col("occurrences") >= head[n]["occurrences"])
    else:
        first = lessons.sparkSession.createDataFrame([tuple(r) for r in head[:n]], "_a bigint, _b bigint, _c bigint, occurrences bigint")
        chosen = keyed.filter(F.col("_a").isin([r["_a"] for r in head[:n]]))
        g = chosen.join(F.broadcast(first), digest).groupBy(*digest).agg(F.max("occurrences").alias("occurrences"), once)
    g = g.select("_x.*", "occurrences")
    top = g.orderBy(F.col("occurrences").desc(), F.col("error_category").asc_nulls_first(),
                    *[F.col(c).asc_nulls_first() for c in LESSON_GROUP[1:]]).limit(n)
    cat = F.coalesce(F.col("error_category"), F.lit("other"))
    w = Window.partitionBy(cat).orderBy(F.col("occurrences").desc(),
                                        *[F.col(c).asc_nulls_first() for c in LESSON_GROUP[1:]])
    first = top.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return first.select(
        cat.alias("error_pattern"),
        F.coalesce(F.col("fix_description"), F.lit("")).alias("rule"),
        F.substring(F.coalesce(F.col("error_message"), F.lit("")), 1, example_chars).alias("example_error"),
        F.coalesce(F.col("context"), F.lit("execution")).alias("context"),
        F.col("occurrences").cast("bigint").alias("occurrences"))


def lessons_from_messages(df: DataFrame, message: str) -> DataFrame:
    """P19 applied to a log: adds ``error_category``."""
    return df.withColumn("error_category", categorize_messages(F.col(message)))


def run_history(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Per run: steps, successes, failures, total seconds, overall status, newest first."""
    g = runs.groupBy("run_id").agg(
        F.max("run_timestamp").alias("run_timestamp"),
        F.count(F.lit(1)).cast("bigint").alias("steps"),
        F.count_if(F.col("status") == "success").cast("bigint").alias("successes"),
        F.count_if(F.col("status") == "failed").cast("bigint").alias("failures"),
        exact_sum(F.coalesce(F.col("duration_seconds"), F.lit(0.0))).alias("total_duration_seconds"))
    g = g.withColumns({
        "overall_status": F.when(F.col("failures") > 0, "failed").otherwise("success"),
        "run_state": F.when(F.col("successes") == F.col("steps"), "success")
                      .when(F.col("failures") > 0, "failed").otherwise("running"),
    })
    if limit is None:
        return g
    return g.orderBy(F.col("run_timestamp").desc(), F.col("run_id").asc()).limit(limit)


# ---------------------------------------------------------------- ordering and top-k
def sorted_by(df: DataFrame, order: list[Column], tie_break: bool = True) -> DataFrame:
    """O1: ORDER BY with every remaining column as tie-break, so the order is total."""
    names = {c for c in df.columns}
    extra = [F.col(c).asc_nulls_first() for c in sorted(names)] if tie_break else []
    return df.orderBy(*order, *extra)


def top_k(df: DataFrame, order: list[Column], k: int, tie_cols: list[str] | None = None) -> DataFrame:
    """O2: the first ``k`` rows by ``order`` (plan: TakeOrderedAndProject, k rows per task)."""
    ties = [F.col(c).asc_nulls_first() for c in (tie_cols if tie_cols is not None else df.columns)]
    return df.orderBy(*order, *ties).limit(k)


def recent_runs(df: DataFrame, n: int, table: str | None = None, table_col: str = "target_table",
                ts_col: str = "created_at", id_col: str | None = None) -> DataFrame:
    """O3: the newest ``n`` log rows, optionally for one table (the filter is pushed to the scan)."""
    if table:
        df = df.filter(F.col(table_col) == table)
    ties = [F.col(id_col).asc()] if id_col else [F.col(c).asc_nulls_first() for c in df.columns if c != ts_col]
    return df.orderBy(F.col(ts_col).desc_nulls_last(), *ties).limit(n)


def union_labelled(frames: dict[str, DataFrame], label: str = "table_name") -> DataFrame:
    """UNION ALL of frames with a label column, by column name."""
    parts = [df.select(F.lit(name).alias(label), *df.columns) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_counts(frames: dict[str, DataFrame | None], label: str = "table_name") -> DataFrame:
    """Labelled row counts, sorted by name; a missing table is reported as NOT FOUND (count NULL)."""
    present = {k: v for k, v in frames.items() if v is not None}
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
             .select(F.lit(name).alias(label), "row_count", F.lit("OK").alias("status"))
             for name, df in present.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    missing = [k for k, v in frames.items() if v is None]
    if missing:
        spark = u.sparkSession
        miss = spark.createDataFrame([(m, None, "NOT FOUND") for m in missing],
                                     f"{label} string, row_count bigint, status string")
        u = u.unionByName(miss)
    return u.orderBy(label)


def combine_marts(frames: list[DataFrame], group_by: list[str] | None = None,
                  aggs: list[Column] | None = None) -> DataFrame:
    """BL → BL: union marts by column name (missing columns NULL), optionally re-aggregate."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if group_by is None:
        return u
    return u.groupBy(*group_by).agg(*aggs)
