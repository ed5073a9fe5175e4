"""Date spines and planning grids.

Bounds are Columns, usually scalar subqueries over the data (``df.select(F.min(c)).scalar()``), so a
spine follows the data without a driver round trip and without a cross join. A spine is bounded by
its date range (days, weeks, months), never by the size of a fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import calendar_key, fingerprint64


def _lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1)


def date_spine(spark: SparkSession, start, end, name: str = "d") -> DataFrame:
    """One row per day from ``start`` to ``end`` inclusive."""
    return _one_row(spark).select(
        F.explode(F.sequence(_lit_or_col(start).cast("date"), _lit_or_col(end).cast("date"))).alias(name))


def weekly_calendar(spark: SparkSession, start, end) -> DataFrame:
    """Monday-start weeks from the first Monday on or after ``start`` through ``end``.

    The running week number is the reference's own arithmetic (T9): the week index counted from
    the first week, minus 52 for every year after the first one, so a 53-Monday year shifts the next.
    """
    s = _lit_or_col(start).cast("date")
    first_monday = F.date_add(s, ((F.lit(9) - F.dayofweek(s)) % 7).cast("int"))
    weeks = _one_row(spark).select(
        F.posexplode(F.sequence(first_monday, _lit_or_col(end).cast("date"), F.expr("interval 7 days")))
        .alias("i", "WEEK_START_DATE"),
        F.year(first_monday).alias("_y0"))
    ws = F.col("WEEK_START_DATE")
    return weeks.select(
        fingerprint64(F.concat(F.year(ws).cast("string"), ws.cast("string"))).alias("KEY_CALENDAR"),
        ws,
        F.date_add(ws, 6).alias("WEEK_END_DATE"),
        F.year(ws).cast("bigint").alias("YEAR"),
        F.month(ws).cast("bigint").alias("MONTH"),
        F.quarter(ws).cast("bigint").alias("QUARTER"),
        (F.col("i") + 1 - F.lit(52) * (F.year(ws) - F.col("_y0"))).cast("bigint").alias("WEEK_OF_YEAR"),
        F.year(ws).cast("bigint").alias("FISCAL_YEAR"),
    )


def month_end_snapshots(spark: SparkSession, start, end, name: str = "AS_OF_DATE") -> DataFrame:
    """D3: the last day of every month between ``start`` and ``end``."""
    months = F.sequence(F.trunc(_lit_or_col(start).cast("date"), "MM"),
                        F.trunc(_lit_or_col(end).cast("date"), "MM"), F.expr("interval 1 month"))
    return _one_row(spark).select(F.explode(months).alias("_m")).select(F.last_day("_m").alias(name))


def forecast_horizon(df: DataFrame, snap_col: str, k: int, step_days: int = 30, stop_year=None,
                     by_month: bool = False, out: str = "FORECAST_DATE") -> DataFrame:
    """``k`` forecast months per snapshot: snapshot + step·i days (or i months), floored to the month
    start; steps past ``stop_year`` are dropped (T10: 30-day steps can skip or repeat a month)."""
    off = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_step")
    x = df.select("*", off)
    raw = (F.add_months(F.col(snap_col), F.col("_step")) if by_month
           else F.date_add(F.col(snap_col), (F.col("_step") * step_days).cast("int")))
    x = x.withColumn("_fm", raw)
    if stop_year is not None:
        x = x.filter(F.year("_fm") <= _lit_or_col(stop_year))
    return x.withColumn(out, F.trunc("_fm", "MM")).drop("_fm")


# Seasonal uplift rules of the forecasts (months, factor).
DEMAND_SEASONALITY = (((10, 11, 12), 1.8), ((6, 7), 1.3))
SALES_SEASONALITY = (((10, 11, 12), 2.0),)


def seasonal_uplift(qty, month, rules: Sequence = DEMAND_SEASONALITY) -> Column:
    """Quantity × factor of the first matching month rule, truncated to an integer."""
    q, m = _lit_or_col(qty) if not isinstance(qty, str) else F.col(qty), (
        F.col(month) if isinstance(month, str) else month)
    expr = None
    for months, factor in rules:
        val = (q.cast("double") * F.lit(factor)).cast("bigint")
        expr = F.when(m.isin(*months), val) if expr is None else expr.when(m.isin(*months), val)
    return expr.otherwise(q.cast("bigint")) if expr is not None else q.cast("bigint")


def yearly_intervals(df: DataFrame, first_year, last_year, types: Sequence[str],
                     type_col: str) -> DataFrame:
    """One validity interval per row, year and type: [Jan 1, Dec 31] of each year."""
    years = F.sequence(_lit_or_col(first_year), _lit_or_col(last_year))
    x = df.select("*", F.explode(years).alias("_yr"))
    x = x.select("*", F.explode(F.array(*[F.lit(t) for t in types])).alias(type_col))
    return (x.withColumn("EFFECTIVE_DATE", F.make_date(F.col("_yr"), F.lit(1), F.lit(1)))
             .withColumn("EXPIRY_DATE", F.make_date(F.col("_yr"), F.lit(12), F.lit(31)))
             .drop("_yr"))


def planning_grid(members: DataFrame, start, end, month_col: str = "PLAN_MONTH") -> DataFrame:
    """Every member row × every month start between ``start`` and ``end``.

    The month list is bounded by the date range, so this is a bounded per-row fan-out (explode),
    not a cross join of two data-sized tables.
    """
    months = F.sequence(F.trunc(_lit_or_col(start).cast("date"), "MM"),
                        F.trunc(_lit_or_col(end).cast("date"), "MM"), F.expr("interval 1 month"))
    return members.select("*", F.explode(months).alias(month_col))


def calendar_dim(spark: SparkSession, start, end) -> DataFrame:
    """Daily calendar rows (C5 source): key, date, parts, ISO week, weekday (1 = Sunday), weekend."""
    d = F.col("CALENDAR_DATE")
    return date_spine(spark, start, end, "CALENDAR_DATE").select(
        calendar_key(d).alias("KEY_CALENDAR"), d,
        F.year(d).cast("bigint").alias("YEAR"), F.month(d).cast("bigint").alias("MONTH"),
        F.quarter(d).cast("bigint").alias("QUARTER"), F.weekofyear(d).cast("bigint").alias("WEEK_OF_YEAR"),
        F.dayofweek(d).cast("bigint").alias("DAY_OF_WEEK"), F.dayofweek(d).isin(1, 7).alias("IS_WEEKEND"))
