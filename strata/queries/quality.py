"""D1-D6 spines, DQ1-DQ8 checks, S8/S9/S11 table utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as O
from ..operators import dq as Q
from ..operators import spines as D
from ..registry import register
from ..sources import schemas as S
from ..sources import store
from ..sources.testdata import read_table

_OL_BOUNDS = ("(SELECT min(TRANSACTION_DATE) FROM raw_order_line)", "(SELECT max(TRANSACTION_DATE) FROM raw_order_line)")


def _bounds(ctx):
    ol = ctx.raw["raw_order_line"]
    both = ol.agg(F.struct(F.min("TRANSACTION_DATE").alias("lo"), F.max("TRANSACTION_DATE").alias("hi")).alias("r")).scalar()
    return both["lo"], both["hi"]


@register("d1_date_spine", O.sql(f"""
SELECT cast(cast(unnest(generate_series({_OL_BOUNDS[0]}, {_OL_BOUNDS[1]}, INTERVAL 1 DAY)) as date) as varchar) d""",
                                 "raw_order_line"))
def d1(ctx):
    """One row per day between the first and the last transaction date."""
    return D.date_spine(ctx.spark, *_bounds(ctx))


@register("d2_weekly_calendar", O.sql(f"""
SELECT {O.fp("(cast(year(ws) as varchar) || cast(ws as varchar))")} KEY_CALENDAR, cast(ws as varchar) WEEK_START_DATE,
       cast(ws + 6 as varchar) WEEK_END_DATE, cast(year(ws) as bigint) AS "YEAR", cast(month(ws) as bigint) AS "MONTH",
       cast(quarter(ws) as bigint) AS "QUARTER", cast(i + 1 - 52 * (year(ws) - y0) as bigint) WEEK_OF_YEAR,
       cast(year(ws) as bigint) FISCAL_YEAR
FROM (SELECT cast(fm + INTERVAL (7 * i) DAY as date) ws, i, year(fm) y0
      FROM (SELECT fm, unnest(range(0, cast((date_diff('day', fm, e) / 7) as bigint) + 1)) i FROM (
              SELECT s + cast((9 - (dayofweek(s) + 1)) % 7 as integer) fm, e FROM (
                SELECT {_OL_BOUNDS[0]} s, {_OL_BOUNDS[1]} e) b) b2) b3) w""", "raw_order_line"))
def d2(ctx):
    """Monday-start weekly calendar with the running week arithmetic."""
    return D.weekly_calendar(ctx.spark, *_bounds(ctx))


@register("d3_month_end_snapshots", O.sql(f"""
SELECT cast(last_day(cast(unnest(generate_series(date_trunc('month', {_OL_BOUNDS[0]}), date_trunc('month', {_OL_BOUNDS[1]}),
       INTERVAL 1 MONTH)) as date)) as varchar) AS_OF_DATE""", "raw_order_line"))
def d3(ctx):
    """D3: month-end snapshot dates."""
    return D.month_end_snapshots(ctx.spark, *_bounds(ctx))


@register("d4_forecast_horizon", O.sql(f"""
SELECT cast(AS_OF_DATE as varchar) AS_OF_DATE, cast(k as bigint) "_step",
       cast(date_trunc('month', AS_OF_DATE + cast(30 * k as integer)) as date)::varchar FORECAST_DATE
FROM (SELECT cast(last_day(cast(unnest(generate_series(date_trunc('month', {_OL_BOUNDS[0]}),
        date_trunc('month', {_OL_BOUNDS[1]}), INTERVAL 1 MONTH)) as date)) as date) AS_OF_DATE) s,
     (SELECT unnest(range(0, 12)) k) ks
WHERE year(AS_OF_DATE + cast(30 * k as integer)) <= year({_OL_BOUNDS[1]})""", "raw_order_line"))
def d4(ctx):
    """12 forecast months per snapshot in 30-day steps, floored to month start, stopped at the last year."""
    lo, hi = _bounds(ctx)
    snaps = D.month_end_snapshots(ctx.spark, lo, hi)
    out = D.forecast_horizon(snaps, "AS_OF_DATE", 12, 30, stop_year=F.year(hi))
    return out.withColumn("_step", F.col("_step").cast("bigint"))


@register("d5_seasonal_uplift", O.sql("""
SELECT FORECAST_ID, case when month(FORECAST_DATE) IN (10, 11, 12) then cast(trunc(DEMAND_PLAN_QTY * 1.8) as bigint)
                         when month(FORECAST_DATE) IN (6, 7) then cast(trunc(DEMAND_PLAN_QTY * 1.3) as bigint)
                         else DEMAND_PLAN_QTY end UPLIFTED_QTY
FROM raw_demand_forecast""", "raw_demand_forecast"))
def d5(ctx):
    """Seasonal uplift ×1.8 in Q4, ×1.3 in June-July, truncated to an integer."""
    r = ctx.raw["raw_demand_forecast"]
    return r.select("FORECAST_ID", D.seasonal_uplift(F.col("DEMAND_PLAN_QTY"), F.month("FORECAST_DATE")).alias(
        "UPLIFTED_QTY"))


@register("d6_yearly_intervals", O.sql("""
SELECT TOY_NO, DASH_CODE, PRICE_TYPE, cast(EFFECTIVE_DATE as varchar) EFFECTIVE_DATE, cast(EXPIRY_DATE as varchar) EXPIRY_DATE
FROM raw_price""", "raw_price"))
def d6(ctx):
    """Yearly validity intervals per product and price type (the grid under raw_price)."""
    return ctx.raw["raw_price"].select("TOY_NO", "DASH_CODE", "PRICE_TYPE", "EFFECTIVE_DATE", "EXPIRY_DATE")


# ---------------------------------------------------------------- data quality
@register("dq1_schema_check", O.sql("""
SELECT 'KEY_CALENDAR' column_name, 'missing' issue, 'bigint' expected_type, NULL actual_type, count(*) table_rows FROM cdl_fact_sales
UNION ALL SELECT 'ORDER_QTY', 'type_drift', 'bigint', 'int', count(*) FROM cdl_fact_sales""", "cdl_fact_sales"))
def dq1(ctx):
    """DQ1: expected columns missing from a written table, and type drift, with the rows they concern."""
    import os
    import uuid

    from ..session import scratch_root
    path = os.path.join(scratch_root(ctx.spark), f"dq1-{uuid.uuid4().hex}")
    store.full_refresh(ctx.cdl["cdl_fact_sales"].drop("KEY_CALENDAR").withColumn("ORDER_QTY", F.col("ORDER_QTY").cast("int")), path)
    df = store.read_table(ctx.spark, path)
    rows = df.agg(F.count(F.lit(1)).alias("table_rows")).scalar()
    return Q.schema_check(df, S.CDL_FACT_SALES).withColumn("table_rows", rows)


@register("dq2_row_count_check", O.sql("SELECT count(*) cnt FROM cdl_fact_sales", "cdl_fact_sales"))
def dq2(ctx):
    """DQ2: row count."""
    return Q.row_count_check(ctx.cdl["cdl_fact_sales"])


@register("dq3_duplicate_check", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO, cnt FROM (SELECT ORDER_ID, ORDER_LINE_NO, count(*) cnt FROM raw_order_line
GROUP BY ALL HAVING count(*) > 1) d ORDER BY cnt DESC, ORDER_ID, ORDER_LINE_NO LIMIT 5""", "raw_order_line"))
def dq3(ctx):
    """DQ3: duplicate composite keys (five samples, as the reference reports)."""
    return Q.duplicate_check(ctx.raw["raw_order_line"], ["ORDER_ID", "ORDER_LINE_NO"], 5)


@register("dq3b_duplicate_count", O.sql("""
SELECT count(*) duplicate_groups, cast(coalesce(sum(cnt), 0) as bigint) duplicate_rows FROM (
  SELECT ORDER_ID, ORDER_LINE_NO, count(*) cnt FROM raw_order_line GROUP BY ALL HAVING count(*) > 1) d""",
                                        "raw_order_line"))
def dq3b(ctx):
    """DQ3: the true number of duplicated keys and rows."""
    return Q.duplicate_count(ctx.raw["raw_order_line"], ["ORDER_ID", "ORDER_LINE_NO"])


_J3 = """(SELECT s.ORDER_ID, s.ORDER_LINE_NO, s.ORDER_QTY, r.RETURN_ID, r.RETURN_QTY FROM cdl_fact_sales s
LEFT JOIN cdl_fact_returns r ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.ORDER_ID = r.ORDER_ID) j"""


@register("dq4_null_check", O.sql(f"""
SELECT column_name, nulls FROM (SELECT 'ORDER_ID' column_name, cast(count_if(ORDER_ID IS NULL) as bigint) nulls FROM {_J3}
UNION ALL SELECT 'ORDER_LINE_NO', cast(count_if(ORDER_LINE_NO IS NULL) as bigint) FROM {_J3}
UNION ALL SELECT 'ORDER_QTY', cast(count_if(ORDER_QTY IS NULL) as bigint) FROM {_J3}
UNION ALL SELECT 'RETURN_ID', cast(count_if(RETURN_ID IS NULL) as bigint) FROM {_J3}
UNION ALL SELECT 'RETURN_QTY', cast(count_if(RETURN_QTY IS NULL) as bigint) FROM {_J3}) u""", "cdl_fact_sales", "cdl_fact_returns"))
def dq4(ctx):
    """DQ4: NULL count per column, unpivoted."""
    from .relational import j3
    return Q.null_check(j3(ctx))


_DQ6 = """
SELECT check_name, expected, 'error' severity, violations, detail,
       case when expected IN ('0_rows', 'all_zero') and violations = 0 then 'pass'
            when expected = 'gt_zero' and violations > 0 then 'pass'
            when expected IN ('informational') then 'pass' else 'fail' end status FROM (
  SELECT 'schema_check' check_name, '0_rows' expected, cast(0 as bigint) violations, '0 missing, 0 drifted' detail
  UNION ALL SELECT 'row_count_check', 'gt_zero', count(*), cast(count(*) as varchar) || ' rows' FROM b1_mart
  UNION ALL SELECT 'null_check', 'all_zero', cast(0 as bigint), 'No NULLs found'
  UNION ALL SELECT 'duplicate_check', '0_rows', count(*), cast(count(*) as varchar) || ' duplicated keys, '
                   || cast(coalesce(sum(cnt), 0) as varchar) || ' rows'
            FROM (SELECT KEY_CALENDAR, KEY_PRODUCT, KEY_COMPANY, KEY_CUSTOMER, KEY_SELLING_METHOD, count(*) cnt
                  FROM b1_mart GROUP BY ALL HAVING count(*) > 1) d) r"""
_DQ6_KEYS = ["KEY_CALENDAR", "KEY_PRODUCT", "KEY_COMPANY", "KEY_CUSTOMER", "KEY_SELLING_METHOD"]


@register("dq6_run_suite", O.sql(_DQ6, "b1_mart"))
def dq6(ctx):
    """DQ5 + DQ6: the four-check suite on the sales summary mart, verdicts evaluated."""
    from .marts import b1
    return Q.run_suite(b1(ctx), _DQ6_KEYS, S.FACT_SALES_SUMMARY)


@register("dq6b_stored_suite", O.sql(_DQ6, "b1_mart"))
def dq6b(ctx):
    """DQ6 on a growing mart: the months before 1997 land and are profiled, then all from July 1996 on is merged; the
    second suite reads the months written since and adds them to the kept profiles."""
    import os
    import uuid

    from ..operators.merge import merge_upsert
    from ..plans.profiles import refresh_profile, stored_suite
    from ..session import frozen, scratch_root
    from ..sources import store
    from .marts import b1
    root = os.path.join(scratch_root(ctx.spark), f"profiled-{uuid.uuid4().hex}")
    path, state = os.path.join(root, "mart"), os.path.join(root, "profile")
    ctx.keep(ctx.cdl, "cdl_fact_sales")
    mart = frozen(b1(ctx).withColumn("LOAD_MONTH", F.trunc("TRANSACTION_DATE", "MM")), "mart")
    ctx.forget("cdl_fact_sales")
    data = [c for c in mart.columns if c not in _DQ6_KEYS]

    def land(rows):
        store.merge_partitions(ctx.spark, path, rows, "LOAD_MONTH", _DQ6_KEYS,
                               lambda held, new: merge_upsert(held, new, _DQ6_KEYS, data, stamp_col=None, null_safe=True, unique_source=True))

    land(mart.filter(F.col("TRANSACTION_DATE") < F.lit("1997-01-01").cast("date")))
    refresh_profile(ctx.spark, path, state, _DQ6_KEYS)
    land(mart.filter(F.col("TRANSACTION_DATE") >= F.lit("1996-07-01").cast("date")))
    return stored_suite(ctx.spark, path, state, _DQ6_KEYS, S.FACT_SALES_SUMMARY)


@register("dq7_flag_errors", O.sql(f"""
SELECT ORDER_ID, ORDER_LINE_NO, true ADMIN_ISERROR FROM {_J3} WHERE RETURN_ID IS NULL""",
                                   "cdl_fact_sales", "cdl_fact_returns"))
def dq7(ctx):
    """DQ7: rows whose required columns are NULL are flagged and split off (the rejected side)."""
    from .relational import j3
    _, rejected = Q.flag_errors(j3(ctx), ["RETURN_ID"])
    return rejected.select("ORDER_ID", "ORDER_LINE_NO", "ADMIN_ISERROR")


@register("dq8_source_coverage", O.sql("""
SELECT count(*) missing_keys FROM (SELECT DISTINCT KEY_PRODUCT FROM cdl_fact_product_price) p
WHERE KEY_PRODUCT NOT IN (SELECT KEY_PRODUCT FROM b1_mart)""", "cdl_fact_product_price", "b1_mart"))
def dq8(ctx):
    """DQ8: priced products missing from the sales summary mart."""
    from .marts import b1
    return Q.source_coverage(ctx.cdl["cdl_fact_product_price"], b1(ctx), ["KEY_PRODUCT"])


# the conformed fact of a landing that lost its newest day: the RAW keys that it lacks
_LOST = "LOAD_DATE < (SELECT max(LOAD_DATE) FROM raw_order_line) - INTERVAL 3 DAY"
_LACKING = f"""
SELECT DISTINCT ORDER_ID, ORDER_LINE_NO FROM raw_order_line
EXCEPT SELECT ORDER_ID, ORDER_LINE_NO FROM raw_order_line WHERE {_LOST}"""


def _lacking(ctx):
    raw = ctx.raw["raw_order_line"]
    newest = raw.agg(F.max("LOAD_DATE")).scalar()
    landed = raw.filter(F.col("LOAD_DATE") < newest - F.expr("INTERVAL 3 DAYS"))
    return Q.missing_keys(raw, landed, ["ORDER_ID", "ORDER_LINE_NO"])


@register("j8b_reconcile_keys", O.sql(_LACKING, "raw_order_line"))
def j8b(ctx):
    """J8 by reconciliation: order lines that a landing without its last days lacks, found by comparing digests
    of key buckets and then the keys of the unequal buckets."""
    return _lacking(ctx)


@register("dq8b_reconcile_coverage", O.sql(f"""
SELECT count(*) missing_keys, count(DISTINCT ORDER_ID) missing_orders FROM ({_LACKING}) x""", "raw_order_line"))
def dq8b(ctx):
    """DQ8 by reconciliation: how many order lines and orders the landing lacks."""
    return _lacking(ctx).agg(F.count(F.lit(1)).alias("missing_keys"), F.count_distinct("ORDER_ID").alias("missing_orders"))


# ---------------------------------------------------------------- table utilities
@register("s8_preview", O.sql(f"""
SELECT {O.render(S.RAW_ORDER_LINE)} FROM raw_order_line
ORDER BY ORDER_ID, ORDER_LINE_NO, LOAD_DATE DESC, TOY_NO, ORDER_QTY, DISCOUNT_PCT LIMIT 10""", "raw_order_line"))
def s8(ctx):
    """Ten rows of a table, in a stated order."""
    return store.preview(ctx.raw["raw_order_line"], 10, [F.col("ORDER_ID"), F.col("ORDER_LINE_NO"),
                                                          F.col("LOAD_DATE").desc(), F.col("TOY_NO"),
                                                          F.col("ORDER_QTY"), F.col("DISCOUNT_PCT")])


_RAW_NAMES = ["raw_company", "raw_cost", "raw_customer", "raw_demand_forecast", "raw_order_line", "raw_price",
              "raw_product", "raw_return", "raw_sales_forecast"]


@register("s9_table_counts", O.sql(
    "SELECT table_name, row_count, status FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' table_name, count(*) row_count, 'OK' status FROM {t}" for t in _RAW_NAMES)
    + " UNION ALL SELECT 'raw_missing', NULL, 'NOT FOUND') u", *_RAW_NAMES))
def s9(ctx):
    """Labelled row counts of the RAW tables, sorted by name; a missing table says NOT FOUND."""
    from ..operators.aggs import table_counts
    frames = {t: ctx.raw[t] for t in _RAW_NAMES}
    frames["raw_missing"] = None
    return table_counts(frames)


@register("s11_infer_column_types", O.sql("""
SELECT column_name, inferred_type FROM (
  SELECT 'ORDER_LINE_NO' column_name, case when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) then 'INT64'
    else 'STRING' end inferred_type FROM (SELECT cast(ORDER_LINE_NO as varchar) v FROM raw_order_line) x
  UNION ALL SELECT 'LIST_PRICE', case when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) then 'INT64'
    when bool_and(TRY_CAST(v AS decimal(38,9)) IS NOT NULL) then 'NUMERIC' else 'STRING' end
    FROM (SELECT cast(LIST_PRICE as varchar) v FROM raw_order_line) x
  UNION ALL SELECT 'TRANSACTION_DATE', case when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) then 'INT64'
    when bool_and(TRY_CAST(v AS decimal(38,9)) IS NOT NULL) then 'NUMERIC'
    when bool_and(TRY_CAST(v AS date) IS NOT NULL) then 'DATE' else 'STRING' end
    FROM (SELECT cast(TRANSACTION_DATE as varchar) v FROM raw_order_line) x
  UNION ALL SELECT 'ORDER_ID', case when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) then 'INT64'
    when bool_and(TRY_CAST(v AS decimal(38,9)) IS NOT NULL) then 'NUMERIC'
    when bool_and(TRY_CAST(v AS date) IS NOT NULL) then 'DATE' else 'STRING' end
    FROM (SELECT ORDER_ID v FROM raw_order_line) x) u""", "raw_order_line"))
def s11(ctx):
    """Infer INT64 / NUMERIC / DATE / STRING for loosely typed (text) columns over the whole column."""
    ol = ctx.raw["raw_order_line"]
    text = ol.select(*[F.col(c).cast("string").alias(c) for c in ["ORDER_LINE_NO", "LIST_PRICE", "TRANSACTION_DATE",
                                                                   "ORDER_ID"]])
    return store.infer_column_types(text, ["ORDER_LINE_NO", "LIST_PRICE", "TRANSACTION_DATE", "ORDER_ID"],
                                    with_timestamp=False)
