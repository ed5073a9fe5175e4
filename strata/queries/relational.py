"""F1-F6 filters, J1-J9 joins, A1-A9 aggregates, W1-W4 windows, O1-O3 ordering, U1-U3 unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as O
from ..operators import aggs as A
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import spines as D
from ..operators import windows as W
from ..registry import register
from ..sources import schemas as S
from .scalars import _categorize_sql as categorize_sql
from ..sources.testdata import pipeline_artifacts, pipeline_lessons, pipeline_runs

_ART = """SELECT cast(event_id as varchar) artifact_id, 'mart_' || cast(user_id as varchar) || '.yaml' filename,
       'mart_' || cast(user_id as varchar) target_table, props yaml_content, event_id % 5 version,
       case event_type when 'purchase' then 'passed' when 'click' then 'executed' when 'view' then 'testing'
            when 'signup' then 'generated' else 'failed' end status,
       case when event_type = 'error' then props end error_message, event_id % 5 attempt_number,
       ts created_at, ts updated_at, event_type FROM events"""
O.cte("artifacts", _ART)
O.cte("runs", """SELECT cast(user_id as varchar) run_id, ts run_timestamp, event_type step,
       'table_' || cast(event_id % 7 as varchar) table_name,
       case when event_type = 'error' then 'failed' else 'success' end status, event_id rows_affected,
       value duration_seconds, case when event_type = 'error' then props end error_message, ts created_at FROM events""")
_AS_OF = "(SELECT max(cast(o_orderdate as date)) FROM orders)"


def _as_of(ctx):
    from .marts import as_of_latest_order
    return as_of_latest_order(ctx)


# ---------------------------------------------------------------- filters
@register("f1_active_rows", O.sql("""
SELECT artifact_id, status FROM (SELECT *, case event_type when 'error' then true when 'view' then NULL else false end
  ADMIN_ISDELETED FROM artifacts) a WHERE NOT coalesce(ADMIN_ISDELETED, false)""", "artifacts"))
def f1(ctx):
    """soft-delete filter (FALSE or NULL kept); errors are flagged deleted, views unknown."""
    a = pipeline_artifacts(ctx.spark, ctx.sf_dir).withColumn(
        "ADMIN_ISDELETED", F.when(F.col("status") == "failed", True).when(F.col("status") == "testing", None)
        .otherwise(False))
    return FL.active_rows(a).select("artifact_id", "status")


@register("f2_valid_at", O.sql(f"""
SELECT TOY_NO, DASH_CODE, cast(PRICE as varchar) PRICE, cast(EFFECTIVE_DATE as varchar) EFFECTIVE_DATE
FROM cdl_fact_product_price WHERE PRICE_TYPE = 'LIST' AND {_AS_OF} BETWEEN EFFECTIVE_DATE AND EXPIRY_DATE""",
                                "cdl_fact_product_price", "cdl_fact_sales"))
def f2(ctx):
    """validity filter: type = LIST and the as-of date within [effective, expiry]."""
    v = FL.valid_at(ctx.cdl["cdl_fact_product_price"], _as_of(ctx), "PRICE_TYPE", "LIST")
    return v.select("TOY_NO", "DASH_CODE", "PRICE", "EFFECTIVE_DATE")


@register("f3_filter_in", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO, SELLING_METHOD_CODE FROM cdl_fact_sales WHERE SELLING_METHOD_CODE IN ('100', '300')""",
                                "cdl_fact_sales"))
def f3(ctx):
    """IN-list filter (pushed down as an In predicate)."""
    return FL.filter_in(ctx.cdl["cdl_fact_sales"], "SELLING_METHOD_CODE", ["100", "300"]).select(
        "ORDER_ID", "ORDER_LINE_NO", "SELLING_METHOD_CODE")


@register("f3b_filter_in_frame", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO, TOY_NO FROM cdl_fact_sales
WHERE KEY_PRODUCT IN (SELECT KEY_PRODUCT FROM cdl_dim_product WHERE BRAND IN ('Brand#13', 'Brand#42'))""",
                                       "cdl_fact_sales", "cdl_dim_product"))
def f3b(ctx):
    """a value list given as a DataFrame becomes a left-semi join."""
    vals = ctx.cdl["cdl_dim_product"].filter(F.col("BRAND").isin("Brand#13", "Brand#42")).select("KEY_PRODUCT")
    return FL.filter_in(ctx.cdl["cdl_fact_sales"], "KEY_PRODUCT", vals).select("ORDER_ID", "ORDER_LINE_NO", "TOY_NO")


@register("f4_require_grain", O.sql("""
SELECT s.ORDER_ID, s.ORDER_LINE_NO, r.RETURN_ID FROM cdl_fact_sales s
LEFT JOIN cdl_fact_returns r ON s.ORDER_ID = r.ORDER_ID AND s.ORDER_LINE_NO = r.ORDER_LINE_NO
WHERE r.RETURN_ID IS NOT NULL""", "cdl_fact_sales", "cdl_fact_returns"))
def f4(ctx):
    """drop rows whose grain columns are NULL (here: sales lines without a return)."""
    r = ctx.cdl["cdl_fact_returns"].select("ORDER_ID", "ORDER_LINE_NO", "RETURN_ID")
    j = J.join_facts_raw(ctx.cdl["cdl_fact_sales"].select("ORDER_ID", "ORDER_LINE_NO"), r, ["ORDER_ID", "ORDER_LINE_NO"])
    return FL.require_grain(j, ["RETURN_ID"])


@register("f5_having", O.sql("""
SELECT CUSTOMER_CODE, count(*) order_lines FROM cdl_fact_sales GROUP BY CUSTOMER_CODE HAVING count(*) > 30""",
                             "cdl_fact_sales"))
def f5(ctx):
    """HAVING on an aggregate."""
    g = ctx.cdl["cdl_fact_sales"].groupBy("CUSTOMER_CODE").agg(F.count(F.lit(1)).alias("order_lines"))
    return FL.having(g, F.col("order_lines") > 30)


@register("f6_incremental", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO, strftime(LOAD_DATE, '%Y-%m-%d %H:%M:%S.%f') LOAD_DATE FROM raw_order_line
WHERE LOAD_DATE > (SELECT coalesce(max(LOAD_DATE), TIMESTAMP '1970-01-01') FROM raw_order_line
                   WHERE LOAD_DATE < TIMESTAMP '1998-01-01 00:00:00')""", "raw_order_line"))
def f6(ctx):
    """rows stamped after the high-water mark of an earlier load (lines shipped before 1998)."""
    ol = ctx.raw["raw_order_line"]
    first = ol.filter(F.col("LOAD_DATE") < F.lit("1998-01-01 00:00:00").cast("timestamp"))
    mark = A.high_water_mark(first, "LOAD_DATE").scalar()
    return FL.incremental(ol, "LOAD_DATE", mark).select("ORDER_ID", "ORDER_LINE_NO", "LOAD_DATE")


# ---------------------------------------------------------------- joins
@register("j1_join_dim", O.sql("""
SELECT s.ORDER_ID, s.ORDER_LINE_NO, p.CATEGORY, p.BRAND FROM cdl_fact_sales s
JOIN cdl_dim_product p ON s.KEY_PRODUCT = p.KEY_PRODUCT""", "cdl_fact_sales", "cdl_dim_product"))
def j1(ctx):
    """Fact ⋈ dimension on the surrogate key."""
    s = ctx.cdl["cdl_fact_sales"].select("KEY_PRODUCT", "ORDER_ID", "ORDER_LINE_NO")
    return J.join_dim(s, ctx.cdl["cdl_dim_product"].select("KEY_PRODUCT", "CATEGORY", "BRAND"), "KEY_PRODUCT").drop(
        "KEY_PRODUCT")


@register("j2_enrich", O.sql("""
SELECT s.ORDER_ID, s.ORDER_LINE_NO, c.COMPANY_NAME, c.REGION, cu.CUSTOMER_TYPE FROM cdl_fact_sales s
LEFT JOIN cdl_dim_company c ON s.KEY_COMPANY = c.KEY_COMPANY
LEFT JOIN cdl_dim_customer cu ON s.KEY_CUSTOMER = cu.KEY_CUSTOMER""",
                             "cdl_fact_sales", "cdl_dim_company", "cdl_dim_customer"))
def j2(ctx):
    """Left lookups of names from two dimensions (join strategy left to Catalyst and AQE)."""
    s = ctx.cdl["cdl_fact_sales"].select("KEY_COMPANY", "KEY_CUSTOMER", "ORDER_ID", "ORDER_LINE_NO")
    s = J.enrich(s, ctx.cdl["cdl_dim_company"], "KEY_COMPANY", ["COMPANY_NAME", "REGION"])
    s = J.enrich(s, ctx.cdl["cdl_dim_customer"], "KEY_CUSTOMER", ["CUSTOMER_TYPE"])
    return s.drop("KEY_COMPANY", "KEY_CUSTOMER")


@register("j3_join_facts_raw", O.sql("""
SELECT s.ORDER_ID, s.ORDER_LINE_NO, s.ORDER_QTY, r.RETURN_ID, r.RETURN_QTY FROM cdl_fact_sales s
LEFT JOIN cdl_fact_returns r ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.ORDER_ID = r.ORDER_ID""",
                                     "cdl_fact_sales", "cdl_fact_returns"))
def j3(ctx):
    """Row-level left join of two facts on two keys (many-to-many; fan-out is the point)."""
    s = ctx.cdl["cdl_fact_sales"].select("KEY_PRODUCT", "ORDER_ID", "ORDER_LINE_NO", "ORDER_QTY")
    r = ctx.cdl["cdl_fact_returns"].select("KEY_PRODUCT", "ORDER_ID", "RETURN_ID", "RETURN_QTY")
    return J.join_facts_raw(s, r, ["KEY_PRODUCT", "ORDER_ID"]).drop("KEY_PRODUCT")


_J4G = "KEY_PRODUCT, KEY_COMPANY, KEY_SELLING_METHOD, FORECAST_DATE"


@register("j4_drill_across", O.sql(f"""
SELECT KEY_PRODUCT, KEY_COMPANY, KEY_SELLING_METHOD, cast(FORECAST_DATE as varchar) FORECAST_DATE,
       cast(DEMAND_QTY as bigint) DEMAND_QTY, cast(FORECAST_QTY as bigint) FORECAST_QTY
FROM (SELECT {_J4G}, sum(DEMAND_PLAN_QTY) DEMAND_QTY FROM cdl_fact_demand_forecast GROUP BY ALL) d
FULL OUTER JOIN (SELECT {_J4G}, sum(SALES_FORECAST_QTY) FORECAST_QTY FROM cdl_fact_sales_forecast GROUP BY ALL) f
USING ({_J4G})""", "cdl_fact_demand_forecast", "cdl_fact_sales_forecast"))
def j4(ctx):
    """Drill-across: each fact aggregated to the shared grain, then FULL OUTER on it."""
    g = ["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD", "FORECAST_DATE"]
    out = J.drill_across([(ctx.cdl["cdl_fact_demand_forecast"], [F.sum("DEMAND_PLAN_QTY").alias("DEMAND_QTY")]),
                          (ctx.cdl["cdl_fact_sales_forecast"], [F.sum("SALES_FORECAST_QTY").alias("FORECAST_QTY")])], g)
    return out.withColumns({"DEMAND_QTY": F.col("DEMAND_QTY").cast("bigint"),
                            "FORECAST_QTY": F.col("FORECAST_QTY").cast("bigint")})


@register("j5_grain_left_join", O.sql("""
SELECT s.KEY_PRODUCT, s.KEY_COMPANY, cast(s.SOLD as bigint) SOLD, cast(r.RETURNED as bigint) RETURNED
FROM (SELECT KEY_PRODUCT, KEY_COMPANY, sum(ORDER_QTY) SOLD FROM cdl_fact_sales GROUP BY ALL) s
LEFT JOIN (SELECT KEY_PRODUCT, KEY_COMPANY, sum(RETURN_QTY) RETURNED FROM cdl_fact_returns GROUP BY ALL) r
  ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.KEY_COMPANY = r.KEY_COMPANY""", "cdl_fact_sales", "cdl_fact_returns"))
def j5(ctx):
    """The grain owner (sales) on the left; returns aggregated and left-joined."""
    g = ["KEY_PRODUCT", "KEY_COMPANY"]
    s = ctx.cdl["cdl_fact_sales"].groupBy(*g).agg(F.sum("ORDER_QTY").cast("bigint").alias("SOLD"))
    r = ctx.cdl["cdl_fact_returns"].groupBy(*g).agg(F.sum("RETURN_QTY").cast("bigint").alias("RETURNED"))
    return J.grain_left_join(s, [r], g)


@register("j6_interval_join", O.sql("""
SELECT s.ORDER_ID, s.ORDER_LINE_NO, cast(p.PRICE as varchar) PRICE FROM cdl_fact_sales s
LEFT JOIN cdl_fact_product_price p ON s.KEY_PRODUCT = p.KEY_PRODUCT AND p.PRICE_TYPE = 'LIST'
  AND s.TRANSACTION_DATE BETWEEN p.EFFECTIVE_DATE AND p.EXPIRY_DATE""", "cdl_fact_sales", "cdl_fact_product_price"))
def j6(ctx):
    """The LIST price valid on each transaction date (equi key + range, latest effective wins)."""
    s = ctx.cdl["cdl_fact_sales"].select("KEY_PRODUCT", "ORDER_ID", "ORDER_LINE_NO", "TRANSACTION_DATE")
    h = ctx.cdl["cdl_fact_product_price"].filter(F.col("PRICE_TYPE") == "LIST")
    out = J.interval_join(s, h, "KEY_PRODUCT", "TRANSACTION_DATE", ["ORDER_ID", "ORDER_LINE_NO"], ["PRICE"])
    return out.select("ORDER_ID", "ORDER_LINE_NO", "PRICE")


@register("j7_month_join", O.sql("""
SELECT d.FORECAST_ID, cast(a.ACTUAL_QTY as bigint) ACTUAL_QTY FROM cdl_fact_demand_forecast d
LEFT JOIN (SELECT KEY_PRODUCT, KEY_COMPANY, KEY_SELLING_METHOD, date_trunc('month', TRANSACTION_DATE) m,
                  sum(ORDER_QTY) ACTUAL_QTY FROM cdl_fact_sales GROUP BY ALL) a
  ON d.KEY_PRODUCT = a.KEY_PRODUCT AND d.KEY_COMPANY = a.KEY_COMPANY AND d.KEY_SELLING_METHOD = a.KEY_SELLING_METHOD
 AND date_trunc('month', d.FORECAST_DATE) = a.m""", "cdl_fact_demand_forecast", "cdl_fact_sales"))
def j7(ctx):
    """Forecast month = transaction month, as an equi join on the truncated month."""
    k = ["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD"]
    a = ctx.cdl["cdl_fact_sales"].groupBy(*k, F.trunc("TRANSACTION_DATE", "MM").alias("TX_MONTH")).agg(
        F.sum("ORDER_QTY").cast("bigint").alias("ACTUAL_QTY"))
    d = ctx.cdl["cdl_fact_demand_forecast"].select(*k, "FORECAST_ID", "FORECAST_DATE")
    return J.month_join(d, a, k, "FORECAST_DATE", "TX_MONTH").select("FORECAST_ID", "ACTUAL_QTY")


@register("j8_missing_members", O.sql("""
SELECT TOY_NO, DASH_CODE FROM cdl_dim_product p
WHERE NOT EXISTS (SELECT 1 FROM cdl_fact_sales s WHERE s.KEY_PRODUCT = p.KEY_PRODUCT)""",
                                      "cdl_dim_product", "cdl_fact_sales"))
def j8(ctx):
    """Products never sold (null-safe NOT IN as a left anti join)."""
    return J.missing_members(ctx.cdl["cdl_dim_product"], ctx.cdl["cdl_fact_sales"], "KEY_PRODUCT").select(
        "TOY_NO", "DASH_CODE")


@register("j9_planning_grid", O.sql("""
SELECT COMPANY_CODE, SELLING_METHOD_CODE, cast(cast(m as date) as varchar) PLAN_MONTH
FROM (SELECT DISTINCT COMPANY_CODE, SELLING_METHOD_CODE FROM raw_order_line) mem,
     (SELECT unnest(generate_series(date_trunc('month', min(TRANSACTION_DATE)), date_trunc('month', max(TRANSACTION_DATE)),
                                    INTERVAL 1 MONTH)) m FROM raw_order_line) months""", "raw_order_line"))
def j9(ctx):
    """Planning grid: every active (company, method) × every month of the data's range."""
    ol = ctx.raw["raw_order_line"]
    members = ol.select("COMPANY_CODE", "SELLING_METHOD_CODE").distinct()
    return D.planning_grid(members, ol.select(F.min("TRANSACTION_DATE")).scalar(),
                           ol.select(F.max("TRANSACTION_DATE")).scalar())


# ---------------------------------------------------------------- aggregates
@register("a1_rollup_sales", O.sql("""
SELECT COMPANY_CODE, cast(year(TRANSACTION_DATE) as bigint) AS "year", count(*) order_lines,
       cast(sum(ORDER_QTY) as bigint) total_qty, cast(sum(cast(ORDER_VALUE as decimal(18,2))) as varchar) total_value
FROM cdl_fact_sales GROUP BY 1, 2""", "cdl_fact_sales"))
def a1(ctx):
    """A1: grouped COUNT / SUM rollup."""
    s = ctx.cdl["cdl_fact_sales"].withColumn("year", F.year("TRANSACTION_DATE").cast("bigint"))
    out = A.rollup_sales(s, ["COMPANY_CODE", "year"])
    return out.withColumn("total_value", F.col("total_value").cast("decimal(28,2)"))


@register("a2_count_distinct", O.sql("""
SELECT COMPANY_CODE, count(DISTINCT ORDER_ID) orders, count(DISTINCT CUSTOMER_CODE) customers
FROM cdl_fact_sales GROUP BY 1""", "cdl_fact_sales"))
def a2(ctx):
    """A2: COUNT DISTINCT (exact)."""
    return ctx.cdl["cdl_fact_sales"].groupBy("COMPANY_CODE").agg(A.count_distinct("ORDER_ID").alias("orders"),
                                                                 A.count_distinct("CUSTOMER_CODE").alias("customers"))


@register("a3_ratio_of_sums", O.sql("""
SELECT TOY_NO, case when sum(ORDER_QTY) = 0 then NULL
                    else cast(sum(cast(ORDER_VALUE as decimal(18,2))) as double) / cast(sum(ORDER_QTY) as double) end asp
FROM cdl_fact_sales GROUP BY 1""", "cdl_fact_sales"))
def a3(ctx):
    """A3: ratio of sums (average selling price)."""
    s = ctx.cdl["cdl_fact_sales"].withColumn("V", F.col("ORDER_VALUE").cast("decimal(18,2)"))
    return s.groupBy("TOY_NO").agg(A.ratio_of_sums("V", "ORDER_QTY").alias("asp"))


@register("a4_avg", O.sql("""
SELECT SELLING_METHOD_CODE, cast(sum(DISCOUNT_PCT) as double) / count(DISCOUNT_PCT) avg_discount
FROM cdl_fact_sales GROUP BY 1""", "cdl_fact_sales"))
def a4(ctx):
    """A4: AVG (as exact sum / count)."""
    return ctx.cdl["cdl_fact_sales"].groupBy("SELLING_METHOD_CODE").agg(
        (F.sum("DISCOUNT_PCT").cast("double") / F.count("DISCOUNT_PCT")).alias("avg_discount"))


_J3 = """(SELECT s.ORDER_ID, s.ORDER_LINE_NO, s.ORDER_QTY, r.RETURN_ID, r.RETURN_QTY FROM cdl_fact_sales s
LEFT JOIN cdl_fact_returns r ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.ORDER_ID = r.ORDER_ID) j"""


@register("a5_null_counts", O.sql(f"""
SELECT count(*) cnt, cast(count_if(ORDER_ID IS NULL) as bigint) ORDER_ID_nulls, cast(count_if(ORDER_LINE_NO IS NULL) as bigint) ORDER_LINE_NO_nulls,
       cast(count_if(ORDER_QTY IS NULL) as bigint) ORDER_QTY_nulls, cast(count_if(RETURN_ID IS NULL) as bigint) RETURN_ID_nulls,
       cast(count_if(RETURN_QTY IS NULL) as bigint) RETURN_QTY_nulls FROM {_J3}""", "cdl_fact_sales", "cdl_fact_returns"))
def a5(ctx):
    """A5: one pass, COUNTIF(c IS NULL) for every column."""
    return A.null_counts(j3(ctx))


@register("a6_high_water_mark", O.sql("""
SELECT strftime(coalesce(max(RAW_LOAD_DATE), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') high_water_mark
FROM cdl_fact_sales""", "cdl_fact_sales"))
def a6(ctx):
    """COALESCE(MAX(stamp), epoch)."""
    return A.high_water_mark(ctx.cdl["cdl_fact_sales"], "RAW_LOAD_DATE")


@register("a7_duplicate_keys", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO, cnt FROM (SELECT ORDER_ID, ORDER_LINE_NO, count(*) cnt FROM raw_order_line
GROUP BY ALL HAVING count(*) > 1) d ORDER BY cnt DESC, ORDER_ID, ORDER_LINE_NO LIMIT 5""", "raw_order_line"))
def a7(ctx):
    """Duplicate key groups, five samples."""
    return A.duplicate_keys(ctx.raw["raw_order_line"], ["ORDER_ID", "ORDER_LINE_NO"], 5)


O.cte("lessons", f"""SELECT cast(doc_id as varchar) id, source context, text error_message, lang fix_description,
       {categorize_sql('text')} error_category FROM documents""")


@register("a8_top_lessons", O.sql("""
SELECT error_pattern, rule, example_error, context, occurrences FROM (
  SELECT coalesce(error_category, 'other') error_pattern, coalesce(fix_description, '') rule,
         substr(coalesce(error_message, ''), 1, 200) example_error, coalesce(context, 'execution') context,
         cast(occurrences as bigint) occurrences,
         row_number() OVER (PARTITION BY coalesce(error_category, 'other') ORDER BY occurrences DESC,
           error_message NULLS FIRST, fix_description NULLS FIRST, context NULLS FIRST) rn
  FROM (SELECT error_category, error_message, fix_description, context, count(*) occurrences FROM lessons
        GROUP BY ALL ORDER BY occurrences DESC, error_category NULLS FIRST, error_message NULLS FIRST,
        fix_description NULLS FIRST, context NULLS FIRST LIMIT 10) top) r WHERE rn = 1""", "lessons"))
def a8(ctx):
    """Most frequent lessons, then the first per category (over whole document texts)."""
    return A.top_lessons(pipeline_lessons(ctx.spark, ctx.sf_dir), 10)


@register("a9_run_history", O.sql("""
SELECT run_id, strftime(max(run_timestamp), '%Y-%m-%d %H:%M:%S.%f') run_timestamp, count(*) steps,
       cast(count_if(status = 'success') as bigint) successes, cast(count_if(status = 'failed') as bigint) failures,
       cast(sum(cast(coalesce(duration_seconds, 0.0) as decimal(20,6))) as double) total_duration_seconds,
       case when count_if(status = 'failed') > 0 then 'failed' else 'success' end overall_status,
       case when count_if(status = 'success') = count(*) then 'success' when count_if(status = 'failed') > 0 then 'failed'
            else 'running' end run_state
FROM runs GROUP BY run_id""", "runs"))
def a9(ctx):
    """Per-run roll-up of the run log."""
    return A.run_history(pipeline_runs(ctx.spark, ctx.sf_dir))


# ---------------------------------------------------------------- windows
@register("w1_dedup_latest", O.sql(f"""
SELECT {O.render(S.RAW_RETURN)} FROM (
  SELECT *, row_number() OVER (PARTITION BY RETURN_ID ORDER BY LOAD_DATE DESC NULLS LAST, ORDER_ID NULLS FIRST,
    ORDER_LINE_NO NULLS FIRST, RETURN_DATE NULLS FIRST, COMPANY_CODE NULLS FIRST, TOY_NO NULLS FIRST,
    DASH_CODE NULLS FIRST, RETURN_QTY NULLS FIRST, RETURN_VALUE NULLS FIRST, RETURN_REASON NULLS FIRST,
    CURRENCY_CODE NULLS FIRST) rn FROM raw_return) x WHERE rn = 1""", "raw_return"))
def w1(ctx):
    """Latest row per key (returns per RETURN_ID, by load stamp, total tie-break)."""
    return W.dedup_latest(ctx.raw["raw_return"], ["RETURN_ID"], [F.col("LOAD_DATE").desc_nulls_last()], ["LOAD_DATE"])


@register("w2_active_artifacts", O.sql("""
SELECT artifact_id, target_table, status, cast(version as bigint) version FROM (
  SELECT *, row_number() OVER (PARTITION BY target_table ORDER BY case status when 'passed' then 1 when 'executed' then 2
    when 'testing' then 3 when 'generated' then 4 else 5 end, version DESC NULLS LAST, created_at DESC NULLS LAST,
    artifact_id NULLS FIRST) rn FROM artifacts) a WHERE rn = 1""", "artifacts"))
def w2(ctx):
    """Latest artifact per table by status preference, version, time (QUALIFY rewritten)."""
    return W.active_artifacts(pipeline_artifacts(ctx.spark, ctx.sf_dir)).select(
        "artifact_id", "target_table", "status", "version")


@register("w3_first_per_category", O.sql("""
SELECT COMPANY_CODE, ORDER_ID, ORDER_LINE_NO, cast(ORDER_VALUE as varchar) ORDER_VALUE FROM (
  SELECT *, row_number() OVER (PARTITION BY COMPANY_CODE ORDER BY ORDER_VALUE DESC, ORDER_ID, ORDER_LINE_NO) rn
  FROM cdl_fact_sales) s WHERE rn = 1""", "cdl_fact_sales"))
def w3(ctx):
    """First row per category in rank order (largest line per company)."""
    s = ctx.cdl["cdl_fact_sales"].select("COMPANY_CODE", "ORDER_ID", "ORDER_LINE_NO", "ORDER_VALUE")
    return W.first_per_category(s, "COMPANY_CODE", [F.col("ORDER_VALUE").desc(), F.col("ORDER_ID"),
                                                    F.col("ORDER_LINE_NO")], ["ORDER_VALUE", "ORDER_ID", "ORDER_LINE_NO"])


@register("w4_current_price", O.sql(f"""
SELECT TOY_NO, cast(PRICE as varchar) PRICE FROM (
  SELECT *, row_number() OVER (PARTITION BY KEY_PRODUCT ORDER BY EFFECTIVE_DATE DESC) rn FROM cdl_fact_product_price
  WHERE PRICE_TYPE = 'LIST' AND {_AS_OF} BETWEEN EFFECTIVE_DATE AND EXPIRY_DATE) p WHERE rn = 1""",
                                    "cdl_fact_product_price", "cdl_fact_sales"))
def w4(ctx):
    """Latest valid LIST price per product as of the latest order date."""
    return W.current_price(ctx.cdl["cdl_fact_product_price"], _as_of(ctx), "PRICE_TYPE", "LIST").select(
        "TOY_NO", "PRICE")


# ---------------------------------------------------------------- ordering, top-k, unions
@register("o1_sorted_by", O.sql("""
SELECT CUSTOMER_CODE, CREDIT_LIMIT FROM cdl_dim_customer ORDER BY CREDIT_LIMIT DESC, CUSTOMER_CODE""",
                                "cdl_dim_customer"))
def o1(ctx):
    """O1: ORDER BY measure desc, name asc (total order)."""
    c = ctx.cdl["cdl_dim_customer"].select("CUSTOMER_CODE", "CREDIT_LIMIT")
    return A.sorted_by(c, [F.col("CREDIT_LIMIT").desc()])


@register("o2_top_k", O.sql("""
SELECT CUSTOMER_CODE, cast(sum(cast(ORDER_VALUE as decimal(18,2))) as varchar) total_value FROM cdl_fact_sales
GROUP BY 1 ORDER BY sum(cast(ORDER_VALUE as decimal(18,2))) DESC, CUSTOMER_CODE LIMIT 10""", "cdl_fact_sales"))
def o2(ctx):
    """O2: top-10 customers by value (TakeOrderedAndProject)."""
    g = ctx.cdl["cdl_fact_sales"].groupBy("CUSTOMER_CODE").agg(
        F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")).alias("total_value"))
    return A.top_k(g, [F.col("total_value").desc()], 10, ["CUSTOMER_CODE"])


@register("o3_recent_runs", O.sql("""
SELECT artifact_id, target_table, status, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') created_at FROM artifacts
WHERE target_table = 'mart_7' ORDER BY created_at DESC, artifact_id LIMIT 20""", "artifacts"))
def o3(ctx):
    """O3: newest 20 artifact rows of one table."""
    a = pipeline_artifacts(ctx.spark, ctx.sf_dir).select("artifact_id", "target_table", "status", "created_at")
    return A.recent_runs(a, 20, "mart_7", id_col="artifact_id")


@register("u1_union_labelled", O.sql("""
SELECT 'raw_company' table_name, COMPANY_CODE code FROM raw_company UNION ALL
SELECT 'raw_customer', CUSTOMER_CODE FROM raw_customer UNION ALL SELECT 'raw_product', TOY_NO FROM raw_product""",
                                     "raw_company", "raw_customer", "raw_product"))
def u1(ctx):
    """UNION ALL of labelled results."""
    r = ctx.raw
    return A.union_labelled({"raw_company": r["raw_company"].select(F.col("COMPANY_CODE").alias("code")),
                             "raw_customer": r["raw_customer"].select(F.col("CUSTOMER_CODE").alias("code")),
                             "raw_product": r["raw_product"].select(F.col("TOY_NO").alias("code"))})


@register("u3_distinct_rows", O.sql("""
SELECT DISTINCT COMPANY_CODE, SELLING_METHOD_CODE, CURRENCY_CODE FROM raw_order_line""", "raw_order_line"))
def u3(ctx):
    """SELECT DISTINCT base rows."""
    return W.distinct_rows(ctx.raw["raw_order_line"].select("COMPANY_CODE", "SELLING_METHOD_CODE", "CURRENCY_CODE"))
