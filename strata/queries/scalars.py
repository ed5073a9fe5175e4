"""Scalar functions and projections, each applied to RAW/CDL rows derived from the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import oracle_sql as O
from ..functions import keys as K
from ..functions import scalars as P
from ..plans.mapping import FieldMapping, TableMapping, apply_mapping, load_mapping, read_mapped
from ..registry import register
from ..sources import schemas as S
from ..sources.testdata import pipeline_artifacts, pipeline_lessons

fp = O.fp


@register("p1_fingerprint64", O.sql(f"SELECT CUSTOMER_CODE, {fp('CUSTOMER_CODE')} AS \"KEY\" FROM raw_customer",
                                    "raw_customer"))
def p1(ctx):
    """64-bit fingerprint of a code."""
    r = ctx.raw["raw_customer"]
    return r.select("CUSTOMER_CODE", K.fingerprint64("CUSTOMER_CODE").alias("KEY"))


@register("p2_product_key", O.sql(f"""
SELECT TOY_NO, DASH, {O.pkey('TOY_NO', 'DASH')} KEY_PRODUCT FROM (
  SELECT TOY_NO, case when STATUS = 'DISCONTINUED' then NULL else DASH_CODE end DASH FROM raw_product) p""",
                                  "raw_product"))
def p2(ctx):
    """Product key; a NULL half (discontinued products here) gives a NULL key."""
    r = ctx.raw["raw_product"].select(
        "TOY_NO", F.when(F.col("STATUS") == "DISCONTINUED", F.lit(None)).otherwise(F.col("DASH_CODE")).alias("DASH"))
    return r.select("TOY_NO", "DASH", K.product_key("TOY_NO", "DASH").alias("KEY_PRODUCT"))


@register("p3_calendar_key", O.sql(f"""
SELECT cast(d as varchar) d, {O.ckey('d')} KEY_CALENDAR FROM (SELECT DISTINCT TRANSACTION_DATE d FROM raw_order_line) x""",
                                   "raw_order_line"))
def p3(ctx):
    """Calendar key of every transaction date."""
    d = ctx.raw["raw_order_line"].select(F.col("TRANSACTION_DATE").alias("d")).distinct()
    return d.select("d", K.calendar_key("d").alias("KEY_CALENDAR"))


@register("p4_composite_hash", O.sql(f"""
SELECT ORDER_ID, ORDER_LINE_NO,
       {fp("to_json(struct_pack(ORDER_ID := ORDER_ID, ORDER_LINE_NO := ORDER_LINE_NO))")} JSON_HASH,
       {fp("concat_ws('|', coalesce(cast(ORDER_ID as varchar), '\\N'), coalesce(cast(ORDER_LINE_NO as varchar), '\\N'))")}
         DELIMITED_HASH
FROM (SELECT DISTINCT ORDER_ID, ORDER_LINE_NO FROM raw_order_line) x""", "raw_order_line"))
def p4(ctx):
    """Composite-key hash over a JSON struct (NULL fields kept), and the delimiter-joined variant."""
    d = ctx.raw["raw_order_line"].select("ORDER_ID", "ORDER_LINE_NO").distinct()
    return d.select("ORDER_ID", "ORDER_LINE_NO", K.composite_hash(["ORDER_ID", "ORDER_LINE_NO"]).alias("JSON_HASH"),
                    K.delimited_hash(["ORDER_ID", "ORDER_LINE_NO"]).alias("DELIMITED_HASH"))


_P4B = [f.name for f in S.RAW_CUSTOMER.fields if f.name != "LOAD_DATE"]


@register("p4b_row_hash", O.sql(f"""
SELECT CUSTOMER_CODE, {O.fp("to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in _P4B) + "))")} ADMIN_ROW_HASH
FROM raw_customer""", "raw_customer"))
def p4b(ctx):
    """Row hash over every non-ADMIN column but the load stamp."""
    r = ctx.raw["raw_customer"]
    return r.select("CUSTOMER_CODE", K.row_hash(r, ["LOAD_DATE"]).alias("ADMIN_ROW_HASH"))


@register("p5_rename", O.sql(f"""
SELECT ORDER_ID, ORDER_LINE_NO, {O.ts_text('LOAD_DATE')} RAW_LOAD_DATE FROM raw_order_line""", "raw_order_line"))
def p5(ctx):
    """P5: LOAD_DATE re-stamped as RAW_LOAD_DATE."""
    return P.rename(ctx.raw["raw_order_line"].select("ORDER_ID", "ORDER_LINE_NO", "LOAD_DATE"),
                    {"LOAD_DATE": "RAW_LOAD_DATE"})


@register("p6_date_parts", O.sql("""
SELECT cast(d as varchar) d, cast(year(d) as bigint) AS "YEAR", cast(month(d) as bigint) AS "MONTH",
       cast(quarter(d) as bigint) AS "QUARTER", cast(weekofyear(d) as bigint) WEEK_OF_YEAR,
       cast(dayofweek(d) + 1 as bigint) DAY_OF_WEEK
FROM (SELECT DISTINCT TRANSACTION_DATE d FROM raw_order_line) x""", "raw_order_line"))
def p6(ctx):
    """Year, month, quarter, ISO week, day of week (1 = Sunday)."""
    d = ctx.raw["raw_order_line"].select(F.col("TRANSACTION_DATE").alias("d")).distinct()
    return P.date_parts(d, "d")


@register("p7_is_weekend", O.sql("""
SELECT cast(d as varchar) d, dayofweek(d) IN (0, 6) IS_WEEKEND
FROM (SELECT DISTINCT TRANSACTION_DATE d FROM raw_order_line) x""", "raw_order_line"))
def p7(ctx):
    """Weekend flag."""
    d = ctx.raw["raw_order_line"].select(F.col("TRANSACTION_DATE").alias("d")).distinct()
    return d.select("d", P.is_weekend("d").alias("IS_WEEKEND"))


@register("p8_safe_cast", O.sql("""
SELECT TOY_NO, TRY_CAST(substr(TOY_NO, 2) AS bigint) TOY_NUMBER, TRY_CAST(TOY_NO AS bigint) TOY_AS_NUMBER,
       TRY_CAST(DASH_CODE AS bigint) DASH_NUMBER, cast(DASH_CODE as bigint) DASH_CAST
FROM raw_product""", "raw_product"))
def p8(ctx):
    """SAFE_CAST (NULL on failure) and CAST."""
    r = ctx.raw["raw_product"]
    return r.select("TOY_NO", P.safe_cast(F.substring("TOY_NO", 2, 100), "bigint").alias("TOY_NUMBER"),
                    P.safe_cast("TOY_NO", "bigint").alias("TOY_AS_NUMBER"),
                    P.safe_cast("DASH_CODE", "bigint").alias("DASH_NUMBER"),
                    F.col("DASH_CODE").cast("bigint").alias("DASH_CAST"))


@register("p9_safe_divide", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO,
       case when DISCOUNT_PCT = 0 then NULL
            else cast(cast(ORDER_VALUE as decimal(18,2)) as double) / cast(DISCOUNT_PCT as double) end VALUE_PER_POINT
FROM cdl_fact_sales""", "cdl_fact_sales"))
def p9(ctx):
    """SAFE_DIVIDE: NULL when the divisor is zero (undiscounted lines)."""
    s = ctx.cdl["cdl_fact_sales"]
    return s.select("ORDER_ID", "ORDER_LINE_NO",
                    P.safe_divide(F.col("ORDER_VALUE").cast("decimal(18,2)"), "DISCOUNT_PCT").alias("VALUE_PER_POINT"))


@register("p10_fill_defaults", O.sql("""
SELECT p.KEY_PRODUCT, p.TOY_NO, coalesce(s.TOTAL_QTY, 0) TOTAL_QTY,
       cast(coalesce(s.TOTAL_VALUE, 0) as decimal(18,2))::varchar TOTAL_VALUE,
       cast(coalesce(s.LAST_SALE_DATE, DATE '1900-01-01') as varchar) LAST_SALE_DATE,
       coalesce(s.FIRST_COMPANY, 'N/A') FIRST_COMPANY, coalesce(s.ANY_RUSH, false) ANY_RUSH
FROM cdl_dim_product p LEFT JOIN (
  SELECT KEY_PRODUCT, cast(sum(ORDER_QTY) as bigint) TOTAL_QTY, cast(sum(cast(ORDER_VALUE as decimal(18,2))) as decimal(18,2)) TOTAL_VALUE,
         max(TRANSACTION_DATE) LAST_SALE_DATE, min(COMPANY_CODE) FIRST_COMPANY, bool_or(ORDER_TYPE = 'RUSH') ANY_RUSH
  FROM cdl_fact_sales GROUP BY KEY_PRODUCT) s ON p.KEY_PRODUCT = s.KEY_PRODUCT""", "cdl_dim_product", "cdl_fact_sales"))
def p10(ctx):
    """P10: type-driven defaults for products without sales: 0, 0.00, 1900-01-01, 'N/A', FALSE."""
    s = ctx.cdl["cdl_fact_sales"].groupBy("KEY_PRODUCT").agg(
        F.sum("ORDER_QTY").cast("bigint").alias("TOTAL_QTY"),
        F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")).cast("decimal(18,2)").alias("TOTAL_VALUE"),
        F.max("TRANSACTION_DATE").alias("LAST_SALE_DATE"), F.min("COMPANY_CODE").alias("FIRST_COMPANY"),
        F.bool_or(F.col("ORDER_TYPE") == "RUSH").alias("ANY_RUSH"))
    j = ctx.cdl["cdl_dim_product"].select("KEY_PRODUCT", "TOY_NO").join(s, "KEY_PRODUCT", "left")
    return P.fill_defaults(j)


@register("p11_replace_text", O.sql("SELECT TOY_NO, replace(PRODUCT_NAME, ' ', '_') PRODUCT_SLUG FROM raw_product",
                                    "raw_product"))
def p11(ctx):
    """REPLACE."""
    return ctx.raw["raw_product"].select("TOY_NO", P.replace_text("PRODUCT_NAME", " ", "_").alias("PRODUCT_SLUG"))


_P12 = T.StructType([T.StructField("ORDER_ID", T.StringType()), T.StructField("ORDER_LINE_NO", T.StringType()),
                     T.StructField("ORDER_QTY", T.DoubleType()), T.StructField("ORDER_VALUE", T.DecimalType(18, 2)),
                     T.StructField("NOTE", T.StringType())])


@register("p12_conform", O.sql("""
SELECT ORDER_ID, cast(ORDER_LINE_NO as varchar) ORDER_LINE_NO, cast(ORDER_QTY as double) ORDER_QTY,
       cast(cast(ORDER_VALUE as decimal(18,2)) as varchar) ORDER_VALUE, cast(NULL as varchar) NOTE
FROM raw_order_line""", "raw_order_line"))
def p12(ctx):
    """Conform to a target schema: order, declared types, missing columns as typed NULLs."""
    return P.conform(ctx.raw["raw_order_line"], _P12)


@register("p13_status_rank", O.sql("""
SELECT cast(event_id as varchar) artifact_id, status,
       cast(case status when 'passed' then 1 when 'executed' then 2 when 'testing' then 3 when 'generated' then 4
            else 5 end as bigint) status_rank
FROM (SELECT event_id, case event_type when 'purchase' then 'passed' when 'click' then 'executed'
      when 'view' then 'testing' when 'signup' then 'generated' else 'failed' end status FROM events) e""", ))
def p13(ctx):
    """CASE-to-rank of an artifact status."""
    a = pipeline_artifacts(ctx.spark, ctx.sf_dir)
    return a.select("artifact_id", "status", P.status_rank("status").cast("bigint").alias("status_rank"))


STAMP_TS = dt.datetime(2026, 1, 2, 3, 4, 5)


@register("p14_stamp", O.sql(f"""
SELECT COMPANY_CODE, {O.ts_text("TIMESTAMP '2026-01-02 03:04:05'")} CDL_LOAD_DATE FROM raw_company""", "raw_company"))
def p14(ctx):
    """A load stamp passed in by the caller."""
    return P.stamp(ctx.raw["raw_company"].select("COMPANY_CODE"), "CDL_LOAD_DATE", STAMP_TS)


_P15_COLS = ["CUSTOMER_CODE", "CUSTOMER_NAME", "CUSTOMER_TYPE", "STATUS", "CREDIT_LIMIT", "PAYMENT_TERMS"]


def _json(cols):
    return "to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in cols) + "))"


@register("p15_add_admin", O.sql(f"""
SELECT {', '.join(_P15_COLS)}, 'strata' ADMIN_PROCESS_ID, {fp(_json(['CUSTOMER_CODE']))} ADMIN_COMPOSITEKEY_HASH,
       'COMPOSER' ADMIN_SCHEDULER_TYPE, {fp(_json(_P15_COLS))} ADMIN_ROW_HASH,
       {O.ts_text(O.RUN_TS)} ADMIN_LOAD_DATE, false ADMIN_ISDELETED, (CUSTOMER_NAME IS NULL) ADMIN_ISERROR,
       {O.ts_text(O.RUN_TS)} ADMIN_LAST_MODIFIED_DATE, 'INSERT' ADMIN_DML_OPERATION_FLAG,
       'ACTIVE' ADMIN_RECORD_STATUS, 'testdata' ADMIN_SOURCE_SYSTEM
FROM raw_customer""", "raw_customer"))
def p15(ctx):
    """The ADMIN audit block (hash of the key, hash of the row, stamps, flags)."""
    from ..plans.cdl import DEFAULT_RUN_TS
    r = ctx.raw["raw_customer"].select(*_P15_COLS)
    return P.add_admin(r, ["CUSTOMER_CODE"], ["CUSTOMER_NAME"], DEFAULT_RUN_TS, "testdata")


CUSTOMER_MAPPING = TableMapping(
    target_table="bl_dim_customer",
    fields=[FieldMapping("CUSTOMER_ID", "STRING", "CUSTOMER_CODE", is_key=True),
            FieldMapping("CUSTOMER_NAME", "STRING", "upper(CUSTOMER_NAME)"),
            FieldMapping("SEGMENT", "STRING", "CUSTOMER_TYPE", value="UNKNOWN"),
            FieldMapping("CREDIT_LIMIT", "NUMERIC", "CREDIT_LIMIT"),
            FieldMapping("TERMS_DAYS", "INT64", "substr(PAYMENT_TERMS, 4)"),
            FieldMapping("SOURCE", "STRING", None, value="RAW")],
    filters=["CREDIT_LIMIT > 0"], primary_keys=["CUSTOMER_ID"])


@register("p16_apply_mapping", O.sql("""
SELECT CUSTOMER_CODE CUSTOMER_ID, upper(CUSTOMER_NAME) CUSTOMER_NAME, coalesce(CUSTOMER_TYPE, 'UNKNOWN') SEGMENT,
       cast(cast(CREDIT_LIMIT as decimal(38,9)) as varchar) CREDIT_LIMIT, cast(substr(PAYMENT_TERMS, 4) as bigint) TERMS_DAYS,
       'RAW' "SOURCE"
FROM raw_customer WHERE CREDIT_LIMIT > 0""", "raw_customer"))
def p16(ctx):
    """A declarative table mapping (source → target : type, static value, filter) executed as one select."""
    return apply_mapping(ctx.raw["raw_customer"], CUSTOMER_MAPPING)


ORDER_MAPPING = TableMapping(
    target_table="bl_order_line",
    fields=[FieldMapping("ORDER_ID", "STRING", "ORDER_ID", is_key=True),
            FieldMapping("LINE_NO", "INT64", "ORDER_LINE_NO", is_key=True),
            FieldMapping("ORDER_MONTH", "DATE", transform="trunc(TRANSACTION_DATE, 'MM')"),
            FieldMapping("STATUS", "STRING", "upper(ORDER_STATUS)", value="OPEN"),
            FieldMapping("QTY", "INT64", "ORDER_QTY"),
            FieldMapping("AMOUNT", "NUMERIC", "ORDER_VALUE"),
            FieldMapping("LOADED_AT", "TIMESTAMP", "LOAD_DATE")],
    filters=["ORDER_QTY > 0"], incremental_field="LOADED_AT", partition_fields=["ORDER_MONTH"])


@register("p16b_load_mapping", O.sql(f"""
SELECT ORDER_ID, LINE_NO, cast(ORDER_MONTH as varchar) ORDER_MONTH, STATUS, QTY,
       cast(AMOUNT as varchar) AMOUNT, {O.ts_text('LOADED_AT')} LOADED_AT
FROM (SELECT *, row_number() OVER (PARTITION BY ORDER_ID, LINE_NO ORDER BY LOADED_AT DESC NULLS LAST, ORDER_MONTH NULLS FIRST,
                                   STATUS NULLS FIRST, QTY NULLS FIRST, AMOUNT NULLS FIRST) rn
      FROM (SELECT ORDER_ID, cast(ORDER_LINE_NO as bigint) LINE_NO, cast(date_trunc('month', TRANSACTION_DATE) as date) ORDER_MONTH,
                   coalesce(upper(ORDER_STATUS), 'OPEN') STATUS, cast(ORDER_QTY as bigint) QTY,
                   cast(ORDER_VALUE as decimal(38,9)) AMOUNT, LOAD_DATE LOADED_AT
            FROM raw_order_line WHERE ORDER_QTY > 0) m) r WHERE rn = 1""", "raw_order_line"))
def p16b(ctx):
    """A mapping loaded twice into a month-partitioned table: the rows stamped before 1997, then the whole feed,
    of which only rows from the mark on are read and merged on the declared keys."""
    import os
    import uuid

    from ..session import scratch_root
    path = os.path.join(scratch_root(ctx.spark), f"mapped-{uuid.uuid4().hex}")
    feed = ctx.raw["raw_order_line"]
    load_mapping(feed.filter(F.col("LOAD_DATE") < F.lit("1997-01-01").cast("timestamp")), ORDER_MAPPING, path)
    load_mapping(feed, ORDER_MAPPING, path)
    return read_mapped(ctx.spark, ORDER_MAPPING, path)


@register("p17_literal_table", O.sql("""
SELECT m.code SELLING_METHOD_CODE, m.name SELLING_METHOD_NAME, cast(count(o.ORDER_ID) as bigint) order_lines
FROM (VALUES ('100', 'Wholesale'), ('200', 'Direct-to-Consumer'), ('300', 'E-Commerce'), ('400', 'Marketplace')) m(code, name)
LEFT JOIN raw_order_line o ON o.SELLING_METHOD_CODE = m.code GROUP BY ALL""", "raw_order_line"))
def p17(ctx):
    """The inline table of selling methods, joined to the order lines that use each one."""
    lit = P.literal_table(ctx.spark, list(P.SELLING_METHODS), "SELLING_METHOD_CODE string, SELLING_METHOD_NAME string")
    cnt = ctx.raw["raw_order_line"].groupBy("SELLING_METHOD_CODE").agg(F.count(F.lit(1)).alias("n"))
    j = lit.join(cnt, "SELLING_METHOD_CODE", "left")
    return j.select("SELLING_METHOD_CODE", "SELLING_METHOD_NAME",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("order_lines"))


@register("p18_price_order_lines", O.sql("""
SELECT ORDER_ID, ORDER_LINE_NO, cast(SELLING_PRICE as varchar) SELLING_PRICE, cast(ORDER_VALUE as varchar) ORDER_VALUE,
       cast(ORDER_LIST_VALUE as varchar) ORDER_LIST_VALUE FROM raw_order_line""", "raw_order_line"))
def p18(ctx):
    """Discounted price (rounded half-up to cents), line value and list value from list price and discount."""
    r = ctx.raw["raw_order_line"].select("ORDER_ID", "ORDER_LINE_NO", "ORDER_QTY", "LIST_PRICE", "DISCOUNT_PCT")
    return P.price_order_lines(r).select("ORDER_ID", "ORDER_LINE_NO", "SELLING_PRICE", "ORDER_VALUE",
                                         "ORDER_LIST_VALUE")


def _categorize_sql(x: str) -> str:
    m = f"lower({x})"
    return (f"case when contains({m}, 'float64') and contains({m}, 'numeric') then 'type_mismatch_float_numeric' "
            f"when contains({m}, 'not found') and (contains({m}, 'column') or contains({m}, 'name')) then 'column_not_found' "
            f"when contains({m}, 'not grouped') or contains({m}, 'not aggregated') then 'group_by_missing' "
            f"when contains({m}, 'syntax error') then 'syntax_error' "
            f"when contains({m}, 'duplicate') then 'duplicate_key' "
            f"when contains({m}, 'as') and contains({m}, 'values') then 'as_in_values' else 'other' end")


@register("p19_categorize_messages", O.sql(f"""
SELECT cast(doc_id as varchar) id, {_categorize_sql('text')} error_category FROM documents"""))
def p19(ctx):
    """Messages sorted into buckets by substring rules, first match wins (whole texts)."""
    return pipeline_lessons(ctx.spark, ctx.sf_dir).select("id", "error_category")
