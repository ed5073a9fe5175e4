"""Adapters from the driver's TPC-H-style tables to the nine RAW tables and the three ops logs.

Deterministic rules only: every RAW row is derived from rows of the given tables, so the work of
every downstream query grows with them. Money is computed in integer cents and then turned into
exact decimals, so the result does not depend on floating-point rounding of either engine.
"""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import categorize_messages
from ..sources.schemas import NUMERIC

# Load stamp of the static RAW tables (master data, prices, forecasts).
STATIC_LOAD_TS = dt.datetime(2001, 12, 31, 0, 0, 0)
# Currency of a company, by the region key of its nation.
REGION_CURRENCY = ((0, "ZAR"), (1, "USD"), (2, "JPY"), (3, "EUR"), (4, "AED"))
# Price and cost types with their share of the retail price, in percent.
PRICE_TYPES = (("LIST", 100), ("EST_INVOICE", 80))
COST_TYPES = (("EX-FACTORY", 40), ("WORLDWIDE", 50))
# One cent.
CENT = decimal.Decimal("0.01")
# Yearly price increase in percent points per year after the first year.
YEARLY_STEP_PCT = 2
# Return reasons, chosen by part key modulo 4.
RETURN_REASONS = ("DEFECTIVE", "WRONG_ITEM", "CUSTOMER_CHANGE", "DAMAGED_SHIPPING")
# Payment terms, chosen by customer key modulo 3.
PAYMENT_TERMS = ("NET30", "NET60", "NET90")
# Artifact status of each event type.
EVENT_STATUS = (("purchase", "passed"), ("click", "executed"), ("view", "testing"),
                ("signup", "generated"), ("error", "failed"))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, pairs, default) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def _code(prefix: str, key: Column, width: int) -> Column:
    # zero-padded, never truncated (lpad would cut keys wider than ``width`` and collide); a format is parsed and
    # run per row, so only keys that lpad cannot write take it
    k = key.cast("bigint")
    return F.when(k.between(0, 10 ** width - 1), F.concat(F.lit(prefix), F.lpad(k.cast("string"), width, "0"))).otherwise(
        F.format_string(f"{prefix}%0{width}d", k))


def _cents_to_decimal(cents: Column) -> Column:
    # a product by 0.01 is exact and takes no division; a value too large fails in the first cast
    return (cents.cast("decimal(18,0)") * F.lit(CENT)).cast("decimal(18,2)").cast(NUMERIC)


def _static_ts() -> Column:
    return F.lit(STATIC_LOAD_TS).cast("timestamp")


def company_code(nationkey: Column) -> Column:
    return _code("N", nationkey, 2)


def raw_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    # region has one row per region (5 in TPC-H at every scale): a bounded broadcast.
    j = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
    return j.select(
        company_code(F.col("n_nationkey")).alias("COMPANY_CODE"),
        F.concat(F.lit("Company "), F.col("n_name")).alias("COMPANY_NAME"),
        F.col("r_name").alias("REGION"),
        _case(F.col("n_regionkey"), REGION_CURRENCY, "USD").alias("CURRENCY_CODE"),
        F.substring("r_name", 1, 4).alias("GEOGRAPHIC_SECURITY_CODE"),
        F.col("n_name").alias("COUNTRY"),
        F.lit("ACTIVE").alias("STATUS"),
        _static_ts().alias("LOAD_DATE"),
    )


def raw_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        _code("CUST", F.col("c_custkey"), 9).alias("CUSTOMER_CODE"),
        F.col("c_name").alias("CUSTOMER_NAME"),
        F.col("c_mktsegment").alias("CUSTOMER_TYPE"),
        F.lit("ACTIVE").alias("STATUS"),
        F.floor("c_acctbal").cast("bigint").alias("CREDIT_LIMIT"),
        _case(F.col("c_custkey") % 3, list(enumerate(PAYMENT_TERMS)), PAYMENT_TERMS[-1]).alias("PAYMENT_TERMS"),
        _static_ts().alias("LOAD_DATE"),
    )


def _toy_no(partkey: Column) -> Column:
    return _code("P", partkey, 8)


def _dash_code(size: Column) -> Column:
    return (size % 6).cast("string")


def raw_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        _toy_no(F.col("p_partkey")).alias("TOY_NO"),
        _dash_code(F.col("p_size")).alias("DASH_CODE"),
        F.col("p_name").alias("PRODUCT_NAME"),
        F.col("p_type").alias("CATEGORY"),
        F.col("p_brand").alias("BRAND"),
        F.when(F.col("p_size") > 45, F.lit("DISCONTINUED")).otherwise(F.lit("ACTIVE")).alias("STATUS"),
        F.make_date(F.lit(1994), (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1)).alias("LAUNCH_DATE"),
        (F.col("p_size").cast("decimal(10,0)") / F.lit(10)).cast(NUMERIC).alias("WEIGHT_KG"),
        _static_ts().alias("LOAD_DATE"),
    )


def _order_id(key: Column) -> Column:
    return F.concat(F.lit("ORD-"), key.cast("string"))


def order_lines_joined(spark: SparkSession, sf_dir: str, by_order_id: bool = False) -> DataFrame:
    """lineitem ⋈ (orders ⋈ customer ⋈ nation) ⋈ part, with the columns the RAW rules need.

    The lookups of an order are joined before its lines, so that the lines are shuffled by the order and by the
    part key and not by the customer key too.

    lineitem ⋈ orders is a sort-merge join on the order key at every scale (the ``merge`` hint):
    at scale both sides are far above any broadcast bound, and on small inputs a single-row-group
    file would otherwise pin the whole scan-join-hash pipeline to one task until the first shuffle.
    customer and part are shuffled or broadcast depending on their (estimated or, with AQE,
    measured) size; nation is 25 rows at every scale and is broadcast.

    With ``by_order_id`` the parts are looked up first and lines and orders are joined last, by the text of the order
    key (one text per key, so the rows are the same): the rows then lie by ORDER_ID, and what is grouped or ranked by
    ORDER_ID and more columns needs no shuffle of the wide RAW rows.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
        "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    o = o.join(c, F.col("o_custkey") == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    if by_order_id:
        li = li.join(p, li.l_partkey == p.p_partkey).withColumn("_order", _order_id(F.col("l_orderkey"))).drop("l_orderkey")
        o = o.withColumn("ORDER_ID", _order_id(F.col("o_orderkey"))).drop("o_orderkey", "o_custkey")
        return li.join(o.hint("merge"), F.col("_order") == F.col("ORDER_ID"))
    return li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)


def _selling_method() -> Column:
    prio = F.substring("o_orderpriority", 1, 1)
    return F.when(prio == "1", "100").when(prio == "2", "200").when(prio == "3", "300").otherwise("400")


def _currency() -> Column:
    return _case(F.col("n_regionkey"), REGION_CURRENCY, "USD")


def _order_line_cols(j: DataFrame) -> list[Column]:
    disc = F.round(F.col("l_discount") * 100).cast("bigint")
    list_cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    sell_cents = F.floor((list_cents * (F.lit(100) - disc) + F.lit(50)) / F.lit(100)).cast("bigint")
    qty = F.col("l_quantity").cast("bigint")
    return [
        F.col("ORDER_ID") if "ORDER_ID" in j.columns else _order_id(F.col("o_orderkey")).alias("ORDER_ID"),
        F.col("l_linenumber").cast("bigint").alias("ORDER_LINE_NO"),
        F.col("o_orderdate").cast("date").alias("TRANSACTION_DATE"),
        company_code(F.col("c_nationkey")).alias("COMPANY_CODE"),
        _selling_method().alias("SELLING_METHOD_CODE"),
        _code("CUST", F.col("c_custkey"), 9).alias("CUSTOMER_CODE"),
        _toy_no(F.col("p_partkey")).alias("TOY_NO"),
        _dash_code(F.col("p_size")).alias("DASH_CODE"),
        F.when(F.col("l_linestatus") == "F", "INVOICED").otherwise("SHIPPED").alias("ORDER_STATUS"),
        F.when(F.col("o_orderstatus") == "F", "STANDARD").when(F.col("o_orderstatus") == "O", "RUSH")
         .otherwise("BACKORDER").alias("ORDER_TYPE"),
        qty.alias("ORDER_QTY"),
        _cents_to_decimal(list_cents).alias("LIST_PRICE"),
        _cents_to_decimal(sell_cents).alias("SELLING_PRICE"),
        disc.alias("DISCOUNT_PCT"),
        _cents_to_decimal(qty * sell_cents).alias("ORDER_VALUE"),
        _cents_to_decimal(qty * list_cents).alias("ORDER_LIST_VALUE"),
        _currency().alias("CURRENCY_CODE"),
        F.col("l_shipdate").cast("timestamp").alias("LOAD_DATE"),
    ]


def raw_order_line(spark: SparkSession, sf_dir: str, by_order_id: bool = True) -> DataFrame:
    j = order_lines_joined(spark, sf_dir, by_order_id)
    return j.select(_order_line_cols(j))


def raw_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = order_lines_joined(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    ol = j.select(*_order_line_cols(j), "l_partkey", "o_orderkey", "l_shipdate")
    rqty = -F.greatest(F.lit(1), F.floor(F.col("ORDER_QTY") / 4).cast("bigint"))
    rdate = F.date_add(F.col("l_shipdate").cast("date"), 30)
    return ol.select(
        F.concat(F.lit("RET-"), F.col("o_orderkey").cast("string")).alias("RETURN_ID"),
        "ORDER_ID", "ORDER_LINE_NO",
        rdate.alias("RETURN_DATE"),
        "COMPANY_CODE", "TOY_NO", "DASH_CODE",
        rqty.alias("RETURN_QTY"),
        (rqty.cast("decimal(20,0)") * F.col("SELLING_PRICE")).cast("decimal(18,2)").cast(NUMERIC)
        .alias("RETURN_VALUE"),
        _case(F.col("l_partkey") % 4, list(enumerate(RETURN_REASONS)), RETURN_REASONS[-1]).alias("RETURN_REASON"),
        "CURRENCY_CODE",
        rdate.cast("timestamp").alias("LOAD_DATE"),
    )


def order_year_bounds(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last order year as scalar subqueries (evaluated once, no driver round trip)."""
    o = read_table(spark, sf_dir, "orders")
    return (o.select(F.year(F.min("o_orderdate"))).scalar(), o.select(F.year(F.max("o_orderdate"))).scalar())


#: Parts that a task takes before each becomes one row per year and type: bounds the sort of a merge key's rows
#: below its shuffle, which otherwise holds all rows of a file of one split.
PARTS_A_TASK = 25_000


def spread(df: DataFrame, key: str, rows_a_task: int) -> DataFrame:
    """``df`` dealt out by ``key`` to tasks of about ``rows_a_task`` rows (counted from the files' footers); AQE
    leaves their number alone. Rows of one task stay where they are."""
    tasks = -(-df.count() // rows_a_task)
    return df.repartition(tasks, key) if tasks > 1 else df


def _yearly(spark: SparkSession, sf_dir: str, types, type_col: str, value_col: str) -> DataFrame:
    from ..operators.spines import yearly_intervals
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    y0, y1 = order_year_bounds(spark, sf_dir)
    grid = yearly_intervals(spread(p, "p_partkey", PARTS_A_TASK), y0, y1, [t for t, _ in types], type_col)
    pct = _case(F.col(type_col), types, 100)
    retail_cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    growth = F.lit(100) + F.lit(YEARLY_STEP_PCT) * (F.year("EFFECTIVE_DATE") - y0)
    cents = F.floor((retail_cents * pct * growth + F.lit(5000)) / F.lit(10000)).cast("bigint")
    return grid.select(
        _toy_no(F.col("p_partkey")).alias("TOY_NO"),
        _dash_code(F.col("p_size")).alias("DASH_CODE"),
        F.col(type_col),
        _cents_to_decimal(cents).alias(value_col),
        F.lit("USD").alias("CURRENCY_CODE"),
        "EFFECTIVE_DATE", "EXPIRY_DATE",
        _static_ts().alias("LOAD_DATE"),
    )


def raw_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yearly(spark, sf_dir, PRICE_TYPES, "PRICE_TYPE", "PRICE")


def raw_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yearly(spark, sf_dir, COST_TYPES, "COST_TYPE", "COST")


def monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantity per product, company, method, currency and month. Grouped by the short columns that the codes
    are made from (one code per value, so the groups are the same): nearly every line is a group of its own, and
    what a task and a shuffle hold is the width of a group."""
    short = order_lines_joined(spark, sf_dir).select(
        F.col("p_partkey").cast("bigint").alias("_part"), (F.col("p_size") % 6).alias("_dash"), F.col("c_nationkey").alias("_nation"),
        _selling_method().alias("SELLING_METHOD_CODE"), _currency().alias("CURRENCY_CODE"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("MONTH"), F.col("l_quantity").cast("bigint").alias("_qty"))
    g = short.groupBy("_part", "_dash", "_nation", "SELLING_METHOD_CODE", "CURRENCY_CODE", "MONTH").agg(F.sum("_qty").alias("QTY"))
    return g.select(_toy_no(F.col("_part")).alias("TOY_NO"), F.col("_dash").cast("string").alias("DASH_CODE"),
                    company_code(F.col("_nation")).alias("COMPANY_CODE"), "SELLING_METHOD_CODE", "CURRENCY_CODE", "MONTH", "QTY")


def _forecast_id(prefix: str, month: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), F.col("TOY_NO"), F.col("DASH_CODE"), F.col("COMPANY_CODE"),
                       F.col("SELLING_METHOD_CODE"), F.date_format(month, "yyyyMM"))


def raw_demand_forecast(m: DataFrame) -> DataFrame:
    """From the monthly lines."""
    return m.select(
        _forecast_id("DF", F.col("MONTH")).alias("FORECAST_ID"),
        F.date_sub("MONTH", 1).alias("AS_OF_DATE"),
        F.col("MONTH").alias("FORECAST_DATE"),
        "COMPANY_CODE", "SELLING_METHOD_CODE", "TOY_NO", "DASH_CODE",
        F.floor(F.col("QTY") * 110 / 100).cast("bigint").alias("DEMAND_PLAN_QTY"),
        F.floor(F.col("QTY") * 105 / 100).cast("bigint").alias("DEMAND_PLAN_DRAFT_QTY"),
        F.lit("G").alias("LINE_OF_BUSINESS_CODE"),
        "CURRENCY_CODE",
        _static_ts().alias("LOAD_DATE"),
    )


def raw_sales_forecast(m: DataFrame) -> DataFrame:
    """From the monthly lines, one month ahead."""
    m = m.withColumn("FMONTH", F.add_months("MONTH", 1))
    return m.select(
        _forecast_id("SF", F.col("FMONTH")).alias("FORECAST_ID"),
        F.date_sub("FMONTH", 1).alias("AS_OF_DATE"),
        F.col("FMONTH").alias("FORECAST_DATE"),
        "COMPANY_CODE", "SELLING_METHOD_CODE", "TOY_NO", "DASH_CODE",
        F.floor(F.col("QTY") * 90 / 100).cast("bigint").alias("SALES_FORECAST_QTY"),
        F.floor(F.col("QTY") * 85 / 100).cast("bigint").alias("SALES_FORECAST_STAGED_QTY"),
        "CURRENCY_CODE",
        _static_ts().alias("LOAD_DATE"),
    )


#: What both forecasts are made from, beside the RAW tables.
MONTHLY = "monthly_lines"

RAW_BUILDERS = {
    "raw_company": raw_company, "raw_customer": raw_customer, "raw_product": raw_product,
    "raw_price": raw_price, "raw_cost": raw_cost, "raw_order_line": raw_order_line, "raw_return": raw_return,
    MONTHLY: monthly_lines,
}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine RAW tables (and the monthly lines), each defined on first access."""
    from ..plans.cdl import LazyTables
    tables = LazyTables({name: (lambda fn=fn: fn(spark, sf_dir)) for name, fn in RAW_BUILDERS.items()} | {
        "raw_demand_forecast": lambda: raw_demand_forecast(tables[MONTHLY]),
        "raw_sales_forecast": lambda: raw_sales_forecast(tables[MONTHLY])})
    return tables


# ---------------------------------------------------------------- operational logs from events/documents
def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    is_err = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("ts").cast("timestamp").alias("run_timestamp"),
        F.col("event_type").alias("step"),
        F.concat(F.lit("table_"), (F.col("event_id") % 7).cast("string")).alias("table_name"),
        F.when(is_err, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.col("event_id").alias("rows_affected"),
        F.col("value").alias("duration_seconds"),
        F.when(is_err, F.col("props")).alias("error_message"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def pipeline_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("artifact_id"),
        F.concat(F.lit("mart_"), F.col("user_id").cast("string"), F.lit(".yaml")).alias("filename"),
        F.concat(F.lit("mart_"), F.col("user_id").cast("string")).alias("target_table"),
        F.col("props").alias("yaml_content"),
        (F.col("event_id") % 5).alias("version"),
        _case(F.col("event_type"), EVENT_STATUS, "failed").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
        F.lit(None).cast("string").alias("test_definitions"),
        F.lit(None).cast("string").alias("test_results"),
        (F.col("event_id") % 5).alias("attempt_number"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


def pipeline_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("context"),
        F.col("text").alias("error_message"),
        F.col("lang").alias("fix_description"),
        categorize_messages(F.col("text")).alias("error_category"),
        _static_ts().alias("created_at"),
    )
