"""CDL → BL marts (B1-B4) and a BR report.

Shape of every mart: pre-aggregate each fact to the mart grain (partial aggregates, so a hot key
costs one row per map task), join the aggregates (grain owner on the left, or FULL OUTER for
drill-across), look up names from the dimensions after aggregation, fill type defaults, conform to
the declared schema. ``build_mart`` adds the ADMIN block and merges into a target.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import add_admin, composite_hash, conform, fill_defaults, safe_divide
from ..operators.aggs import count_distinct
from ..operators.bitmaps import members, sets
from ..operators.filters import require_grain
from ..operators.joins import drill_across, enrich, grain_left_join, month_join
from ..operators.merge import MART_KEY, merge_mart
from ..operators.windows import current_price, dedup_latest
from ..sources import schemas as S

SALES_SUMMARY_GRAIN = ["KEY_CALENDAR", "KEY_PRODUCT", "KEY_COMPANY", "KEY_CUSTOMER", "KEY_SELLING_METHOD",
                       "TRANSACTION_DATE", "COMPANY_CODE", "SELLING_METHOD_CODE", "TOY_NO", "CUSTOMER_CODE",
                       "CURRENCY_CODE"]


def fact_sales_summary(sales: DataFrame, product: DataFrame, company: DataFrame,
                       approx_order_count: bool = False) -> DataFrame:
    """B1: per product, company, customer, method, date, currency: sums, ASP, average discount,
    distinct orders (exact by default; ``approx_order_count`` uses HyperLogLog++ for very large
    grains); names looked up; measures default 0."""
    g = sales.groupBy(*SALES_SUMMARY_GRAIN).agg(
        F.sum("ORDER_QTY").alias("TOTAL_ORDER_QTY"),
        F.sum("ORDER_VALUE").alias("TOTAL_ORDER_VALUE"),
        F.sum("ORDER_LIST_VALUE").alias("TOTAL_LIST_VALUE"),
        safe_divide(F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")), F.sum("ORDER_QTY")).alias("AVG_SELLING_PRICE"),
        (F.sum("DISCOUNT_PCT").cast("double") / F.count("DISCOUNT_PCT")).alias("AVG_DISCOUNT_PCT"),
        count_distinct("ORDER_ID", approx_order_count).alias("ORDER_COUNT"))
    # the join with the products shuffles the groups: what is looked up or computed after it is not moved
    g = enrich(g, product, "KEY_PRODUCT", ["PRODUCT_NAME", "CATEGORY", "BRAND"])
    g = enrich(g, company, "KEY_COMPANY", ["COMPANY_NAME"])
    g = g.withColumns({"TRANSACTION_YEAR": F.year("TRANSACTION_DATE"),
                       "TRANSACTION_MONTH": F.month("TRANSACTION_DATE")})
    return fill_defaults(conform(g, S.FACT_SALES_SUMMARY))


def fact_product_profitability(sales: DataFrame, returns: DataFrame, price: DataFrame, cost: DataFrame,
                               product: DataFrame, as_of, price_type: str = "LIST",
                               cost_type: str = "EX-FACTORY", abs_returns: bool = False) -> DataFrame:
    """B2: per product + company + currency: sales, returns, net, current list price and unit cost
    (valid on ``as_of``, T8), gross margin, margin % and return rate %.

    Returns are stored negative (T2): the literal formula ``net = sales - returns`` is the default;
    ``abs_returns`` subtracts their magnitude instead.
    """
    pc = ["KEY_PRODUCT", "KEY_COMPANY"]
    s = sales.groupBy(*pc, "TOY_NO", "DASH_CODE", "COMPANY_CODE", "CURRENCY_CODE").agg(
        F.sum("ORDER_QTY").alias("TOTAL_SALES_QTY"),
        F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")).alias("TOTAL_SALES_VALUE"),
        F.sum(F.col("ORDER_LIST_VALUE").cast("decimal(18,2)")).alias("TOTAL_LIST_VALUE"))
    r = returns.groupBy(*pc, "CURRENCY_CODE").agg(F.sum("RETURN_QTY").alias("TOTAL_RETURN_QTY"),
                                                  F.sum(F.col("RETURN_VALUE").cast("decimal(18,2)")).alias("TOTAL_RETURN_VALUE"))
    lp = current_price(price, as_of, "PRICE_TYPE", price_type).select(
        "KEY_PRODUCT", F.col("PRICE").alias("CURRENT_LIST_PRICE"))
    uc = current_price(cost, as_of, "COST_TYPE", cost_type).select(
        "KEY_PRODUCT", F.col("COST").alias("CURRENT_UNIT_COST"))
    j = grain_left_join(s, [r], [*pc, "CURRENCY_CODE"])
    j = j.join(lp, "KEY_PRODUCT", "left").join(uc, "KEY_PRODUCT", "left")
    j = enrich(j, product, "KEY_PRODUCT", ["PRODUCT_NAME", "CATEGORY", "BRAND"])
    j = fill_defaults(j, overrides={})
    zero_d = F.lit(0).cast("decimal(18,2)")
    rq = F.coalesce(F.col("TOTAL_RETURN_QTY"), F.lit(0))
    rv = F.coalesce(F.col("TOTAL_RETURN_VALUE"), zero_d)
    if abs_returns:
        rq, rv = F.abs(rq), F.abs(rv)
    cost_c = F.coalesce(F.col("CURRENT_UNIT_COST"), F.lit(0).cast(S.NUMERIC))
    j = j.withColumns({"NET_SALES_QTY": F.col("TOTAL_SALES_QTY") - rq,
                       "NET_SALES_VALUE": F.col("TOTAL_SALES_VALUE") - rv})
    j = j.withColumn("GROSS_MARGIN", (F.col("NET_SALES_VALUE")
                                      - F.col("NET_SALES_QTY").cast("decimal(20,0)") * cost_c).cast(S.NUMERIC))
    j = j.withColumns({
        "GROSS_MARGIN_PCT": safe_divide(F.col("GROSS_MARGIN"),
                                        F.col("NET_SALES_VALUE")) * F.lit(100.0),
        "RETURN_RATE_PCT": safe_divide(F.coalesce(F.col("TOTAL_RETURN_QTY"), F.lit(0)),
                                       F.col("TOTAL_SALES_QTY")) * F.lit(100.0)})
    return fill_defaults(conform(j, S.FACT_PRODUCT_PROFITABILITY))


FORECAST_GRAIN = ["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD", "AS_OF_DATE", "FORECAST_DATE",
                  "TOY_NO", "COMPANY_CODE", "SELLING_METHOD_CODE", "CURRENCY_CODE"]


def fact_demand_vs_sales(demand: DataFrame, sales_fc: DataFrame, sales: DataFrame, product: DataFrame,
                         company: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Demand plan and sales forecast drilled across on their grain (FULL OUTER), actual sales of
    the forecast month attached (month join), names looked up, variances and accuracy %.
    Actual sales repeat for every AS_OF_DATE snapshot of a month, so the mart is not additive over
    AS_OF_DATE (T17). ``keep`` may write the forecasts and the actual sales before they are joined."""
    fc = drill_across([
        (demand, [F.sum("DEMAND_PLAN_QTY").alias("DEMAND_PLAN_QTY"),
                  F.sum("DEMAND_PLAN_DRAFT_QTY").alias("DEMAND_PLAN_DRAFT_QTY")]),
        (sales_fc, [F.sum("SALES_FORECAST_QTY").alias("SALES_FORECAST_QTY"),
                    F.sum("SALES_FORECAST_STAGED_QTY").alias("SALES_FORECAST_STAGED_QTY")]),
    ], FORECAST_GRAIN)
    fc = keep(fc, "forecasts")
    act_keys = ["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD", "CURRENCY_CODE"]
    act = sales.groupBy(*act_keys,
                        F.trunc("TRANSACTION_DATE", "MM").alias("TX_MONTH")).agg(
        F.sum("ORDER_QTY").alias("ACTUAL_SALES_QTY"),
        F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")).alias("ACTUAL_SALES_VALUE"))
    j = month_join(fc, keep(act, "actual-sales"), act_keys, "FORECAST_DATE", "TX_MONTH")
    j = require_grain(j, ["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD", "AS_OF_DATE", "FORECAST_DATE"])
    j = enrich(j, product, "KEY_PRODUCT", ["PRODUCT_NAME", "CATEGORY", "BRAND"])
    j = enrich(j, company, "KEY_COMPANY", ["COMPANY_NAME"])
    j = j.withColumns({"FORECAST_YEAR": F.year("FORECAST_DATE"), "FORECAST_MONTH": F.month("FORECAST_DATE")})
    j = fill_defaults(conform(j, S.FACT_DEMAND_VS_SALES))
    a, d, f = F.col("ACTUAL_SALES_QTY"), F.col("DEMAND_PLAN_QTY"), F.col("SALES_FORECAST_QTY")
    j = j.withColumns({
        "DEMAND_VS_ACTUAL_VARIANCE": d - a,
        "FORECAST_VS_ACTUAL_VARIANCE": f - a,
        "DEMAND_ACCURACY_PCT": F.coalesce(safe_divide(a * 100.0, d), F.lit(0.0)).cast(S.NUMERIC),
        "FORECAST_ACCURACY_PCT": F.coalesce(safe_divide(a * 100.0, f), F.lit(0.0)).cast(S.NUMERIC)})
    return conform(j, S.FACT_DEMAND_VS_SALES)


def build_mart(df: DataFrame, keys: list[str], required: list[str], run_ts: dt.datetime,
               source_system: str, target: DataFrame | None = None, schema=None,
               order: list[Column] | None = None) -> DataFrame:
    """The common tail of every mart: DISTINCT → latest per key → defaults → ADMIN → MERGE.

    Planned as: defaults and the composite-key hash first, then one row per hash (W1 with a
    total tie-break over the data columns), then the rest of the ADMIN block, which is so not shuffled. Keeping one row per
    key subsumes DISTINCT (identical rows share their key), and deduplicating on the hash — the MERGE key — leaves the
    source partitioned exactly as the MERGE join needs it, so the only shuffles are the W1 exchange and the target's side.
    """
    x = fill_defaults(df if schema is None else conform(df, schema))
    data_cols = list(x.columns)
    x = x.withColumn(MART_KEY, composite_hash(keys))
    ties = [F.col(c).asc_nulls_first() for c in data_cols]
    x = dedup_latest(x, [MART_KEY], list(order or []) + ties, tie_break=False)
    x = add_admin(x, keys, required, run_ts, source_system, keyed=True)
    return merge_mart(target, x, run_ts, unique_source=True)


@dataclass
class Lookup:
    """A frame made from one conformed table (and the parameters), looked up by the touch key columns ``on``."""
    table: str
    on: list[str]
    frame: Callable[[DataFrame, dict], DataFrame]


@dataclass
class Incremental:
    """How a mart follows its conformed tables.

    ``rows`` makes mart rows from the tables given by name. ``facts`` names, per fact, the touch key: expressions
    (by name) over the fact's columns, the same names for every fact. All rows of a mart group share one touch
    key, so the groups of a touched key can be recomputed from the facts' rows with that key alone.
    ``lookups`` are the frames whose rows the mart looks up; ``month`` is the touch key, if any, that is also the month the facts are kept by. ``params``
    is handed to the lookups: a changed parameter touches what it looks up differently.
    """
    rows: Callable[[dict[str, DataFrame], dict], DataFrame]
    facts: dict[str, dict[str, str]]
    lookups: dict[str, Lookup] = field(default_factory=dict)
    month: str | None = None
    params: dict[str, str] = field(default_factory=dict)

    def tables(self) -> set[str]:
        """The conformed tables whose changes the mart follows."""
        return {*self.facts, *(look.table for look in self.lookups.values())}


# Margin bands of the company/category report (percent thresholds).
MARGIN_BANDS = ((40.0, "HIGH"), (20.0, "MEDIUM"))


ORDER_SET_GRAIN = ["TX_MONTH", "COMPANY_CODE", "CATEGORY"]


def order_sets(sales: DataFrame, product: DataFrame, numbers: DataFrame) -> DataFrame:
    """The orders of each month, company and category as mergeable sets (``operators.bitmaps``): an order with
    several lines, products or days counts once in whatever the sets are rolled up to. ``numbers`` is the dictionary
    ORDER_ID → ORDER_NO. Lines shrink to one row per order, company and category before they meet the dictionary."""
    lines = sales.select("ORDER_ID", "COMPANY_CODE", "KEY_PRODUCT", F.trunc("TRANSACTION_DATE", "MM").alias("TX_MONTH")).distinct()
    named = fill_defaults(enrich(lines, product, "KEY_PRODUCT", ["CATEGORY"])).select(*ORDER_SET_GRAIN, "ORDER_ID").distinct()
    return sets(named.join(numbers, "ORDER_ID"), ORDER_SET_GRAIN, "ORDER_NO")


def company_category_report(summary: DataFrame, profitability: DataFrame, orders: DataFrame,
                            keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """BR report: per company and category, sales from the summary mart joined to margin from the
    profitability mart (each aggregated to the report grain first) and to the number of distinct orders
    (``order_sets`` rolled up: counts per product or day do not add up), with a CASE band. ``keep`` may write each part
    (as many rows as the report) before the next is computed."""
    grain = ["COMPANY_CODE", "CATEGORY"]
    s = summary.groupBy(*grain).agg(F.sum("TOTAL_ORDER_QTY").alias("ORDER_QTY"),
                                    F.sum(F.col("TOTAL_ORDER_VALUE").cast("decimal(18,2)")).alias("ORDER_VALUE"))
    s = keep(s, "report-sales").join(keep(members([orders], grain, "ORDERS"), "report-orders"), grain, "left")
    p = profitability.groupBy(*grain).agg(
        F.sum(F.col("NET_SALES_VALUE").cast("decimal(18,2)")).alias("NET_SALES_VALUE"),
        F.sum(F.col("GROSS_MARGIN").cast("decimal(20,2)")).alias("GROSS_MARGIN"))
    j = s.join(keep(p, "report-margin"), grain, "left")
    pct = safe_divide(F.col("GROSS_MARGIN"), F.col("NET_SALES_VALUE")) * F.lit(100.0)
    band = F.when(pct.isNull(), F.lit("N/A"))
    for threshold, name in MARGIN_BANDS:
        band = band.when(pct >= threshold, F.lit(name))
    return j.withColumns({"GROSS_MARGIN_PCT": pct, "MARGIN_BAND": band.otherwise(F.lit("LOW"))})


def incremental_marts(as_of: str) -> dict[str, Incremental]:
    """How the three marts follow the conformed tables.

    A sales summary group lies in one product, company and month, a demand group in one product, company, method,
    currency and month, so both read the touched months alone. A profitability group sums all months
    of a product, company and currency, so it reads their rows in every month. A new price, cost or name touches the
    groups of its product or company; a new ``as_of`` those whose valid price or cost is another one.
    """
    def names(table: str, key: str, cols: list[str]):
        return Lookup(table, [key], lambda t, _: t.select(key, *cols))

    def valid(table: str, type_col: str, wanted: str, value: str):
        return Lookup(table, ["KEY_PRODUCT"], lambda t, p: current_price(t, F.lit(p["as_of"]).cast("date"), type_col, wanted).select("KEY_PRODUCT", value))

    product = names("cdl_dim_product", "KEY_PRODUCT", ["PRODUCT_NAME", "CATEGORY", "BRAND"])
    company = names("cdl_dim_company", "KEY_COMPANY", ["COMPANY_NAME"])
    pair = {c: c for c in ("KEY_PRODUCT", "KEY_COMPANY")}
    line = pair | {"KEY_SELLING_METHOD": "KEY_SELLING_METHOD", "CURRENCY_CODE": "CURRENCY_CODE"}
    month = "trunc({}, 'MM')"
    return {
        "fact_sales_summary": Incremental(
            lambda t, _: fact_sales_summary(t["cdl_fact_sales"], t["cdl_dim_product"], t["cdl_dim_company"]),
            {"cdl_fact_sales": pair | {"MONTH": month.format("TRANSACTION_DATE")}}, {"product": product, "company": company}, "MONTH"),
        "fact_product_profitability": Incremental(
            lambda t, p: fact_product_profitability(t["cdl_fact_sales"], t["cdl_fact_returns"], t["cdl_fact_product_price"],
                                                    t["cdl_fact_product_cost"], t["cdl_dim_product"], F.lit(p["as_of"]).cast("date")),
            {t: pair | {"CURRENCY_CODE": "CURRENCY_CODE"} for t in ("cdl_fact_sales", "cdl_fact_returns")},
            {"product": product, "price": valid("cdl_fact_product_price", "PRICE_TYPE", "LIST", "PRICE"),
             "cost": valid("cdl_fact_product_cost", "COST_TYPE", "EX-FACTORY", "COST")}, params={"as_of": as_of}),
        "fact_demand_vs_sales": Incremental(
            lambda t, _: fact_demand_vs_sales(t["cdl_fact_demand_forecast"], t["cdl_fact_sales_forecast"], t["cdl_fact_sales"],
                                              t["cdl_dim_product"], t["cdl_dim_company"]),
            {"cdl_fact_sales": line | {"MONTH": month.format("TRANSACTION_DATE")},
             "cdl_fact_demand_forecast": line | {"MONTH": month.format("FORECAST_DATE")},
             "cdl_fact_sales_forecast": line | {"MONTH": month.format("FORECAST_DATE")}},
            {"product": product, "company": company}, "MONTH"),
    }
