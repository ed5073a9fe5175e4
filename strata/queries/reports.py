"""Q1-Q5: analytics previews over the conformed layer."""

from __future__ import annotations

from .. import oracle_sql as O
from ..plans import reports as R
from ..registry import register

_M = "cast(count(*) as bigint) order_lines, cast(sum(s.ORDER_QTY) as bigint) total_qty, " \
     "cast(cast(sum(cast(s.ORDER_VALUE as decimal(18,2))) as decimal(18,2)) as varchar) total_value"


@register("q1_sales_by_company", O.sql(f"""
SELECT c.COMPANY_CODE, c.COMPANY_NAME, c.REGION, {_M}
FROM cdl_fact_sales s JOIN cdl_dim_company c ON s.KEY_COMPANY = c.KEY_COMPANY
GROUP BY c.COMPANY_CODE, c.COMPANY_NAME, c.REGION""", "cdl_fact_sales", "cdl_dim_company"))
def q1(ctx):
    """Q1: sales by company."""
    return R.sales_by_company(ctx.cdl["cdl_fact_sales"], ctx.cdl["cdl_dim_company"])


@register("q2_sales_by_category_brand", O.sql(f"""
SELECT p.CATEGORY, p.BRAND, {_M}
FROM cdl_fact_sales s JOIN cdl_dim_product p ON s.KEY_PRODUCT = p.KEY_PRODUCT
GROUP BY p.CATEGORY, p.BRAND""", "cdl_fact_sales", "cdl_dim_product"))
def q2(ctx):
    """Q2: sales by category and brand."""
    return R.sales_by_category_brand(ctx.cdl["cdl_fact_sales"], ctx.cdl["cdl_dim_product"])


@register("q3_sales_by_selling_method", O.sql(f"""
SELECT sm.SELLING_METHOD_CODE, sm.SELLING_METHOD_NAME, {_M}
FROM cdl_fact_sales s JOIN cdl_dim_selling_method sm ON s.KEY_SELLING_METHOD = sm.KEY_SELLING_METHOD
GROUP BY sm.SELLING_METHOD_CODE, sm.SELLING_METHOD_NAME""", "cdl_fact_sales", "cdl_dim_selling_method"))
def q3(ctx):
    """Q3: sales by selling method."""
    return R.sales_by_selling_method(ctx.cdl["cdl_fact_sales"], ctx.cdl["cdl_dim_selling_method"])


@register("q4_monthly_sales_trend", O.sql(f"""
SELECT cast(year(s.TRANSACTION_DATE) as bigint) AS "year", cast(month(s.TRANSACTION_DATE) as bigint) AS "month", {_M}
FROM cdl_fact_sales s GROUP BY 1, 2""", "cdl_fact_sales"))
def q4(ctx):
    """Q4: monthly sales trend."""
    return R.monthly_sales_trend(ctx.cdl["cdl_fact_sales"])


def _q5_sql(as_written: bool, abs_returns: bool) -> str:
    num = "abs(coalesce(sum(r.RETURN_QTY), 0))" if abs_returns else "coalesce(sum(r.RETURN_QTY), 0)"
    if as_written:
        src = """FROM cdl_fact_sales s JOIN cdl_dim_product p ON s.KEY_PRODUCT = p.KEY_PRODUCT
LEFT JOIN cdl_fact_returns r ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.KEY_COMPANY = r.KEY_COMPANY"""
        sold = "sum(s.ORDER_QTY)"
    else:
        src = """FROM (SELECT KEY_PRODUCT, KEY_COMPANY, sum(ORDER_QTY) ORDER_QTY FROM cdl_fact_sales GROUP BY ALL) s
JOIN cdl_dim_product p ON s.KEY_PRODUCT = p.KEY_PRODUCT
LEFT JOIN (SELECT KEY_PRODUCT, KEY_COMPANY, sum(RETURN_QTY) RETURN_QTY FROM cdl_fact_returns GROUP BY ALL) r
  ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.KEY_COMPANY = r.KEY_COMPANY"""
        sold = "sum(s.ORDER_QTY)"
    return O.sql(f"""
SELECT TOY_NO, PRODUCT_NAME, BRAND, sold_qty, returned_qty, return_rate_pct FROM (
SELECT p.TOY_NO, p.PRODUCT_NAME, p.BRAND, cast({sold} as bigint) sold_qty,
       cast(coalesce(sum(r.RETURN_QTY), 0) as bigint) returned_qty,
       case when {sold} = 0 then NULL
            else cast({num} as double) * 100.0 / cast({sold} as double) end return_rate_pct
{src}
GROUP BY p.TOY_NO, p.PRODUCT_NAME, p.BRAND HAVING {sold} > 0) t
ORDER BY return_rate_pct DESC NULLS LAST, TOY_NO, PRODUCT_NAME, BRAND LIMIT 10""",
                 "cdl_fact_sales", "cdl_dim_product", "cdl_fact_returns")


@register("q5_top_return_rate", _q5_sql(True, False))
def q5(ctx):
    """Q5: top-10 return rate, as written (row-level join, inflated sums; T3) — computed without fan-out."""
    return R.top_return_rate(ctx.cdl["cdl_fact_sales"], ctx.cdl["cdl_fact_returns"], ctx.cdl["cdl_dim_product"])


@register("q5b_top_return_rate_preaggregated", _q5_sql(False, False))
def q5b(ctx):
    """Q5 variant: facts pre-aggregated to product+company before the join (no inflation)."""
    return R.top_return_rate(ctx.cdl["cdl_fact_sales"], ctx.cdl["cdl_fact_returns"], ctx.cdl["cdl_dim_product"],
                             as_written=False)


@register("q5c_top_return_rate_abs", _q5_sql(False, True))
def q5c(ctx):
    """Q5 variant: pre-aggregated, ranked by the magnitude of the negatively stored returns."""
    return R.top_return_rate(ctx.cdl["cdl_fact_sales"], ctx.cdl["cdl_fact_returns"], ctx.cdl["cdl_dim_product"],
                             as_written=False, abs_returns=True)
