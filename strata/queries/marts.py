"""Business marts and a report over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as O
from ..plans import marts as M
from ..registry import register
from ..sources import schemas as S
from ..sources.testdata import MONTHLY

_CDL = ("cdl_fact_sales", "cdl_dim_product", "cdl_dim_company")

O.cte("b1_mart", """
SELECT g.*, cast(year(TRANSACTION_DATE) as bigint) TRANSACTION_YEAR, cast(month(TRANSACTION_DATE) as bigint) TRANSACTION_MONTH,
       coalesce(c.COMPANY_NAME, 'N/A') COMPANY_NAME, coalesce(p.PRODUCT_NAME, 'N/A') PRODUCT_NAME,
       coalesce(p.CATEGORY, 'N/A') CATEGORY, coalesce(p.BRAND, 'N/A') BRAND
FROM (SELECT KEY_CALENDAR, KEY_PRODUCT, KEY_COMPANY, KEY_CUSTOMER, KEY_SELLING_METHOD, TRANSACTION_DATE, COMPANY_CODE,
             SELLING_METHOD_CODE, TOY_NO, CUSTOMER_CODE, CURRENCY_CODE,
             sum(ORDER_QTY) TOTAL_ORDER_QTY, sum(ORDER_VALUE) TOTAL_ORDER_VALUE, sum(ORDER_LIST_VALUE) TOTAL_LIST_VALUE,
             coalesce(case when sum(ORDER_QTY) = 0 then NULL
                  else cast(sum(cast(ORDER_VALUE as decimal(18,2))) as double) / cast(sum(ORDER_QTY) as double) end, 0)
               AVG_SELLING_PRICE,
             coalesce(cast(sum(DISCOUNT_PCT) as double) / count(DISCOUNT_PCT), 0) AVG_DISCOUNT_PCT,
             count(DISTINCT ORDER_ID) ORDER_COUNT
      FROM cdl_fact_sales GROUP BY ALL) g
LEFT JOIN cdl_dim_company c ON g.KEY_COMPANY = c.KEY_COMPANY
LEFT JOIN cdl_dim_product p ON g.KEY_PRODUCT = p.KEY_PRODUCT""", *_CDL)


@register("b1_fact_sales_summary", O.sql(f"SELECT {O.render(S.FACT_SALES_SUMMARY)} FROM b1_mart", "b1_mart"))
def b1(ctx):
    """B1: fact_sales_summary."""
    c = ctx.cdl
    return M.fact_sales_summary(c["cdl_fact_sales"], c["cdl_dim_product"], c["cdl_dim_company"])


AS_OF_SQL = "(SELECT max(cast(o_orderdate as date)) FROM orders)"


def as_of_latest_order(ctx):
    """The as-of date used by the registry (T8: a required argument): the latest order date.

    A scalar subquery over one column of ``orders`` (answered from Parquet statistics at scale), not
    over the conformed fact, which would re-run its whole deduplicating pipeline just for a date."""
    return ctx.table("orders").select(F.max("o_orderdate").cast("date")).scalar()


O.cte("b2_mart", """
SELECT s.KEY_PRODUCT, s.KEY_COMPANY, s.TOY_NO, s.DASH_CODE, coalesce(p.PRODUCT_NAME, 'N/A') PRODUCT_NAME,
       coalesce(p.CATEGORY, 'N/A') CATEGORY, coalesce(p.BRAND, 'N/A') BRAND, s.COMPANY_CODE, s.CURRENCY_CODE,
       s.TOTAL_SALES_QTY, s.TOTAL_SALES_VALUE, s.TOTAL_LIST_VALUE, coalesce(r.TOTAL_RETURN_QTY, 0) TOTAL_RETURN_QTY,
       coalesce(r.TOTAL_RETURN_VALUE, 0) TOTAL_RETURN_VALUE,
       s.TOTAL_SALES_QTY - coalesce(r.TOTAL_RETURN_QTY, 0) NET_SALES_QTY,
       s.TOTAL_SALES_VALUE - coalesce(r.TOTAL_RETURN_VALUE, 0) NET_SALES_VALUE,
       coalesce(lp.PRICE, 0) CURRENT_LIST_PRICE, coalesce(uc.COST, 0) CURRENT_UNIT_COST,
       cast((s.TOTAL_SALES_VALUE - coalesce(r.TOTAL_RETURN_VALUE, 0))
            - (s.TOTAL_SALES_QTY - coalesce(r.TOTAL_RETURN_QTY, 0)) * coalesce(uc.COST, 0) as decimal(38,9)) GROSS_MARGIN,
       coalesce(case when cast(s.TOTAL_SALES_VALUE - coalesce(r.TOTAL_RETURN_VALUE, 0) as double) = 0 then NULL
            else cast(cast((s.TOTAL_SALES_VALUE - coalesce(r.TOTAL_RETURN_VALUE, 0))
                 - (s.TOTAL_SALES_QTY - coalesce(r.TOTAL_RETURN_QTY, 0)) * coalesce(uc.COST, 0) as decimal(38,9)) as double)
                 / cast(s.TOTAL_SALES_VALUE - coalesce(r.TOTAL_RETURN_VALUE, 0) as double) * 100.0 end, 0) GROSS_MARGIN_PCT,
       coalesce(case when s.TOTAL_SALES_QTY = 0 then NULL
            else cast(coalesce(r.TOTAL_RETURN_QTY, 0) as double) / cast(s.TOTAL_SALES_QTY as double) * 100.0 end, 0)
         RETURN_RATE_PCT
FROM (SELECT KEY_PRODUCT, KEY_COMPANY, TOY_NO, DASH_CODE, COMPANY_CODE, CURRENCY_CODE, sum(ORDER_QTY) TOTAL_SALES_QTY,
             sum(cast(ORDER_VALUE as decimal(18,2))) TOTAL_SALES_VALUE,
             sum(cast(ORDER_LIST_VALUE as decimal(18,2))) TOTAL_LIST_VALUE
      FROM cdl_fact_sales GROUP BY ALL) s
LEFT JOIN (SELECT KEY_PRODUCT, KEY_COMPANY, CURRENCY_CODE, sum(RETURN_QTY) TOTAL_RETURN_QTY,
                  sum(cast(RETURN_VALUE as decimal(18,2))) TOTAL_RETURN_VALUE
           FROM cdl_fact_returns GROUP BY ALL) r ON s.KEY_PRODUCT = r.KEY_PRODUCT AND s.KEY_COMPANY = r.KEY_COMPANY
  AND s.CURRENCY_CODE = r.CURRENCY_CODE
LEFT JOIN (SELECT KEY_PRODUCT, PRICE FROM (
             SELECT *, row_number() OVER (PARTITION BY KEY_PRODUCT ORDER BY EFFECTIVE_DATE DESC) rn
             FROM cdl_fact_product_price WHERE PRICE_TYPE = 'LIST'
               AND (SELECT max(cast(o_orderdate as date)) FROM orders) BETWEEN EFFECTIVE_DATE AND EXPIRY_DATE) x
           WHERE rn = 1) lp ON s.KEY_PRODUCT = lp.KEY_PRODUCT
LEFT JOIN (SELECT KEY_PRODUCT, COST FROM (
             SELECT *, row_number() OVER (PARTITION BY KEY_PRODUCT ORDER BY EFFECTIVE_DATE DESC) rn
             FROM cdl_fact_product_cost WHERE COST_TYPE = 'EX-FACTORY'
               AND (SELECT max(cast(o_orderdate as date)) FROM orders) BETWEEN EFFECTIVE_DATE AND EXPIRY_DATE) x
           WHERE rn = 1) uc ON s.KEY_PRODUCT = uc.KEY_PRODUCT
LEFT JOIN cdl_dim_product p ON s.KEY_PRODUCT = p.KEY_PRODUCT""",
      "cdl_fact_sales", "cdl_fact_returns", "cdl_fact_product_price", "cdl_fact_product_cost", "cdl_dim_product")


@register("b2_fact_product_profitability",
          O.sql(f"SELECT {O.render(S.FACT_PRODUCT_PROFITABILITY)} FROM b2_mart", "b2_mart"))
def b2(ctx):
    """B2: fact_product_profitability as of the latest order date, LIST price, EX-FACTORY cost."""
    c = ctx.cdl
    return M.fact_product_profitability(c["cdl_fact_sales"], c["cdl_fact_returns"], c["cdl_fact_product_price"],
                                        c["cdl_fact_product_cost"], c["cdl_dim_product"], as_of_latest_order(ctx))


_G = "KEY_PRODUCT, KEY_COMPANY, KEY_SELLING_METHOD, AS_OF_DATE, FORECAST_DATE, TOY_NO, COMPANY_CODE, " \
     "SELLING_METHOD_CODE, CURRENCY_CODE"
O.cte("b3_mart", f"""
SELECT j.*, cast(year(FORECAST_DATE) as bigint) FORECAST_YEAR, cast(month(FORECAST_DATE) as bigint) FORECAST_MONTH,
       coalesce(p.PRODUCT_NAME, 'N/A') PRODUCT_NAME, coalesce(p.CATEGORY, 'N/A') CATEGORY,
       coalesce(p.BRAND, 'N/A') BRAND, coalesce(c.COMPANY_NAME, 'N/A') COMPANY_NAME,
       DEMAND_PLAN_QTY - ACTUAL_SALES_QTY DEMAND_VS_ACTUAL_VARIANCE,
       SALES_FORECAST_QTY - ACTUAL_SALES_QTY FORECAST_VS_ACTUAL_VARIANCE,
       coalesce(case when DEMAND_PLAN_QTY = 0 then NULL
                     else ACTUAL_SALES_QTY * 100.0 / cast(DEMAND_PLAN_QTY as double) end, 0) DEMAND_ACCURACY_PCT,
       coalesce(case when SALES_FORECAST_QTY = 0 then NULL
                     else ACTUAL_SALES_QTY * 100.0 / cast(SALES_FORECAST_QTY as double) end, 0) FORECAST_ACCURACY_PCT
FROM (SELECT fc.KEY_PRODUCT, fc.KEY_COMPANY, fc.KEY_SELLING_METHOD, fc.AS_OF_DATE, fc.FORECAST_DATE, fc.TOY_NO,
             fc.COMPANY_CODE, fc.SELLING_METHOD_CODE, fc.CURRENCY_CODE,
             coalesce(DEMAND_PLAN_QTY, 0) DEMAND_PLAN_QTY, coalesce(DEMAND_PLAN_DRAFT_QTY, 0) DEMAND_PLAN_DRAFT_QTY,
             coalesce(SALES_FORECAST_QTY, 0) SALES_FORECAST_QTY,
             coalesce(SALES_FORECAST_STAGED_QTY, 0) SALES_FORECAST_STAGED_QTY,
             coalesce(a.ACTUAL_SALES_QTY, 0) ACTUAL_SALES_QTY, coalesce(a.ACTUAL_SALES_VALUE, 0) ACTUAL_SALES_VALUE
      FROM (SELECT * FROM (SELECT {_G}, sum(DEMAND_PLAN_QTY) DEMAND_PLAN_QTY, sum(DEMAND_PLAN_DRAFT_QTY) DEMAND_PLAN_DRAFT_QTY
            FROM cdl_fact_demand_forecast GROUP BY ALL) d
      FULL OUTER JOIN (SELECT {_G}, sum(SALES_FORECAST_QTY) SALES_FORECAST_QTY,
                              sum(SALES_FORECAST_STAGED_QTY) SALES_FORECAST_STAGED_QTY
                       FROM cdl_fact_sales_forecast GROUP BY ALL) f USING ({_G})
      ) fc
      LEFT JOIN (SELECT KEY_PRODUCT, KEY_COMPANY, KEY_SELLING_METHOD, CURRENCY_CODE,
                        cast(date_trunc('month', TRANSACTION_DATE) as date) TX_MONTH, sum(ORDER_QTY) ACTUAL_SALES_QTY,
                        sum(cast(ORDER_VALUE as decimal(18,2))) ACTUAL_SALES_VALUE
                 FROM cdl_fact_sales GROUP BY ALL) a
        ON fc.KEY_PRODUCT = a.KEY_PRODUCT AND fc.KEY_COMPANY = a.KEY_COMPANY
       AND fc.KEY_SELLING_METHOD = a.KEY_SELLING_METHOD AND fc.CURRENCY_CODE = a.CURRENCY_CODE AND cast(date_trunc('month', fc.FORECAST_DATE) as date) = a.TX_MONTH
      WHERE fc.KEY_PRODUCT IS NOT NULL AND fc.KEY_COMPANY IS NOT NULL AND fc.KEY_SELLING_METHOD IS NOT NULL
        AND fc.AS_OF_DATE IS NOT NULL AND fc.FORECAST_DATE IS NOT NULL) j
LEFT JOIN cdl_dim_product p ON j.KEY_PRODUCT = p.KEY_PRODUCT
LEFT JOIN cdl_dim_company c ON j.KEY_COMPANY = c.KEY_COMPANY""",
      "cdl_fact_demand_forecast", "cdl_fact_sales_forecast", "cdl_fact_sales", "cdl_dim_product", "cdl_dim_company")


@register("b3_fact_demand_vs_sales", O.sql(f"SELECT {O.render(S.FACT_DEMAND_VS_SALES)} FROM b3_mart", "b3_mart"))
def b3(ctx):
    """fact_demand_vs_sales. Both forecasts come from the same monthly lines, written once; so are the forecasts side
    by side and the actual sales, so that the shuffles of one are gone before the next."""
    from ..session import frozen
    ctx.keep(ctx.raw, MONTHLY)
    c = ctx.cdl
    return M.fact_demand_vs_sales(c["cdl_fact_demand_forecast"], c["cdl_fact_sales_forecast"], c["cdl_fact_sales"],
                                  c["cdl_dim_product"], c["cdl_dim_company"], keep=frozen)
