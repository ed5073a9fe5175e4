"""Analytics previews over the conformed layer (Q1-Q5).

Each report aggregates the fact to the dimension key *before* joining the dimension (a partial
aggregate shrinks the fact to one row per key and map task), then joins the small aggregate. The
result equals join-then-aggregate because every dimension is unique on its surrogate key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide

MEASURES = ("order_lines", "total_qty", "total_value")


def _pre(fact: DataFrame, key: str) -> DataFrame:
    return fact.groupBy(key).agg(
        F.count(F.lit(1)).alias("order_lines"),
        F.sum("ORDER_QTY").alias("total_qty"),
        F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")).alias("total_value"))


def _reagg(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.groupBy(*dims).agg(
        F.sum("order_lines").cast("bigint").alias("order_lines"),
        F.sum("total_qty").cast("bigint").alias("total_qty"),
        F.sum("total_value").cast("decimal(18,2)").alias("total_value"))


def sales_by_company(sales: DataFrame, company: DataFrame) -> DataFrame:
    """Q1: order lines, quantity and value per company (code, name, region), value desc."""
    dims = ["COMPANY_CODE", "COMPANY_NAME", "REGION"]
    j = _pre(sales, "KEY_COMPANY").join(company.select("KEY_COMPANY", *dims), "KEY_COMPANY")
    return _reagg(j, dims).orderBy(F.col("total_value").desc(), *dims)


def sales_by_category_brand(sales: DataFrame, product: DataFrame) -> DataFrame:
    """Q2: the same by product category and brand."""
    dims = ["CATEGORY", "BRAND"]
    j = _pre(sales, "KEY_PRODUCT").join(product.select("KEY_PRODUCT", *dims), "KEY_PRODUCT")
    return _reagg(j, dims).orderBy(F.col("total_value").desc(), *dims)


def sales_by_selling_method(sales: DataFrame, method: DataFrame) -> DataFrame:
    """Q3: the same by selling method. The dimension is derived from the data (distinct codes), so no
    hint: AQE measures it after its shuffle and broadcasts it when it is small."""
    dims = ["SELLING_METHOD_CODE", "SELLING_METHOD_NAME"]
    j = _pre(sales, "KEY_SELLING_METHOD").join(method.select("KEY_SELLING_METHOD", *dims), "KEY_SELLING_METHOD")
    return _reagg(j, dims).orderBy(F.col("total_value").desc(), *dims)


def monthly_sales_trend(sales: DataFrame) -> DataFrame:
    """Q4: the same by transaction year and month."""
    g = sales.groupBy(F.year("TRANSACTION_DATE").cast("bigint").alias("year"),
                      F.month("TRANSACTION_DATE").cast("bigint").alias("month"))
    return g.agg(F.count(F.lit(1)).cast("bigint").alias("order_lines"),
                 F.sum("ORDER_QTY").cast("bigint").alias("total_qty"),
                 F.sum(F.col("ORDER_VALUE").cast("decimal(18,2)")).alias("total_value")).orderBy("year", "month")


def _per_product_company(sales: DataFrame, returns: DataFrame) -> DataFrame:
    s = sales.groupBy("KEY_PRODUCT", "KEY_COMPANY").agg(
        F.sum("ORDER_QTY").alias("s_qty"), F.count(F.lit(1)).alias("s_rows"))
    r = returns.groupBy("KEY_PRODUCT", "KEY_COMPANY").agg(
        F.sum("RETURN_QTY").alias("r_qty"), F.count(F.lit(1)).alias("r_rows"))
    return s.join(r, ["KEY_PRODUCT", "KEY_COMPANY"], "left")


def top_return_rate(sales: DataFrame, returns: DataFrame, product: DataFrame, k: int = 10,
                    as_written: bool = True, abs_returns: bool = False) -> DataFrame:
    """Q5: products ranked by return rate, top ``k``.

    ``as_written`` reproduces the reference query exactly: a row-level LEFT JOIN of sales to returns
    on product + company, whose sums are inflated by the fan-out (T3). The inflation is computed
    from per-(product, company) counts — Σ sales·max(1, #returns) and Σ returns·#sales — so no pair
    of rows is ever materialised. ``as_written=False`` is the corrected, pre-aggregated variant.
    ``abs_returns`` ranks by the magnitude of the (negatively stored) returns (T2).
    """
    pc = _per_product_company(sales, returns)
    if as_written:
        sold = F.col("s_qty") * F.greatest(F.coalesce(F.col("r_rows"), F.lit(0)), F.lit(1))
        ret = F.col("r_qty") * F.col("s_rows")
    else:
        sold, ret = F.col("s_qty"), F.col("r_qty")
    pc = pc.select("KEY_PRODUCT", sold.alias("sold"), ret.alias("ret"))
    dims = ["TOY_NO", "PRODUCT_NAME", "BRAND"]
    j = pc.join(product.select("KEY_PRODUCT", *dims), "KEY_PRODUCT")
    g = j.groupBy(*dims).agg(F.sum("sold").cast("bigint").alias("sold_qty"),
                             F.coalesce(F.sum("ret"), F.lit(0)).cast("bigint").alias("returned_qty"))
    g = g.filter(F.col("sold_qty") > 0)
    num = F.abs(F.col("returned_qty")) if abs_returns else F.col("returned_qty")
    g = g.withColumn("return_rate_pct", safe_divide(num * 100.0, F.col("sold_qty")))
    return g.orderBy(F.col("return_rate_pct").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in dims]).limit(k)
