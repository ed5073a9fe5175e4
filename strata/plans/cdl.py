"""RAW → CDL builders (C1-C11) and the CDL refresh.

Each builder is: project with hashed keys (P1-P3, P5) → keep the latest source row per merge key
(W1; the M4 cardinality problem T5/T6 is resolved by an explicit, total order) → MERGE into the
target (M1-M3). With no target the merge is an insert of the deduplicated source.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import calendar_key, fingerprint64, product_key
from ..functions.scalars import SELLING_METHODS
from ..operators.merge import INSERTED, assert_unique_source, merge_insert_only, merge_upsert
from ..operators.spines import calendar_dim
from ..operators.windows import dedup_latest
from ..sources import schemas as S

# Fixed value: the load stamp of a CDL run when the caller does not pass one (repeatable runs).
DEFAULT_RUN_TS = dt.datetime(2026, 1, 1, 0, 0, 0)


def _source(raw: DataFrame, keys: dict[str, Column], schema: T.StructType) -> DataFrame:
    """Hashed keys + RAW columns, LOAD_DATE renamed RAW_LOAD_DATE, in CDL column order."""
    x = raw.withColumns(keys).withColumnRenamed("LOAD_DATE", "RAW_LOAD_DATE")
    cols = [f.name for f in schema.fields if f.name != "CDL_LOAD_DATE"]
    return x.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in cols])


def tie_break_columns(schema: T.StructType, merge_keys: list[str]) -> list[str]:
    """Columns that order rows of one merge key after the load stamp: every stored column except the
    keys, the stamps and the derived KEY_* hashes (functions of code columns already in the list)."""
    return [f.name for f in schema.fields if f.name not in merge_keys and not f.name.startswith("KEY_")
            and f.name not in ("RAW_LOAD_DATE", "CDL_LOAD_DATE")]


def _latest(src: DataFrame, merge_keys: list[str], schema: T.StructType | None = None) -> DataFrame:
    """W1 on the source: newest RAW_LOAD_DATE per merge key, then the tie-break columns ascending."""
    ties = tie_break_columns(schema, merge_keys) if schema is not None else [
        c for c in src.columns if c not in merge_keys and not c.startswith("KEY_") and c != "RAW_LOAD_DATE"]
    order = [F.col("RAW_LOAD_DATE").desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in ties]
    return dedup_latest(src, merge_keys, order, tie_break=False)


def _upsert(raw: DataFrame, keys: dict[str, Column], schema: T.StructType, merge_keys: list[str],
            update_cols: list[str], target: DataFrame | None, run_ts: dt.datetime, dedup: bool = True,
            null_safe: bool = False, strict: bool = False, carry: tuple[str, ...] = (), change_col: str | None = None) -> DataFrame:
    """Dedup first, hash later: only the keys the merge needs are computed before the W1 shuffle;
    the remaining surrogate keys are computed once per surviving row. Written as two projections
    around the window (plus the MERGE join when there is a target). ``carry`` names further columns of
    ``raw`` that are kept beside the schema and updated with the row; ``change_col`` as in ``merge_upsert``."""
    early = {k: e for k, e in keys.items() if k in merge_keys}
    x = raw.select(*[F.col(c) for c in raw.columns if c != "LOAD_DATE"],
                   F.col("LOAD_DATE").alias("RAW_LOAD_DATE"), *[e.alias(k) for k, e in early.items()])
    if strict:
        # M4 as a hard guard: a merge key carried by two source rows fails the build (T5)
        assert_unique_source(x, merge_keys)
    elif dedup:
        x = _latest(x, merge_keys, schema)
    late = {k: e for k, e in keys.items() if k not in merge_keys}
    ts = F.lit(run_ts).cast("timestamp")

    def col(f: T.StructField) -> Column:
        e = late[f.name] if f.name in late else F.col(f.name)
        return e.cast(f.dataType).alias(f.name)

    if target is None:
        change = [F.lit(INSERTED).alias(change_col)] if change_col else []
        return x.select(*[(ts.alias(f.name) if f.name == "CDL_LOAD_DATE" else col(f)) for f in schema.fields], *carry, *change)
    src = x.select(*[col(f) for f in schema.fields if f.name != "CDL_LOAD_DATE"], *carry)
    out = merge_upsert(target, src, merge_keys, [*update_cols, "RAW_LOAD_DATE", *carry], run_ts, "CDL_LOAD_DATE",
                       null_safe=null_safe, unique_source=dedup or strict, change_col=change_col)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *carry, *([change_col] if change_col else []))


def build_dim_company(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, strict: bool = False, **more) -> DataFrame:
    """C1."""
    upd = ["COMPANY_NAME", "REGION", "CURRENCY_CODE", "GEOGRAPHIC_SECURITY_CODE", "COUNTRY", "STATUS"]
    return _upsert(raw, {"KEY_COMPANY": fingerprint64("COMPANY_CODE")}, S.CDL_DIM_COMPANY, ["KEY_COMPANY"],
                   upd, target, run_ts, strict=strict, **more)


def build_dim_customer(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, strict: bool = False, **more) -> DataFrame:
    """C2."""
    upd = ["CUSTOMER_NAME", "CUSTOMER_TYPE", "STATUS", "CREDIT_LIMIT", "PAYMENT_TERMS"]
    return _upsert(raw, {"KEY_CUSTOMER": fingerprint64("CUSTOMER_CODE")}, S.CDL_DIM_CUSTOMER, ["KEY_CUSTOMER"],
                   upd, target, run_ts, strict=strict, **more)


def build_dim_product(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, strict: bool = False, **more) -> DataFrame:
    """C3."""
    upd = ["PRODUCT_NAME", "CATEGORY", "BRAND", "STATUS", "LAUNCH_DATE", "WEIGHT_KG"]
    return _upsert(raw, {"KEY_PRODUCT": product_key()}, S.CDL_DIM_PRODUCT, ["KEY_PRODUCT"], upd, target, run_ts, strict=strict, **more)


def selling_method_source(spark: SparkSession, observed: DataFrame | None = None) -> DataFrame:
    """The four named selling methods, plus any code observed in the data without a name."""
    lit = spark.createDataFrame(list(SELLING_METHODS), "SELLING_METHOD_CODE string, SELLING_METHOD_NAME string")
    if observed is None:
        return lit
    codes = observed.select("SELLING_METHOD_CODE").distinct().filter(F.col("SELLING_METHOD_CODE").isNotNull())
    # FULL OUTER cannot broadcast a side; both sides are a handful of rows after the distinct
    return codes.join(lit, "SELLING_METHOD_CODE", "full_outer")


def build_dim_selling_method(spark: SparkSession, observed: DataFrame | None = None,
                             target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, change_col: str | None = None) -> DataFrame:
    """C4: insert-only."""
    src = selling_method_source(spark, observed).select(
        fingerprint64("SELLING_METHOD_CODE").alias("KEY_SELLING_METHOD"), "SELLING_METHOD_CODE",
        "SELLING_METHOD_NAME")
    out = merge_insert_only(target, src, ["KEY_SELLING_METHOD"], run_ts, change_col=change_col)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in S.CDL_DIM_SELLING_METHOD.fields], *([change_col] if change_col else []))


def build_dim_calendar(spark: SparkSession, start, end, target: DataFrame | None = None,
                       run_ts=DEFAULT_RUN_TS, change_col: str | None = None) -> DataFrame:
    """Insert-only daily calendar between two dates (Columns or literals)."""
    out = merge_insert_only(target, calendar_dim(spark, start, end), ["KEY_CALENDAR"], run_ts, change_col=change_col)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in S.CDL_DIM_CALENDAR.fields], *([change_col] if change_col else []))


def build_fact_product_price(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS,
                             null_safe: bool = False, strict: bool = False, **more) -> DataFrame:
    """C6."""
    return _upsert(raw, {"KEY_PRODUCT": product_key()}, S.CDL_FACT_PRODUCT_PRICE,
                   ["KEY_PRODUCT", "PRICE_TYPE", "EFFECTIVE_DATE"], ["PRICE", "CURRENCY_CODE", "EXPIRY_DATE"],
                   target, run_ts, null_safe=null_safe, strict=strict, **more)


def build_fact_product_cost(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS,
                            null_safe: bool = False, strict: bool = False, **more) -> DataFrame:
    """C7."""
    return _upsert(raw, {"KEY_PRODUCT": product_key()}, S.CDL_FACT_PRODUCT_COST,
                   ["KEY_PRODUCT", "COST_TYPE", "EFFECTIVE_DATE"], ["COST", "CURRENCY_CODE", "EXPIRY_DATE"],
                   target, run_ts, null_safe=null_safe, strict=strict, **more)


RETURNS_UPDATE = ["RETURN_QTY", "RETURN_VALUE", "RETURN_REASON"]
SALES_UPDATE = ["ORDER_STATUS", "ORDER_QTY", "SELLING_PRICE", "ORDER_VALUE", "ORDER_LIST_VALUE"]


def sales_keys() -> dict[str, Column]:
    return {"KEY_PRODUCT": product_key(), "KEY_COMPANY": fingerprint64("COMPANY_CODE"),
            "KEY_CUSTOMER": fingerprint64("CUSTOMER_CODE"),
            "KEY_SELLING_METHOD": fingerprint64("SELLING_METHOD_CODE"),
            "KEY_CALENDAR": calendar_key("TRANSACTION_DATE")}


def build_fact_sales(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, strict: bool = False, **more) -> DataFrame:
    """Merge on ORDER_ID + ORDER_LINE_NO; only status, quantity, price and values update."""
    return _upsert(raw, sales_keys(), S.CDL_FACT_SALES, ["ORDER_ID", "ORDER_LINE_NO"], SALES_UPDATE,
                   target, run_ts, strict=strict, **more)


def build_fact_returns(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS,
                       null_safe: bool = False, strict: bool = False, **more) -> DataFrame:
    """Merge on RETURN_ID + ORDER_LINE_NO (RETURN_ID repeats per order, T6)."""
    keys = {"KEY_PRODUCT": product_key(), "KEY_COMPANY": fingerprint64("COMPANY_CODE"),
            "KEY_CALENDAR": calendar_key("RETURN_DATE")}
    return _upsert(raw, keys, S.CDL_FACT_RETURNS, ["RETURN_ID", "ORDER_LINE_NO"],
                   RETURNS_UPDATE, target, run_ts, null_safe=null_safe, strict=strict, **more)


def _forecast_keys() -> dict[str, Column]:
    return {"KEY_PRODUCT": product_key(), "KEY_COMPANY": fingerprint64("COMPANY_CODE"),
            "KEY_SELLING_METHOD": fingerprint64("SELLING_METHOD_CODE")}


def build_fact_demand_forecast(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, strict: bool = False, **more) -> DataFrame:
    """C10."""
    return _upsert(raw, _forecast_keys(), S.CDL_FACT_DEMAND_FORECAST, ["FORECAST_ID"],
                   ["DEMAND_PLAN_QTY", "DEMAND_PLAN_DRAFT_QTY"], target, run_ts, strict=strict, **more)


def build_fact_sales_forecast(raw: DataFrame, target: DataFrame | None = None, run_ts=DEFAULT_RUN_TS, strict: bool = False, **more) -> DataFrame:
    """C11."""
    return _upsert(raw, _forecast_keys(), S.CDL_FACT_SALES_FORECAST, ["FORECAST_ID"],
                   ["SALES_FORECAST_QTY", "SALES_FORECAST_STAGED_QTY"], target, run_ts, strict=strict, **more)


# The fixed refresh order of the eleven MERGEs.
CDL_ORDER = ("cdl_dim_company", "cdl_dim_customer", "cdl_dim_product", "cdl_dim_selling_method",
             "cdl_dim_calendar", "cdl_fact_product_price", "cdl_fact_product_cost", "cdl_fact_sales",
             "cdl_fact_returns", "cdl_fact_demand_forecast", "cdl_fact_sales_forecast")


def calendar_range(raw: dict[str, DataFrame]) -> DataFrame:
    """One row (lo, hi): first order date and last order or return date, one aggregate per table."""
    ends = raw["raw_order_line"].agg(F.min("TRANSACTION_DATE").alias("lo"), F.max("TRANSACTION_DATE").alias("hi")).unionByName(
        raw["raw_return"].agg(F.lit(None).cast("date").alias("lo"), F.max("RETURN_DATE").alias("hi")))
    return ends.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def calendar_bounds(raw: dict[str, DataFrame]) -> tuple[Column, Column]:
    """The calendar's ends, read as one scalar."""
    both = calendar_range(raw).select(F.struct("lo", "hi").alias("r")).scalar()
    return both["lo"], both["hi"]


def cdl_input(table: str, raw: dict[str, DataFrame]) -> DataFrame:
    """What a dimension, price or cost table is made from; the same input gives the same table."""
    if table == "cdl_dim_calendar":
        return calendar_range(raw)
    if table == "cdl_dim_selling_method":
        return raw["raw_order_line"].select("SELLING_METHOD_CODE").distinct()
    return raw[{"cdl_fact_product_price": "raw_price", "cdl_fact_product_cost": "raw_cost"}.get(table, table.replace("cdl_dim", "raw"))]


@dataclass(frozen=True)
class MonthlyFact:
    """A large fact, kept by month of a date of its RAW table."""
    build: Callable[..., DataFrame]
    raw: str
    date: str
    keys: list[str]
    schema: T.StructType


MONTHLY_FACTS = {
    "cdl_fact_sales": MonthlyFact(build_fact_sales, "raw_order_line", "TRANSACTION_DATE", ["ORDER_ID", "ORDER_LINE_NO"], S.CDL_FACT_SALES),
    "cdl_fact_returns": MonthlyFact(build_fact_returns, "raw_return", "RETURN_DATE", ["RETURN_ID", "ORDER_LINE_NO"], S.CDL_FACT_RETURNS),
    "cdl_fact_demand_forecast": MonthlyFact(build_fact_demand_forecast, "raw_demand_forecast", "FORECAST_DATE", ["FORECAST_ID"],
                                            S.CDL_FACT_DEMAND_FORECAST),
    "cdl_fact_sales_forecast": MonthlyFact(build_fact_sales_forecast, "raw_sales_forecast", "FORECAST_DATE", ["FORECAST_ID"],
                                           S.CDL_FACT_SALES_FORECAST),
}


def cdl_builders(spark: SparkSession, raw: dict[str, DataFrame], targets: dict[str, DataFrame] | None = None,
                 run_ts=DEFAULT_RUN_TS, change_col: str | None = None) -> dict:
    """Zero-argument builders of the eleven CDL plans from RAW DataFrames (and optional targets)."""
    t = targets or {}
    more = {"change_col": change_col}

    def calendar():
        start, end = calendar_bounds(raw)
        return build_dim_calendar(spark, start, end, t.get("cdl_dim_calendar"), run_ts, **more)

    def of(table: str, build, source: str):
        return lambda: build(raw[source], t.get(table), run_ts, **more)

    return {
        "cdl_dim_company": of("cdl_dim_company", build_dim_company, "raw_company"),
        "cdl_dim_customer": of("cdl_dim_customer", build_dim_customer, "raw_customer"),
        "cdl_dim_product": of("cdl_dim_product", build_dim_product, "raw_product"),
        "cdl_dim_selling_method": lambda: build_dim_selling_method(spark, raw["raw_order_line"],
                                                                   t.get("cdl_dim_selling_method"), run_ts, **more),
        "cdl_dim_calendar": calendar,
        "cdl_fact_product_price": of("cdl_fact_product_price", build_fact_product_price, "raw_price"),
        "cdl_fact_product_cost": of("cdl_fact_product_cost", build_fact_product_cost, "raw_cost"),
        **{name: of(name, fact.build, fact.raw) for name, fact in MONTHLY_FACTS.items()},
    }


class LazyTables(dict):
    """A dict of DataFrames built on first access from zero-argument builders."""

    def __init__(self, builders: dict):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        df = self._builders[key]()
        self[key] = df
        return df

def cdl_plans(spark: SparkSession, raw: dict[str, DataFrame], targets: dict[str, DataFrame] | None = None,
              run_ts=DEFAULT_RUN_TS) -> LazyTables:
    """Lazy plans of all eleven CDL tables; each is built when first used."""
    return LazyTables(cdl_builders(spark, raw, targets, run_ts))
