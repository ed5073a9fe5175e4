"""Projections and scalar functions (P5-P19). Every function returns a Column or a DataFrame and
uses built-in expressions only; nothing leaves the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import ADMIN_COLUMNS, NUMERIC
from .keys import composite_hash


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P5."""
    return df.withColumnsRenamed(mapping)


def date_parts(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """YEAR, MONTH, QUARTER, ISO week, DAYOFWEEK (1 = Sunday) as bigint columns."""
    d = F.col(col)
    return df.withColumns({
        f"{prefix}YEAR": F.year(d).cast("bigint"),
        f"{prefix}MONTH": F.month(d).cast("bigint"),
        f"{prefix}QUARTER": F.quarter(d).cast("bigint"),
        f"{prefix}WEEK_OF_YEAR": F.weekofyear(d).cast("bigint"),
        f"{prefix}DAY_OF_WEEK": F.dayofweek(d).cast("bigint"),
    })


def is_weekend(d) -> Column:
    """Sunday or Saturday."""
    return F.dayofweek(_c(d)).isin(1, 7)


def safe_cast(c, to: str | T.DataType) -> Column:
    """NULL where the value does not convert (SAFE_CAST)."""
    return _c(c).try_cast(to)


def safe_divide(n, d) -> Column:
    """NULL on a zero (or NULL) divisor; computed in double like SAFE_DIVIDE."""
    den = _c(d).cast("double")
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(_c(n).cast("double") / den)


# Type-driven defaults that replace NULL in mart columns.
DEFAULT_STRING = "N/A"
DEFAULT_DATE = dt.date(1900, 1, 1)
DEFAULT_TIMESTAMP = dt.datetime(1900, 1, 1)


def default_for(dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, (T.DecimalType, T.DoubleType, T.FloatType)):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit(DEFAULT_STRING)
    if isinstance(dtype, T.DateType):
        return F.lit(DEFAULT_DATE)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(DEFAULT_TIMESTAMP).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(dtype)


def fill_defaults(df: DataFrame, schema: T.StructType | None = None,
                  overrides: dict[str, object] | None = None) -> DataFrame:
    """P10: ``coalesce(col, default(type))`` for every column; sheet defaults override."""
    overrides = overrides or {}
    types = {f.name: f.dataType for f in (schema or df.schema).fields}
    out = {}
    for name in df.columns:
        if name not in types:
            continue
        dflt = F.lit(overrides[name]).cast(types[name]) if name in overrides else default_for(types[name])
        out[name] = F.coalesce(F.col(name), dflt)
    return df.withColumns(out)


def replace_text(c, old: str, new: str) -> Column:
    """Literal REPLACE."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def conform(df: DataFrame, schema: T.StructType, fill_missing: bool = True) -> DataFrame:
    """Target column order and declared types; missing columns become typed NULLs."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif fill_missing:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name} missing from input")
    return df.select(cols)


# Artifact status preference, best first; anything else ranks 5.
STATUS_RANKS = (("passed", 1), ("executed", 2), ("testing", 3), ("generated", 4))


def status_rank(c="status") -> Column:
    """P13."""
    expr = None
    for value, rank in STATUS_RANKS:
        expr = (F.when(_c(c) == value, F.lit(rank)) if expr is None
                else expr.when(_c(c) == value, F.lit(rank)))
    return expr.otherwise(F.lit(5))


def stamp(df: DataFrame, col: str, run_ts: dt.datetime) -> DataFrame:
    """A load stamp passed in by the caller, so a run is repeatable."""
    return df.withColumn(col, F.lit(run_ts).cast("timestamp"))


# ADMIN literals of the mart MERGE.
SCHEDULER_TYPE = "COMPOSER"
DML_INSERT, DML_UPDATE = "INSERT", "UPDATE"
RECORD_ACTIVE = "ACTIVE"


def add_admin(df: DataFrame, keys: list[str], required: list[str], run_ts: dt.datetime,
              source_system: str, process_id: str = "strata", keyed: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """The audit block. ADMIN_ISERROR = any required column NULL. With ``keyed`` the rows have their composite-key
    hash already and keep it. ``beside`` names columns that are no data of the row: they stay and are not hashed."""
    data_cols = [c for c in df.columns if c not in ADMIN_COLUMNS and c not in beside]
    err = F.lit(False)
    for c in required:
        err = err | F.col(c).isNull()
    ts = F.lit(run_ts).cast("timestamp")
    return df.select(*data_cols, *beside, *[F.col("ADMIN_COMPOSITEKEY_HASH").alias("_key_hash")] * keyed).withColumns({
        "ADMIN_PROCESS_ID": F.lit(process_id),
        "ADMIN_COMPOSITEKEY_HASH": F.col("_key_hash") if keyed else composite_hash(keys),
        "ADMIN_SCHEDULER_TYPE": F.lit(SCHEDULER_TYPE),
        "ADMIN_ROW_HASH": composite_hash(data_cols),
        "ADMIN_LOAD_DATE": ts,
        "ADMIN_ISDELETED": F.lit(False),
        "ADMIN_ISERROR": err,
        "ADMIN_LAST_MODIFIED_DATE": ts,
        "ADMIN_DML_OPERATION_FLAG": F.lit(DML_INSERT),
        "ADMIN_RECORD_STATUS": F.lit(RECORD_ACTIVE),
        "ADMIN_SOURCE_SYSTEM": F.lit(source_system),
    }).drop("_key_hash")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small inline table (bounded by the literal list)."""
    return spark.createDataFrame(rows, schema)


# The four selling methods of the conformed dimension.
SELLING_METHODS = (("100", "Wholesale"), ("200", "Direct-to-Consumer"), ("300", "E-Commerce"),
                   ("400", "Marketplace"))


def price_order_lines(df: DataFrame, qty="ORDER_QTY", list_price="LIST_PRICE",
                      discount_pct="DISCOUNT_PCT") -> DataFrame:
    """Selling price after discount, line value and list value, exact decimals."""
    lp = F.col(list_price).cast("decimal(18,2)")
    sp = F.round(lp * (F.lit(100) - F.col(discount_pct).cast("int")) / F.lit(100), 2).cast("decimal(18,2)")
    q = F.col(qty).cast("decimal(18,0)")
    return df.withColumns({
        "SELLING_PRICE": sp.cast(NUMERIC),
        "ORDER_VALUE": (q * sp).cast("decimal(18,2)").cast(NUMERIC),
        "ORDER_LIST_VALUE": (q * lp).cast("decimal(18,2)").cast(NUMERIC),
    })


# Message buckets, tested in this order, first match wins.
MESSAGE_RULES = (
    ("type_mismatch_float_numeric", (("float64",), ("numeric",))),
    ("column_not_found", (("not found",), ("column", "name"))),
    ("group_by_missing", (("not grouped", "not aggregated"),)),
    ("syntax_error", (("syntax error",),)),
    ("duplicate_key", (("duplicate",),)),
    ("as_in_values", (("as",), ("values",))),
)
OTHER_CATEGORY = "other"


def categorize_messages(c) -> Column:
    """Each rule is an AND of OR-groups of substrings of the lower-cased message."""
    msg = F.lower(_c(c))
    expr = None
    for category, groups in MESSAGE_RULES:
        cond = None
        for alternatives in groups:
            alt = None
            for word in alternatives:
                hit = msg.contains(word)
                alt = hit if alt is None else (alt | hit)
            cond = alt if cond is None else (cond & alt)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(OTHER_CATEGORY))
