"""Filters and predicates (F1-F6). All are plain predicates, so Catalyst pushes them to the Parquet
scan where the column is stored (``PushedFilters`` in the plan)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def active_rows(df: DataFrame, col: str = "ADMIN_ISDELETED") -> DataFrame:
    """keep rows not flagged deleted (FALSE or NULL)."""
    return df.filter(~F.coalesce(F.col(col), F.lit(False)))


def valid_at(df: DataFrame, as_of, type_col: str | None = None, type_value: str | None = None,
             eff: str = "EFFECTIVE_DATE", exp: str = "EXPIRY_DATE") -> DataFrame:
    """type = x AND as_of BETWEEN effective AND expiry (both inclusive)."""
    d = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    cond = d.between(F.col(eff), F.col(exp))
    if type_col is not None:
        cond = cond & (F.col(type_col) == F.lit(type_value))
    return df.filter(cond)


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """IN-list. A Python list of any length becomes one pushed-down ``In`` predicate whose values are
    cast to the column's type; a DataFrame of values becomes a ``left_semi`` join whose strategy is
    Catalyst's and AQE's."""
    if isinstance(values, DataFrame):
        vcol = values.columns[0]
        return df.join(values.select(F.col(vcol).alias(col)).distinct(), col, "left_semi")
    kind = df.schema[col].dataType
    return df.filter(F.col(col).isin([F.lit(v).cast(kind) for v in dict.fromkeys(values)]))


def require_grain(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """drop rows whose grain columns are NULL."""
    return df.dropna(subset=list(cols))


def having(agg_df: DataFrame, cond: Column) -> DataFrame:
    """HAVING = a filter over an aggregate."""
    return agg_df.filter(cond)


def incremental(df: DataFrame, col: str, mark) -> DataFrame:
    """rows stamped after the stored high-water mark."""
    m = mark if isinstance(mark, Column) else F.lit(mark)
    return df.filter(F.col(col) > m)
