"""ROW_NUMBER-based selections (W1-W4) and DISTINCT.

``row_number() = 1`` lets Spark insert a ``WindowGroupLimit`` below the shuffle, so only the
best row per key per partition is shuffled. Every ordering is total: the caller's order columns,
then every remaining column as a tie-break, so the chosen row never depends on input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import status_rank
from .filters import valid_at


def _order(df: DataFrame, keys: list[str], order: list[Column] | None, names: list[str]) -> list[Column]:
    order = list(order or [])
    used = set(keys) | set(names)
    tail = [F.col(c).asc_nulls_first() for c in df.columns if c not in used]
    return order + tail


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column] | None = None,
                 order_names: list[str] | None = None, tie_break: bool = True) -> DataFrame:
    """Keep one row per ``keys``: the first by ``order`` (e.g. ``[F.col('LOAD_DATE').desc()]``).

    ``order_names`` lists the columns already used in ``order`` so the automatic tie-break skips them.
    """
    ords = _order(df, keys, order, order_names or []) if tie_break else list(order or [])
    w = Window.partitionBy(*keys).orderBy(*ords)
    cols = df.columns
    return df.select("*", F.row_number().over(w).alias("_rn")).filter(F.col("_rn") == 1).select(*cols)


def active_artifacts(df: DataFrame, key: str = "target_table") -> DataFrame:
    """The latest artifact per table by status preference, then version desc, created desc, id."""
    order = [status_rank(F.col("status")).asc(), F.col("version").desc_nulls_last(),
             F.col("created_at").desc_nulls_last(), F.col("artifact_id").asc_nulls_first()]
    return dedup_latest(df, [key], order, ["status", "version", "created_at", "artifact_id"])


def first_per_category(df: DataFrame, category: str, order: list[Column], order_names: list[str]) -> DataFrame:
    """First row of every category in the given rank order."""
    return dedup_latest(df, [category], order, order_names)


def current_price(df: DataFrame, as_of, type_col: str, type_value: str, key: str = "KEY_PRODUCT",
                  eff: str = "EFFECTIVE_DATE", exp: str = "EXPIRY_DATE") -> DataFrame:
    """The valid row per key on ``as_of`` for one type; latest effective date wins."""
    v = valid_at(df, as_of, type_col, type_value, eff, exp)
    return dedup_latest(v, [key], [F.col(eff).desc_nulls_last()], [eff])


def distinct_rows(df: DataFrame) -> DataFrame:
    """SELECT DISTINCT."""
    return df.distinct()
