"""Upserts (M1-M9) as pure DataFrame rewrites: (target, source) -> new target.

There is no MERGE INTO for built-in file tables, so a MERGE is one FULL OUTER JOIN on the merge keys
with a per-column choice of side. The join shuffles both sides on the keys once; the untouched target
rows stream through. For a large target, call it per month partition (``write_mart`` partitions by
month, and dynamic partition overwrite rewrites only the partitions the source touches).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DML_UPDATE


# The change classes of a MERGE (M8).
INSERTED, UPDATED, UNCHANGED = "inserted", "updated", "unchanged"


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _cond(keys: list[str], null_safe: bool) -> Column:
    parts = [(F.col(f"_t.{k}").eqNullSafe(F.col(f"_s.{k}")) if null_safe
              else F.col(f"_t.{k}") == F.col(f"_s.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def merge_upsert(target: DataFrame | None, source: DataFrame, keys, update_cols: list[str],
                 run_ts: dt.datetime | None = None, stamp_col: str | None = "CDL_LOAD_DATE",
                 null_safe: bool = False, matched_col: str | None = None, unique_source: bool = False,
                 change_col: str | None = None) -> DataFrame:
    """M1/M2: WHEN MATCHED update ``update_cols`` (+ stamp); WHEN NOT MATCHED insert the source row.

    Output columns follow the target schema; a source column that the target does not have is an error.
    A key that several source rows carry fails the job, as MERGE does, when its rows are read
    (``unique_source`` says that the source is deduplicated and skips the check). Non-updatable columns of a matched row keep the target's value (T7). With ``null_safe``
    False a NULL key never matches, as with ``=`` in SQL (T21). ``matched_col`` names an optional
    boolean output column that is true for rows present on both sides. ``change_col`` names an optional
    column with each row's change class (M8): ``inserted``, ``updated`` where an updated column differs, else
    ``unchanged``; a writer can count it while it writes.
    """
    keys = _keys(keys)
    cols = target.columns if target is not None else source.columns + (
        [stamp_col] if stamp_col and stamp_col not in source.columns else [])
    ts = F.lit(run_ts).cast("timestamp") if run_ts is not None else F.current_timestamp()
    if target is None:
        change = [F.lit(INSERTED).alias(change_col)] if change_col else []
        return source.select(*[(ts.alias(c) if c == stamp_col else F.col(c)) for c in cols], *change)
    if new := [c for c in source.columns if c not in cols]:
        raise ValueError(f"the target has no columns {new}")
    t = target.withColumn("_tp", F.lit(True)).alias("_t")
    one = F.lit(True)
    if not unique_source:
        # counted over the merge keys: the window shares the join's shuffle and sort
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        twice = (n > 1) if null_safe else (n > 1) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        one = F.when(twice, F.raise_error(F.lit("a merge key has several source rows")).cast("boolean")).otherwise(one)
    s = source.withColumn("_sp", one).alias("_s")
    j = t.join(s, _cond(keys, null_safe), "full_outer")
    has_s, has_t = F.col("_s._sp").isNotNull(), F.col("_t._tp").isNotNull()
    out = []
    for c in cols:
        tc, sc = F.col(f"_t.{c}"), (F.col(f"_s.{c}") if c in source.columns else F.lit(None))
        if c == stamp_col:
            e = F.when(has_s, ts).otherwise(tc)
        elif c in update_cols:
            e = F.when(has_s, sc).otherwise(tc)
        else:
            e = F.when(has_t, tc).otherwise(sc)
        out.append(e.alias(c))
    if matched_col:
        out.append((has_s & has_t).alias(matched_col))
    if change_col:
        same = [F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in update_cols if c in source.columns]
        differs = has_s & has_t & ~reduce(lambda a, b: a & b, same, F.lit(True))
        out.append(F.when(has_s & ~has_t, INSERTED).when(differs, UPDATED).otherwise(UNCHANGED).alias(change_col))
    return j.select(out)


def merge_insert_only(target: DataFrame | None, source: DataFrame, keys, run_ts: dt.datetime | None = None,
                      stamp_col: str | None = "CDL_LOAD_DATE", change_col: str | None = None) -> DataFrame:
    """M3: insert source rows whose key is absent from the target; existing rows are untouched. ``change_col``
    as in ``merge_upsert``."""
    keys = _keys(keys)
    ts = F.lit(run_ts).cast("timestamp") if run_ts is not None else F.current_timestamp()
    new = source.withColumn(stamp_col, ts) if stamp_col else source
    if target is not None:
        new = new.join(target.select(*keys), keys, "left_anti").select(*target.columns)
    if change_col:
        new = new.withColumn(change_col, F.lit(INSERTED))
        target = None if target is None else target.withColumn(change_col, F.lit(UNCHANGED))
    return new if target is None else target.unionByName(new)


def duplicate_source_keys(source: DataFrame, keys) -> DataFrame:
    """M4: merge keys carried by more than one source row (each would match a target row twice)."""
    keys = _keys(keys)
    return (source.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"))
            .filter(F.col("source_rows") > 1))


class MergeCardinalityError(ValueError):
    pass


def assert_unique_source(source: DataFrame, keys) -> DataFrame:
    """M4 as a guard: raise when a key repeats; the check is a distributed aggregate + ``isEmpty``."""
    if not duplicate_source_keys(source, keys).isEmpty():
        raise MergeCardinalityError(f"source repeats merge keys {list(_keys(keys))}")
    return source


MART_KEY = "ADMIN_COMPOSITEKEY_HASH"
# ADMIN columns a matched mart row takes from the source; the others keep the target's value.
_MART_UPDATED_ADMIN = ("ADMIN_ROW_HASH", "ADMIN_ISERROR", "ADMIN_SOURCE_SYSTEM")


def merge_mart(target: DataFrame | None, source: DataFrame, run_ts: dt.datetime, unique_source: bool = False,
               change_col: str | None = None, skip_equal: bool = False) -> DataFrame:
    """M5: MERGE on the composite-key hash. Update sets every data column, the modified time and
    DML flag 'UPDATE'; insert takes the source row as built by ``add_admin`` ('INSERT', 'ACTIVE').

    With ``skip_equal`` a matched row whose row hash is the same keeps its ADMIN block as well: what has not
    changed is not stamped, and merging the same rows again changes nothing. ``change_col`` as in
    ``merge_upsert``, by row hash."""
    if target is None:
        return source.withColumn(change_col, F.lit(INSERTED)) if change_col else source
    data = [c for c in source.columns if not c.startswith("ADMIN_")]
    held = "_held"
    t = target.withColumn(held, F.col("ADMIN_ROW_HASH"))
    upd = data + list(_MART_UPDATED_ADMIN) + ["ADMIN_LAST_MODIFIED_DATE"]
    src = source.withColumn("ADMIN_LAST_MODIFIED_DATE", F.lit(run_ts).cast("timestamp"))
    stamps = ["ADMIN_LAST_MODIFIED_DATE", "ADMIN_DML_OPERATION_FLAG"]
    t = t.withColumns({f"_was_{c}": F.col(c) for c in stamps} | {"_in_target": F.lit(True)})
    merged = merge_upsert(t, src, [MART_KEY], upd, run_ts, stamp_col=None, matched_col="_matched",
                          unique_source=unique_source)
    equal = F.col("_matched") & F.col(held).eqNullSafe(F.col("ADMIN_ROW_HASH"))
    keep = equal if skip_equal else F.lit(False)
    flag = F.when(keep, F.col("_was_ADMIN_DML_OPERATION_FLAG")).when(F.col("_matched"), F.lit(DML_UPDATE)).otherwise(
        F.col("ADMIN_DML_OPERATION_FLAG"))
    modified = F.when(keep, F.col("_was_ADMIN_LAST_MODIFIED_DATE")).otherwise(F.col("ADMIN_LAST_MODIFIED_DATE"))
    out = merged.withColumns({"ADMIN_DML_OPERATION_FLAG": flag, "ADMIN_LAST_MODIFIED_DATE": modified})
    if change_col:
        only_target = ~F.col("_matched") & F.col("_in_target").isNotNull()
        out = out.withColumn(change_col, F.when(equal | only_target, UNCHANGED).when(F.col("_matched"), UPDATED).otherwise(INSERTED))
    return out.drop("_matched", held, "_in_target", *[f"_was_{c}" for c in stamps])


def merge_stats(target: DataFrame | None, source: DataFrame, keys, hash_col: str) -> DataFrame:
    """M8: how a merge would change the target: inserted / updated / unchanged (by row hash)."""
    keys = _keys(keys)
    s = source.select(*keys, F.col(hash_col).alias("_sh"))
    if target is None:
        return s.agg(F.count(F.lit(1)).alias("n")).select(F.lit("inserted").alias("change"), "n")
    t = target.select(*keys, F.col(hash_col).alias("_th"), F.lit(True).alias("_tp"))
    j = s.join(t, keys, "left")
    change = (F.when(F.col("_tp").isNull(), "inserted")
              .when(F.col("_th").eqNullSafe(F.col("_sh")), "unchanged").otherwise("updated"))
    return j.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def update_where(df: DataFrame, cond: Column, values: dict[str, object]) -> DataFrame:
    """M9: UPDATE ... SET col = value WHERE cond, as a projection."""
    return df.withColumns({c: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
                           for c, v in values.items()})
