"""Declarative table mapping (P16): a small spec compiled to a projection, and to an incremental load.

A spec lists target fields (source expression, target name, type, key flag, static default) and
table-level filters, keys, incremental field and partition fields. ``apply_mapping`` produces built-in
expressions only, so Catalyst sees one projection it can prune and push down. ``load_mapping`` executes the
lists: the incremental field is a mark pushed to the source scan, the keys are those of a MERGE (M1), the partition
fields choose the folders that are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import merge_upsert
from ..operators.windows import dedup_latest
from ..session import frozen
from ..sources import store

# Spec type names and their Spark types.
TYPE_NAMES = {
    "STRING": T.StringType(), "INT64": T.LongType(), "INTEGER": T.LongType(), "NUMERIC": T.DecimalType(38, 9),
    "FLOAT64": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampNTZType(),
    "BYTES": T.BinaryType(), "BIGNUMERIC": T.DecimalType(38, 18),
    # kept as text: Spark tables have no such column types
    "TIME": T.StringType(), "JSON": T.StringType(), "GEOGRAPHY": T.StringType(),
}


@dataclass
class FieldMapping:
    target_col: str
    data_type: str = "STRING"
    source_col: str | None = None      # a column name or a SQL expression over the source
    is_key: bool = False
    value: object | None = None        # static value used when the source is NULL (or absent)
    transform: str | None = None       # optional SQL expression applied instead of source_col


@dataclass
class TableMapping:
    target_table: str
    fields: list[FieldMapping]
    filters: list[str] = field(default_factory=list)
    primary_keys: list[str] = field(default_factory=list)
    incremental_field: str | None = None
    partition_fields: list[str] = field(default_factory=list)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.target_col, TYPE_NAMES[f.data_type.upper()], not f.is_key)
                             for f in self.fields])

    def keys(self) -> list[str]:
        return self.primary_keys or [f.target_col for f in self.fields if f.is_key]


def apply_mapping(df: DataFrame, tm: TableMapping) -> DataFrame:
    """Filter the source with the spec's filters, then project every target field."""
    for cond in tm.filters:
        df = df.filter(F.expr(cond))
    cols = []
    for f in tm.fields:
        dtype = TYPE_NAMES[f.data_type.upper()]
        src = f.transform or f.source_col
        e = F.expr(src).cast(dtype) if src else F.lit(None).cast(dtype)
        if f.value is not None:
            e = F.coalesce(e, F.lit(f.value).cast(dtype))
        cols.append(e.alias(f.target_col))
    return df.select(cols)


# ---------------------------------------------------------------- the lists, executed
#: Columns of a load: the value of several partition fields, and a row's change class (not stored).
PARTITION, CHANGE = "_PARTITION", "_change"


def read_mapped(spark: SparkSession, tm: TableMapping, path: str) -> DataFrame | None:
    """The table that ``load_mapping`` keeps, with the columns of the mapping; None before the first load."""
    table = store.read_table(spark, path)
    return None if table is None else table.select(*[f.target_col for f in tm.fields])


def _from_mark(source: DataFrame, tm: TableMapping, mark: object) -> DataFrame:
    """Source rows that may lie at or after ``mark`` or have no value: a comparison of the source's own column,
    which the scan uses to skip row groups."""
    spec = next(f for f in tm.fields if f.target_col == tm.incremental_field)
    if not (spec.transform or spec.source_col):
        return source
    value = F.expr(spec.transform or spec.source_col).cast(TYPE_NAMES[spec.data_type.upper()])
    return source.filter((value >= F.lit(mark)) | value.isNull())


def _equal(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def _unheld(rows: DataFrame, held: DataFrame, tm: TableMapping, mark: object | None) -> DataFrame:
    """The winners that the table must take in: not those it holds already, so that a run without news writes nothing."""
    if tm.incremental_field is None:
        return rows.join(held, _equal(rows, held, rows.columns), "left_anti")
    stamp = F.col(tm.incremental_field)
    # a held row equal to one from the mark on lies at the mark: the other folders' row groups are skipped
    at_mark = held.filter(stamp == F.lit(mark)) if mark is not None else held.limit(0)
    stamped, bare = rows.filter(stamp.isNotNull()), rows.filter(stamp.isNull())
    keys = held.select(*tm.keys())
    return (stamped.join(at_mark, _equal(stamped, at_mark, rows.columns), "left_anti")
            .unionByName(bare.join(keys, _equal(bare, keys, tm.keys()), "left_anti")))


def load_mapping(source: DataFrame, tm: TableMapping, path: str) -> dict[str, int]:
    """Load ``source`` through the mapping into the versioned table at ``path``; the rows per change class of what was rewritten.

    Only source rows at or after the table's greatest ``incremental_field``, or without a value there, are
    read (all rows on the first load and without the field). Of rows with one key the newest is kept, ties by all columns; it replaces
    a held row of its key, but a row without a value only ever adds a key. Rows that land with an older value
    are not read, as with any mark. Without ``partition_fields`` the table is rewritten whole, else
    only the partitions that hold a loaded key or take a loaded row. Nothing new: no version is committed. Keys
    must not be NULL (the job fails); a mapping without keys cannot be merged.
    """
    keys, names = tm.keys(), [f.target_col for f in tm.fields]
    if not keys:
        raise ValueError(f"{tm.target_table}: a mapping without keys cannot be loaded")
    spark = source.sparkSession
    held = read_mapped(spark, tm, path)
    mark = None
    if held is not None and tm.incremental_field:
        mark = held.agg(F.max(tm.incremental_field)).first()[0]  # one value
    rows = apply_mapping(source if mark is None else _from_mark(source, tm, mark), tm)
    kinds = {f.name: f.dataType for f in rows.schema}
    rows = rows.select(*[F.coalesce(F.col(c), F.raise_error(F.lit(f"NULL in key {c}")).cast(kinds[c])).alias(c) if c in keys else F.col(c) for c in names])
    order = []
    if tm.incremental_field:
        stamp = F.col(tm.incremental_field)
        order = [stamp.desc_nulls_last()]
        if mark is not None:  # a static value may stand before the mark
            rows = rows.filter((stamp >= F.lit(mark)) | stamp.isNull())
    rows = dedup_latest(rows, keys, order, [tm.incremental_field] if order else [])
    if held is not None:
        rows = _unheld(rows, held, tm, mark)
    rows = frozen(rows, f"load-{tm.target_table}")
    if held is not None and rows.isEmpty():
        return {c: 0 for c in store.CHANGE_CLASSES}
    updates = [c for c in names if c not in keys]

    def merged(target: DataFrame | None, new: DataFrame) -> DataFrame:
        return merge_upsert(target, new, keys, updates, stamp_col=None, unique_source=True, change_col=CHANGE)

    if not tm.partition_fields:
        base = store.current_seq(spark, path)
        out, counts = store.count_changes(merged(held, rows), CHANGE)
        store.full_refresh(out, path, expected_seq=base)
        return {k: int(v) for k, v in counts.get.items()}
    part = tm.partition_fields[0]
    if len(tm.partition_fields) > 1:
        part, updates = PARTITION, [*updates, PARTITION]
        rows = rows.withColumn(PARTITION, F.to_json(F.struct(*tm.partition_fields), {"ignoreNullFields": "false"}))
    return store.merge_partitions(spark, path, rows, part, keys, merged, sort=keys, change_col=CHANGE)
