"""Sources, sinks and table management.

Tables live as Parquet directories under one root per layer (``raw/ cdl/ bl/ br/ ops/``) in a
shared folder. A write makes a new version folder and then commits it by renaming a marker to
``_commits/<seq>`` without overwriting: a reader never sees a half-written table, a failed write
leaves the previous version current, and two writers that start from the same version cannot both
commit. A marker names the folders of its version: one, or one per partition or appended batch. Nothing here collects data rows to the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import own_shuffles

LAYERS = ("raw", "cdl", "bl", "br", "ops")
#: Options of written tables.
PARQUET = {"compression": "zstd"}
#: Options of gzipped NDJSON.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


# ---------------------------------------------------------------- S1-S3 readers and writers
def read_raw_jsonl(spark: SparkSession, path: str, schema: T.StructType, check_fields: bool = True) -> DataFrame:
    """Newline-delimited JSON into a declared schema; a malformed record or a field that the schema
    does not name fails the read.

    FAILFAST rejects values that do not parse but drops undeclared fields, so each line's field names
    are compared with the schema while it is parsed: one pass over the files, nothing sampled.
    """
    if not check_fields:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    line = F.col("value")
    extra = F.array_except(F.json_object_keys(line), F.array(*[F.lit(n) for n in schema.fieldNames()]))
    parsed = F.from_json(line, schema, {"mode": "FAILFAST"})
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("undeclared fields: "), F.array_join(extra, ", ")))
                     ).otherwise(parsed)
    return spark.read.text(path).filter(F.trim(line) != "").select(checked.alias("r")).select("r.*")


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV with a declared schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV files."""
    with own_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, gzipped: bool = False) -> None:
    """S3: NDJSON, dates as ISO strings. ``gzipped``: each line repeats all field names, so the files are a small part of
    the text; a file is read by one task."""
    with own_shuffles(df.sparkSession):
        df.write.mode("overwrite").options(dateFormat="yyyy-MM-dd", **(GZIP if gzipped else {})).json(path)


# ---------------------------------------------------------------- S4-S7 table management
def table_path(root: str, layer: str, table: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer}")
    return os.path.join(root, layer, table)


def _fs(spark: SparkSession, path: str):
    """The Hadoop FileSystem of ``path`` (HDFS, S3A, GCS, local: whatever the cluster configures)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


class ConcurrentWriteError(RuntimeError):
    """Another writer committed a version on the same base first: re-read the table and retry."""


def _jpath(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Committed sequence numbers of a table, ascending."""
    fs, p = _fs(spark, os.path.join(path, "_commits"))
    if not fs.exists(p):
        return []
    return sorted(int(st.getPath().getName()) for st in fs.listStatus(p) if st.getPath().getName().isdigit())


def _read_text(spark: SparkSession, file_path: str) -> str:
    fs, p = _fs(spark, file_path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current_seq(spark: SparkSession, path: str) -> int:
    """The sequence number of the current version (0 when the table has none yet)."""
    seqs = _commits(spark, path)
    return seqs[-1] if seqs else 0


def _folders(spark: SparkSession, path: str, seq: int | None = None) -> list[tuple[str | None, str]]:
    """(partition value, folder) of a committed version: one pair without value for a plain table."""
    seq = current_seq(spark, path) if seq is None else seq
    if seq == 0:
        return []
    lines = _read_text(spark, os.path.join(path, "_commits", f"{seq:010d}")).split("\n")
    return [tuple(json.loads(x)) if x.startswith("[") else (None, x) for x in lines]


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that the newest commit wrote (None when the table does not exist).

    A version exists only once its commit marker ``_commits/<seq>`` appears, which happens after
    Spark's job commit finished writing the data: a write that died half-way is never read."""
    found = _folders(spark, path)
    return os.path.join(path, found[-1][1].split("/")[0]) if found else None


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of the folder written last; one folder is looked at, however many the version has."""
    return spark.read.parquet(os.path.join(path, _folders(spark, path)[-1][1])).schema


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version; folders written before a column was added have NULL there."""
    found = _folders(spark, path)
    if not found:
        return None
    if len(found) == 1:
        return spark.read.parquet(os.path.join(path, found[0][1]))
    return read_folders(spark, path, [f for _, f in found], table_schema(spark, path))


def _commit(spark: SparkSession, path: str, base: int, lines: list[str]) -> None:
    """The marker of version ``base + 1``: written under a name of its own, then renamed without
    overwriting, so it is never seen half-written and one of two writers on a base fails."""
    fs, _ = _fs(spark, path)
    part = _jpath(spark, path, "_commits", f"{base + 1:010d}-{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    try:
        out.write(bytearray("\n".join(lines).encode("utf-8")))
    finally:
        out.close()
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(rename, 0)
    marker = _jpath(spark, path, "_commits", f"{base + 1:010d}")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(part), fs.makeQualified(marker), none)
    except Exception as e:  # noqa: BLE001 - py4j wraps the FileAlreadyExistsException
        raise ConcurrentWriteError(f"{path}: version {base + 1} was committed by another writer") from e


def full_refresh(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 expected_seq: int | None = None) -> str:
    """DELETE + INSERT as a new version with an optimistic-concurrency commit.

    The data is written to a fresh ``v-<uuid>`` folder and then committed. ``expected_seq`` is the
    version the caller's plan was built from (a MERGE reads its target first); when another writer
    committed on that base in the meantime, ``ConcurrentWriteError`` is raised instead of silently
    losing that writer's update.
    """
    spark = df.sparkSession
    base = current_seq(spark, path) if expected_seq is None else expected_seq
    name = f"v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").options(**PARQUET)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with own_shuffles(spark):
        w.parquet(os.path.join(path, name))
    _commit(spark, path, base, [name])
    return os.path.join(path, name)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete version folders older than the ``keep`` newest committed ones, including abandoned
    (never committed) folders written before the oldest kept commit."""
    seqs = _commits(spark, path)
    if len(seqs) <= keep:
        return []
    fs, p = _fs(spark, path)
    kept = {f.split("/")[0] for q in seqs[-keep:] for _, f in _folders(spark, path, q)}
    oldest_kept = fs.getFileStatus(_jpath(spark, path, "_commits", f"{seqs[-keep]:010d}")).getModificationTime()
    removed = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v-") and name not in kept and st.getModificationTime() <= oldest_kept:
            fs.delete(st.getPath(), True)
            removed.append(name)
    return sorted(removed)


load_truncate = full_refresh


def replace_table(df: DataFrame, path: str) -> str:
    """M7: CREATE OR REPLACE: the new version may carry a different schema."""
    return full_refresh(df, path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Create an empty typed table if it does not exist; return the current table."""
    cur = read_table(spark, path)
    if cur is not None:
        return cur
    full_refresh(spark.createDataFrame([], schema), path)
    return read_table(spark, path)


def append_log(df: DataFrame, path: str) -> None:
    """Append records to a table: a new version that lists the folders it had and the new one."""
    spark = df.sparkSession
    base = current_seq(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.mode("errorifexists").options(**PARQUET).parquet(os.path.join(path, name))
    _commit(spark, path, base, [json.dumps([v, f]) if v is not None else f for v, f in _folders(spark, path, base)] + [name])


#: Cluster columns a mart may have.
CLUSTER_MAX = 4


def write_mart(df: DataFrame, path: str, month_col: str = "ADMIN_LOAD_DATE",
               cluster_cols: list[str] | None = None, partition_col: str = "LOAD_MONTH",
               expected_seq: int | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """A month-partitioned mart, clustered by at most four columns, committed as a new version.

    Rows are range-partitioned by month and cluster columns, so a task writes a few months or one range of the
    keys of a large month: files of a month have disjoint key ranges, and a key filter skips files
    by their statistics, row groups within a file too. A hash of the row ends the range key, so that one
    key with a third of all rows fills several files instead of one task; only these share a key. Without
    cluster columns AQE deals months out to tasks by size. ``finish`` adds columns to the rows where they lie when they
    are written, so that these are not shuffled.
    """
    cluster_cols = list(cluster_cols or [])
    if len(cluster_cols) > CLUSTER_MAX:
        raise ValueError(f"a mart is clustered by at most {CLUSTER_MAX} columns, not {len(cluster_cols)}")
    order = [partition_col, *cluster_cols]
    out = df.withColumn(partition_col, F.date_trunc("MONTH", F.col(month_col)).cast("date"))
    if cluster_cols:
        data = [F.col(f"`{c}`") for c in out.columns if not isinstance(out.schema[c].dataType, T.MapType)]
        out = out.repartitionByRange(*order, F.xxhash64(*data)).sortWithinPartitions(*order)
    else:
        out = out.hint("rebalance", partition_col).sortWithinPartitions(partition_col)
    return full_refresh(out if finish is None else finish(out), path, [partition_col], expected_seq)


# ---------------------------------------------------------------- S8-S11 inspection
def preview(df: DataFrame, n: int = 10, order_by: list[Column] | None = None) -> DataFrame:
    """The first ``n`` rows in a stated order (never an arbitrary sample)."""
    return df.orderBy(*(order_by or [F.col(c) for c in df.columns])).limit(n)


def schema_from_sample(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON files (lines, or one array with ``multi_line``) described as (column, type, null_only).

    Types come from Spark's JSON inference; ``null_only`` from one aggregate counting the non-NULL
    values of every column (inference alone reports an always-NULL field as a string).
    """
    df = spark.read.option("multiLine", multi_line).json(path)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    parts = [F.struct(F.lit(f.name).alias("column_name"),
                      F.lit("string" if isinstance(f.dataType, T.NullType) else f.dataType.simpleString())
                      .alias("data_type"),
                      (F.col(f"c{i}") == 0).alias("null_only"))
             for i, f in enumerate(df.schema.fields)]
    return counts.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


# Type names tried in order, narrowest first.
INFER_ORDER = (("INT64", "bigint"), ("NUMERIC", "decimal(38,9)"), ("DATE", "date"), ("TIMESTAMP", "timestamp"))


#: What no text of a type holds: it is looked for first, since each failed parse throws and catches an exception.
NEVER = {"INT64": "[!-*,./:-~]|[0-9][+-]", "NUMERIC": "[A-DF-Za-df-z/:_]|[0-9.][+-]", "DATE": "^[A-Za-z]", "TIMESTAMP": "^[A-SU-Za-z]"}


def infer_column_types(df: DataFrame, cols: list[str] | None = None, with_timestamp: bool = True) -> DataFrame:
    """Per text column, the narrowest type every non-NULL value converts to (whole column,
    one aggregate pass), unpivoted to (column_name, inferred_type); without a value, STRING."""
    cols = cols or df.columns
    order = [t for t in INFER_ORDER if with_timestamp or t[0] != "TIMESTAMP"]
    kinds = {c: f.dataType for c, f in zip(cols, df.select(*cols).schema.fields)}
    aggs = []
    for c in cols:
        for name, spark_type in order:
            ok = F.col(c).try_cast(spark_type).isNotNull()
            if isinstance(kinds[c], T.StringType):
                ok = ~F.col(c).rlike(NEVER[name]) & ok
            ok = F.col(c).isNull() | ok
            aggs.append((F.bool_and(ok) & (F.count(F.col(c)) > 0)).alias(f"{c}__{name}"))
    flags = df.agg(*aggs)
    exprs = []
    for c in cols:
        e = None
        for name, _ in order:
            cond = F.coalesce(F.col(f"{c}__{name}"), F.lit(False))
            e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
        exprs.append(F.struct(F.lit(c).alias("column_name"), e.otherwise(F.lit("STRING")).alias("inferred_type")))
    return flags.select(F.explode(F.array(*exprs)).alias("r")).select("r.*")


_NO_VALUE = "__null__"


def read_folders(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    """The rows of some of a table's folders."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[os.path.join(path, f) for f in folders])


def partition_folders(spark: SparkSession, path: str, seq: int | None = None) -> dict[str, str | None]:
    """folder → partition value of a committed version (the current one by default)."""
    return {f: v for v, f in _folders(spark, path, seq)}


def read_partitions(spark: SparkSession, path: str, values: set[str | None]) -> DataFrame:
    """The partitions of the current version whose value (as text, None for NULL) is in ``values``: the other
    folders are neither listed nor read."""
    named = {_NO_VALUE if v is None else v for v in values}
    return read_folders(spark, path, [f for f, v in partition_folders(spark, path).items() if v in named or v is None],
                        table_schema(spark, path))


#: What ``count_changes`` observes.
CHANGE_CLASSES = ("inserted", "updated", "unchanged")


def count_changes(df: DataFrame, change_col: str) -> tuple[DataFrame, Observation]:
    """``df`` without ``change_col``, and the rows per change class, counted while ``df`` is written."""
    obs = Observation(f"changes_{uuid.uuid4().hex[:8]}")
    counts = [F.count_if(F.col(change_col) == c).alias(c) for c in CHANGE_CLASSES]
    return df.observe(obs, *counts).drop(change_col), obs


def merge_partitions(spark: SparkSession, path: str, source: DataFrame, partition_col: str, keys: list[str],
                     merge: Callable[[DataFrame | None, DataFrame], DataFrame], sort: list[str] | None = None,
                     change_col: str | None = None) -> dict[str, int]:
    """MERGE into a large partitioned table, rewriting only the partitions the source affects.

    Affected are the partitions of the source's rows and those that hold a target row with a source
    key (a semi join over the key columns only), so the result equals the merge of the whole table
    even where a key's partition changes or is NULL. The merged partitions are written to a new folder
    and committed with a marker that keeps the folders of all others: readers see the whole merge or
    none of it, and a repeated run after a failure is safe. The partition column stays in the data with
    its own type; only its text names a folder. ``sort`` orders the rows within a file.

    With ``change_col`` the merge names each row's change class in that column; it is not stored, and the rows
    per class of the partitions written are returned (one pass: counted while writing).
    """
    base = current_seq(spark, path)
    old = _folders(spark, path, base)
    name = F.coalesce(F.col(partition_col).cast("string"), F.lit(_NO_VALUE))
    with own_shuffles(spark):
        hit = {r[0] for r in source.select(name).distinct().collect()}  # one value per partition
        if old:
            known = read_table(spark, path).select(*keys, name.alias("_p"))
            hit |= {r[0] for r in known.join(source.select(*keys).distinct(), keys, "left_semi").select("_p").distinct().collect()}
    if old:
        hit |= {None}  # a folder without a value is a whole table
    touched = [f for v, f in old if v in hit]
    target = read_folders(spark, path, touched, table_schema(spark, path)) if old else None
    merged = merge(target, source)
    version = f"v-{uuid.uuid4().hex}"
    # AQE deals partitions out to tasks by size: few files a partition, and a large one spreads
    named = merged.withColumn("_p", F.concat(F.lit("p"), F.md5(name))).hint("rebalance", "_p")
    if sort:
        named = named.sortWithinPartitions("_p", *sort)
    obs = None
    if change_col:
        named, obs = count_changes(named, change_col)
    with own_shuffles(spark):
        named.write.options(**PARQUET).partitionBy("_p").parquet(os.path.join(path, version))
    # a merged row lies in a partition of the source or of the target, so folder names tell the values
    texts = {f"_p=p{hashlib.md5(v.encode()).hexdigest()}": v for v in {v for v, _ in old} | hit if v is not None}
    fs, root = _fs(spark, os.path.join(path, version))
    folders = [st.getPath().getName() for st in fs.listStatus(root)] if fs.exists(root) else []
    lines = [(v, f) for v, f in old if v not in hit] + [(texts[f], f"{version}/{f}") for f in sorted(folders) if f.startswith("_p=")]
    if lines:
        _commit(spark, path, base, [json.dumps(x) for x in lines])
    else:
        full_refresh(merged.drop(change_col) if change_col else merged, path, expected_seq=base)  # an empty table keeps its schema
    return {k: int(v) for k, v in obs.get.items()} if obs else {}
