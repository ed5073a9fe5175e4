"""Helpers shared by the training-data operators: tables, frozen intermediates, global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import frozen, scratch_path  # noqa: F401 - shared with the warehouse

#: The white space that the line and word rules name: space, and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(c: Column) -> Column:
    """A-Z lower-cased; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case aside)."""
    have, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in have:
        name = f"_{name}"
    return name


def global_rows(df: DataFrame, order: list[str], row: str = "row") -> tuple[DataFrame, int]:
    """``df`` with gapless global row numbers from 0 in the order of ``order``, and the row count.

    A range partitioning sorts in parallel (equal keys aside, no task holds more than its share; name
    enough columns to make ties harmless), each partition numbers its rows on its own, and a running
    sum over the partition counts (one number per partition) shifts them. No single-task window.
    """
    spark = df.sparkSession
    mid = fresh(df, "mid")
    part = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    part = frozen(part.withColumn(mid, F.monotonically_increasing_id()), "rows")
    counts = (part.groupBy(F.shiftright(F.col(mid), 33).cast("int").alias("_pid")).count()
              .orderBy("_pid").collect())  # one small row per partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_pid"], total))
        total += r["count"]
    off = spark.createDataFrame(offsets, "_pid int, _off long")  # as many rows as partitions
    out = (part.join(F.broadcast(off), F.shiftright(F.col(mid), 33).cast("int") == F.col("_pid"))
           .withColumn(row, F.col("_off") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
           .drop("_pid", "_off", mid))
    return out, total


#: Bytes of rows that a task computes new columns for at once; what it holds of them and hands over grows with it.
PIECE_BYTES = 2 << 20


def with_python_columns(df: DataFrame, fields: str, make) -> DataFrame:
    """``df`` plus the columns ``fields`` (DDL), computed piece by piece inside the tasks.

    ``make()`` runs once per task and returns a function from an Arrow record batch to the list of new
    arrays or value lists; the rows never leave their task. Spark's batches are counted in rows and may hold long
    texts, so they are cut into pieces of about PIECE_BYTES, each handed on before the next.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    schema = StructType(df.schema.fields + new.fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        f, kinds = make(), [to_arrow_type(x.dataType) for x in new.fields]
        for whole in batches:
            rows = max(1, whole.num_rows * PIECE_BYTES // max(1, whole.nbytes))
            for b in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                more = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(f(b), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *new.names])

    return df.mapInArrow(run, schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """``left`` joined with an aggregate ``right`` of unique keys; rows of one key go to ``salts`` tasks
    by ``spread``, and each row of ``right`` is repeated for them. Result as of a plain join."""
    salt = fresh(left, "salt")
    a = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, salt], how).drop(salt)


#: A key is hot when it has at least one row in HOT_SHARE: at most HOT_SHARE keys are.
HOT_SHARE = 1000


def split_join(left: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` joined with ``groups``, its aggregate by ``key`` with the rows per key as ``count``.

    Hot keys, those with a thousandth of all rows or more, are broadcast (there are at most a thousand, so
    their rows stay where they are); the others are joined by shuffle, where none fills a partition.
    """
    groups = frozen(groups, "groups")
    total = groups.agg(F.sum(count).alias("n")).collect()[0]["n"] or 0  # one number
    is_hot = F.col(count) * HOT_SHARE >= total
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)
