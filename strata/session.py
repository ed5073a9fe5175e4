"""SparkSession construction and cluster-facing settings.

The settings are the ones that matter at scale: AQE (runtime coalescing, skew-join splitting,
runtime broadcast conversion), a UTC session clock, and a checkpoint folder that is read from the
session (``spark.checkpoint.dir``) and only defaulted when nothing is configured, as in tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings that hold for every workload of the library, on one laptop or a thousand executors.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # AQE converts a sort-merge join into a broadcast one only when the *measured* size of a
    # finished shuffle stage is below this bound: the runtime size check behind every join.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


SHUFFLE_PARTITION_BYTES = SCAN_SPLIT_BYTES = 512 * 1024 * 1024
#: Share of the input that the largest shuffle is expected to move: columns are pruned and rows
#: pre-aggregated before it.
SHUFFLE_SHARE = 0.25


def sized_conf(input_bytes: int, total_cores: int, shuffle_bytes: int | None = None) -> dict[str, str]:
    """Shuffle sizing for a job reading ``input_bytes`` on ``total_cores`` task slots.

    One partition per 512 MiB of the largest shuffle (``shuffle_bytes``, by default a quarter of the
    input) and at least two tasks per core; scan splits of 512 MiB. 100 TB on 1000 executors x 8 cores
    gives about 52,000 partitions for about 210,000 map tasks; AQE coalesces smaller shuffles.
    """
    moved = int(input_bytes * SHUFFLE_SHARE) if shuffle_bytes is None else shuffle_bytes
    parts = max(2 * total_cores, -(-moved // SHUFFLE_PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(SCAN_SPLIT_BYTES),
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "strata", extra: dict | None = None,
                  input_bytes: int | None = None, total_cores: int | None = None) -> SparkSession:
    """A session with the scale settings. ``input_bytes`` + ``total_cores`` size the shuffles for the
    data at hand (``sized_conf``); ``shuffle_partitions`` sets the count directly (local tests)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if input_bytes and total_cores:
        conf.update(sized_conf(input_bytes, total_cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster; set one only where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_root(spark: SparkSession) -> str:
    """A shared folder for written intermediate tables: inside the checkpoint folder."""
    base = spark.conf.get("spark.strata.scratch.dir", None)
    if base:
        return base
    return os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "strata-tables")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table, inside the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether an execution deletes its shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside delete their shuffle files when they end: a query of several steps then holds on disk what it
    has written and the shuffles of one step, not those of all. A frame that is run again makes its shuffles anew."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def frozen(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor re-reads files instead of
    recomputing, and values that depend on the physical layout (partition ids) stay as written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with own_shuffles(spark):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of written rows that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
