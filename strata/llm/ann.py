"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates a vector by three rounds of random signs and a fast Hadamard transform and hashes it
to the nearest signed axis. A query probes, in each table, the buckets of its nearest signed axes;
what it meets there is ranked by the exact inner product of the original vectors.

Equal vectors are one class with its smallest ids (no more than can be ranked), so copies are hashed
and compared once. Classes and queries are dealt into blocks of bounded size; a task sees one block of each,
hashes them, and returns the best ``k`` per query of those that meet in any table, never the pairs. A vector so
moves once per block of the other side and not once per bucket, and a pair that meets in several tables is compared once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import own_shuffles
from .common import frozen, shuffle_partitions

#: Index classes of a block, and queries of a block: bounds what a task holds.
TABLES, PROBES, BLOCK, ASKED_BLOCK = 8, 16, 32_768, 65_536
#: Small indexes are cut into up to this many blocks of at least SMALL_BLOCK classes, so that several tasks share them.
SPREAD, SMALL_BLOCK = 16, 2048


def signs(tables: int, dim: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (tables, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    for s in rounds:
        x = hadamard(x * s)
    return x


def axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: axis i is 2i, its negative 2i + 1."""
    both = np.stack([rotated, -rotated], axis=2).reshape(len(rotated), -1)
    probes = min(probes, both.shape[1])
    some = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def _matrix(col, kind: str, dim: int) -> np.ndarray:
    """Rows of packed vectors as doubles, zero-padded to ``dim``."""
    out = np.zeros((len(col), dim))
    for i, v in enumerate(col):
        x = np.frombuffer(v.as_py() if hasattr(v, "as_py") else v, kind)
        out[i, :len(x)] = x
    return out


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(id, vec packed, norm, dim) of the rows that have an id and a finite vector that is not zero, and the packing."""
    double = "double" in df.schema[vec_col].dataType.simpleString()
    kind = "<f8" if double else "<f4"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero, not two
                if len(x) and np.isfinite(x).all() and x.any():
                    rows.append((i, x.tobytes(), float(np.linalg.norm(x.astype(float))), len(x)))
            c = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()),
                                              pa.array(c[2], pa.float64()), pa.array(c[3], pa.int32())], ["id", "vec", "norm", "dim"])

    cols = df.select(F.col(id_col).cast("long"), F.col(vec_col))
    return cols.mapInArrow(run, "id long, vec binary, norm double, dim int"), kind


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query(id column)``, the ``k`` rows of
    largest inner product found, nearest first, ties to the smaller id, the query's own row left out.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no
    part. Shorter vectors count as zero-padded. Rows that repeat an id are one row if their vectors are
    equal. Where lengths differ, one more coordinate makes the vectors unit vectors of the same order of
    nearness. A query that met fewer than ``k`` candidates probes every bucket of one table, so it
    gets all rows if there are fewer than ``k``. Other columns are ignored.
    """
    spark = df.sparkSession
    found, kind = valid_vectors(df, id_col, vec_col)
    rows = frozen(found.dropDuplicates(["id", "vec"]), "vectors")
    with own_shuffles(spark):
        top = rows.agg(F.max("norm").alias("most"), F.min("norm").alias("least"), F.max("dim").alias("dim"), F.count(F.lit(1)).alias("n")).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if top["dim"] is None:
        return spark.createDataFrame([], out_schema)
    most, uneven, dim = top["most"], top["most"] > top["least"] * (1 + 1e-5), top["dim"]
    width = 1 << max(1, (dim + uneven - 1).bit_length())
    flips = signs(tables, width, seed)

    # classes of equal vectors: only the k + 1 smallest ids can be among anybody's k nearest
    lead = Window.partitionBy("vec").orderBy("id")
    small = rows.withColumn("n", F.row_number().over(lead)).filter(F.col("n") <= k + 1)
    classes = small.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    queries = rows.filter(is_query(F.col("id"))).select("id", "vec")
    # a number stands for a query's vector in all that is found for it
    asked = frozen(queries.select("vec").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")

    def probed(x: np.ndarray, probes: int, only: int) -> np.ndarray:
        """Per table and row, which signed axes are its ``probes`` nearest."""
        out = np.zeros((only, len(x), 2 * width), bool)
        for t in range(only):
            np.put_along_axis(out[t], axes(rotate(x, flips[t]), probes), True, 1)
        return out

    def held(x: np.ndarray, only: int) -> np.ndarray:
        """Per table and row, the signed axis nearest to it."""
        if uneven:  # the rest of the length goes into one coordinate
            x /= most
            x[:, dim] = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.stack([axes(rotate(x, flips[t]), 1)[:, 0] for t in range(only)])

    def searched(asked: DataFrame, probes: int, only: int) -> DataFrame:
        """(q, cand, score): the ``k + 1`` best ids of each query among those that meet it in one of the first ``only`` tables."""
        with own_shuffles(spark):
            blocks = max(-(-top["n"] // block), min(-(-top["n"] // SMALL_BLOCK), shuffle_partitions(spark), SPREAD))
            asks = -(-asked.count() // ASKED_BLOCK)

        def best(left, right):
            """The ``k + 1`` best ids per query of one block."""
            import pyarrow as pa

            found: list = []
            if left.num_rows and right.num_rows:
                c, ids = right.column("vec"), right.column("ids").to_pylist()
                y = _matrix(c, kind, dim)
                at = np.concatenate([held(_matrix(c.slice(lo, 1024), kind, width), only) for lo in range(0, len(c), 1024)], axis=1)
                numbers = left.column("q").to_numpy()
                for lo in range(0, left.num_rows, 64):
                    part = left.column("vec").slice(lo, 64)
                    near = probed(_matrix(part, kind, width), probes, only)
                    for j, (row, score) in enumerate(top_met(_matrix(part, kind, dim), y, near, at, k + 1)):
                        flat = np.array([i for r in row for i in ids[r]], dtype=np.int64)
                        score = np.repeat(score, [len(ids[r]) for r in row])
                        some = np.lexsort((flat, -score))[:k + 1]
                        found.append((numbers[lo + j], flat[some], score[some]))
            return pa.table({"q": pa.array(np.concatenate([np.full(len(i), q, dtype=np.int64) for q, i, _ in found]) if found else [], pa.int64()),
                             "cand": pa.array(np.concatenate([i for _, i, _ in found]) if found else [], pa.int64()),
                             "score": pa.array(np.concatenate([x for _, _, x in found]) if found else [], pa.float64())})

        def dealt(col: str, parts: int):
            return F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")

        def all_of(parts: int):
            return F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1)))

        index = classes.withColumn("i", dealt("vec", blocks)).withColumn("j", all_of(asks))
        probe = asked.withColumn("j", dealt("q", max(asks, 1))).withColumn("i", all_of(blocks))
        met = (probe.groupBy("i", "j").cogroup(index.groupBy("i", "j")).applyInArrow(best, "q long, cand long, score double"))
        # dealt by the query once; an id of two vectors keeps its better product
        met = met.repartition("q").groupBy("q", "cand").agg(F.max("score").alias("score"))
        near = Window.partitionBy("q").orderBy(F.desc("score"), "cand")
        return met.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1).drop("n")

    first = frozen(searched(asked, probes, tables), "found")
    full = first.groupBy("q").count().filter(F.col("count") > k)
    short = frozen(asked.join(full, "q", "left_anti"), "short")
    if not short.isEmpty():
        second = searched(short, 2 * width, 1)
        first = first.join(full, "q", "left_semi").unionByName(second)
    mine = queries.join(asked, "vec").select("id", "q").join(first, "q").filter(F.col("id") != F.col("cand"))
    near = Window.partitionBy("id").orderBy(F.desc("score"), "cand")
    return (mine.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("cand").alias("vec_id"), "score"))


def top_met(q: np.ndarray, y: np.ndarray, near: np.ndarray, at: np.ndarray, k: int):
    """Per row of ``q``: the rows of ``y`` (with their exact inner products) that hold its ``k`` best among those it
    meets, ties at the end included; all it meets if they are fewer. It meets a row whose axis ``at[t]`` is one of its ``near[t]``.

    A fast product chooses: no row is left out whose exact product could be among the best by the bound of its error.
    """
    fast = q @ y.T
    eps = (q.shape[1] + 16) * 1e-15 * np.linalg.norm(q, axis=1) * np.sqrt((y * y).sum(1).max())
    sure = np.isfinite(fast).all(1) & np.isfinite(eps)
    few = 4 * k + 16
    some = np.argpartition(fast, len(y) - few, axis=1)[:, len(y) - few:] if len(y) > few else None

    def met(j: int, rows: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rows), bool)
        for t in range(len(at)):
            hit |= near[t, j][at[t, rows]]
        return rows[hit]

    every = np.arange(len(y))
    for j in range(len(q)):
        line, rows = fast[j], None
        if some is not None and sure[j]:
            rows = met(j, some[j])
            if len(rows) < k or np.partition(line[rows], len(rows) - k)[len(rows) - k] <= line[some[j]].min() + 2 * eps[j]:
                rows = None  # too few of the best are met: look at all
        if rows is None:
            rows = met(j, every)
        if len(rows) > k and sure[j]:
            rows = rows[line[rows] >= np.partition(line[rows], len(rows) - k)[len(rows) - k] - 2 * eps[j]]
        yield rows, exact(q[j:j + 1], y[rows])[0]


def exact(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products in double precision, each summed in the same order whatever block it is in."""
    return np.einsum("ij,kj->ik", q, y, optimize=False)
