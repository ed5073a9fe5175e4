"""Sharding by a Feistel permutation with cycle walking.

Rows get global numbers 0..n-1 in a fixed order; a keyed permutation of [0, n) shuffles them. Row
``p`` of the shuffle goes to shard ``p mod shards`` at slot ``p div shards``: shard sizes differ by
one at most, slots have no gaps, and both directions are computable from the number alone, so a
reader finds any row without an index and the shuffle is the same on every run.

The permutation is a balanced Feistel network over the smallest even number of bits that holds n - 1;
values that land outside [0, n) walk on through the network until they fall inside (under four steps on
average, since the domain is less than 4 n). The round function is arithmetic modulo the Mersenne prime 2^31 - 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import global_rows

P31 = (1 << 31) - 1
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """(multiplier, addend, addend) of each round, drawn from the seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [tuple(int(x) for x in rng.integers(1, P31, 3)) for _ in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of one Feistel half for a domain that holds 0..n-1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray, key: tuple[int, int, int], mask: int) -> np.ndarray:
    a, b, c = key
    y = (x * a + b) % P31
    return ((y * y + c) % P31 >> 3) & mask


def _once(v: np.ndarray, bits: int, keys) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = v >> bits, v & mask
    for k in keys:
        left, right = right, left ^ _mix(right, k, mask)
    return (left << bits) | right


def _once_back(v: np.ndarray, bits: int, keys) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = v >> bits, v & mask
    for k in reversed(keys):
        left, right = right ^ _mix(left, k, mask), left
    return (left << bits) | right


def _walk(v, n: int, seed: int, step) -> np.ndarray:
    v = np.asarray(v, dtype=np.int64)
    if v.size and (v.min() < 0 or v.max() >= n):
        raise ValueError(f"row numbers must lie in [0, {n})")
    if half_bits(n) > 28:
        raise ValueError("more than 2^56 rows")
    bits, keys = half_bits(n), round_keys(seed)
    out = step(v, bits, keys)
    while (over := out >= n).any():
        out[over] = step(out[over], bits, keys)
    return out


def permute(rows, n: int, seed: int = 0) -> np.ndarray:
    """Place in the shuffle of each row number."""
    return _walk(rows, n, seed, _once)


def unpermute(places, n: int, seed: int = 0) -> np.ndarray:
    """Row number at each place of the shuffle: the inverse of ``permute``."""
    return _walk(places, n, seed, _once_back)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that sits in ``slot`` of ``shard``."""
    return int(unpermute([slot * shards + shard], n, seed)[0])


def feistel_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row`` (global number by ``order``, nulls first), ``shard`` and ``slot``.

    Ties in ``order`` are numbered in an arbitrary but frozen order, so name enough columns that tied
    rows are interchangeable. An empty table gives an empty result.
    """
    numbered, n = global_rows(df, order)

    @pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    p = numbered.withColumn("_place", place(F.col("row")))
    return (p.withColumn("shard", (F.col("_place") % shards).cast("int"))
            .withColumn("slot", F.expr(f"_place div {shards}")).drop("_place"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """Every document with its shard and slot; law ``rows`` (counts at most one apart).

    Rows are numbered by doc_id, then text checksum and size; a null doc_id or text sorts first, a null
    text counts 0 bytes, and repeated rows get places of their own. Only (doc_id, size, checksum) is
    shuffled, never the text. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = feistel_shards(thin, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
