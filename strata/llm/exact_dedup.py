"""Exact deduplication by progressive refinement; DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Three refinements, each only over what
the one before left: (1) group by length in bytes; (2) of lengths met twice, group by a hash of the first
characters; (3) of those groups met twice, read the whole text and group by its SHA-256.

A first scan leaves one thin row per document (length and prefix hash), on which the first two steps
group; a second scan reads the whole text of the rest. Between the steps travel not rows but bitmaps of
the surviving groups: 2^27 bits, 16 MiB however many groups there are. A bit that two groups share
only lets a document through to the next step, which compares more. No text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case, fresh, frozen, split_join

#: Characters under the prefix hash.
PREFIX = 256
#: A filter has 2 ** FILTER_BITS bits, in bitmaps of 2 ** 15 bits each: 4096 rows of 4 KiB, 16 MiB in all.
FILTER_BITS, BITMAP_BITS = 27, 15


def folded(text: Column) -> Column:
    """``text`` (null: empty) with A-Z lower-cased; where all bytes are ASCII ``lower`` does the same faster."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(fold_case(body))


def _place(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps (bucket, bits) of the values of ``keys`` that more than one row has."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    place = _place([F.col(k) for k in keys])
    return (twice.select(F.shiftright(place, BITMAP_BITS).cast("int").alias("bucket"),
                         place.bitwiseAND((1 << BITMAP_BITS) - 1).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def surviving(df: DataFrame, filters: DataFrame, keys: list[Column], flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: whether the bit of ``keys`` is set. ``filters`` is broadcast: at
    most 4096 rows of 4 KiB."""
    bucket, bits = f"{flag}_bucket", f"{flag}_bits"
    place = _place(keys)
    within = place.bitwiseAND((1 << BITMAP_BITS) - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, within.bitwiseAND(7)).bitwiseAND(1)
    sides = filters.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    return (df.join(F.broadcast(sides), F.shiftright(place, BITMAP_BITS).cast("int") == F.col(bucket), "left")
            .withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(bucket, bits))


NEW = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Per row of ``docs`` the columns ``keep`` (default: all), ``keep_id`` (the largest doc_id of the rows
    with an equal text), ``group_size``, ``kept`` and ``text_sha256`` (lowercase hex of the folded text).

    Without ``digests`` the digest is null for rows whose text was not read as a whole, because no other
    row shares its length and prefix. Null text is the empty text. Of each group exactly one row is kept:
    of rows that repeat the largest doc_id one of them; a null doc_id is smaller than any other, and in a
    group without doc_ids one row stays and keep_id is null. An empty table gives an empty result. Columns of
    ``docs`` named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    row, uid, full, size, head, some = (fresh(docs, x) for x in ("row", "uid", "full", "size", "head", "some"))
    body = F.coalesce(F.col("text"), F.lit(""))
    first = [F.octet_length(body).alias(size), F.xxhash64(folded(F.substring(body, 1, PREFIX))).alias(head)]

    thin = frozen(docs.select(*first), "refine")
    lengths = repeated(thin, [size])
    heads = repeated(surviving(thin, lengths, [F.col(size)], some).filter(some), [size, head])

    whole = F.sha2(folded(F.col("text")), 256)
    rows = surviving(docs.select("*", *first), heads, [F.col(size), F.col(head)], some)
    rows = rows.select(F.struct("doc_id", *[c for c in keep if c != "doc_id"]).alias(row),
                       F.when(F.col(some), whole).alias(full), *([whole.alias("text_sha256")] if digests else []))
    rows = frozen(rows.withColumn(uid, F.monotonically_increasing_id()), "refined")

    same = rows.filter(F.col(full).isNotNull())
    groups = same.groupBy(full).agg(F.max(F.struct(F.col(f"{row}.doc_id").alias("id"), F.col(uid).alias("uid"))).alias("best"),
                                    F.count(F.lit(1)).alias("group_size"))
    met = split_join(same, groups, full, "group_size")
    alone = rows.filter(F.col(full).isNull())
    digest = F.col("text_sha256") if digests else F.col(full)
    names = [F.col(f"{row}.{c}").alias(c) for c in keep]
    return (met.select(*names, F.col("best.id").alias("keep_id"), "group_size", (F.col(uid) == F.col("best.uid")).alias("kept"),
                       digest.alias("text_sha256"))
            .unionByName(alone.select(*names, F.col(f"{row}.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                      F.lit(True).alias("kept"), digest.alias("text_sha256"))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies: of equal texts the row with the largest doc_id stays."""
    named = docs.select(*[F.col(c).alias(f"c{i}") if c in NEW else F.col(c) for i, c in enumerate(docs.columns)])
    out = exact_groups(named).filter("kept")
    return out.select(*[F.col(f"c{i}").alias(c) if c in NEW else F.col(c) for i, c in enumerate(docs.columns)])
