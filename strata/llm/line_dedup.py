"""Line deduplication with per-document keep bitmaps; DataFrame functions only.

A line's key is the line stripped of white space and with A-Z lower-cased. Line hashes (never texts)
are range-partitioned with a secondary sort by document and position, so a key that holds a third of
all lines spreads over as many partitions as its share. Each sorted run counts its first occurrence
per document; the runs' counts, one row per key and run, are summed. Keys found in ``min_docs``
documents or more mark their lines, and each document gets back only a compressed bitmap: an array of
(word number, 64 bits) for the words that hold a dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fold_case, fresh, salted_join, shuffle_partitions

DROPS = "array<struct<word:int,bits:bigint>>"


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return fold_case(F.btrim(line, F.lit(SPACES)))


def document_key(docs: DataFrame) -> Column:
    """128 bits that name a document by doc_id and text; rows equal in both are one document."""
    text = F.col("text")
    one = F.xxhash64(F.lit(1), F.col("doc_id"), text, text.isNull())
    two = F.xxhash64(F.lit(2), text.isNull(), text, F.col("doc_id"))
    return F.struct(one.alias("a"), two.alias("b"))


def line_occurrences(docs: DataFrame) -> DataFrame:
    """One row (hash pair h, document d, position p) per non-empty line."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k, i: F.struct(
        F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2"), i.alias("p"), (k == "").alias("e")))
    # the document's key is made before its lines are rows, or the whole text would be hashed for every line
    return (docs.select(document_key(docs).alias("d"), F.filter(hashed, lambda x: ~x["e"]).alias("ls"))
            .select("d", F.explode("ls").alias("l")).select(F.struct("l.h1", "l.h2").alias("h"), "d", F.col("l.p").alias("p")))


def frequent_keys(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """Hashes of the keys found in at least ``min_docs`` documents.

    The first occurrence of a key in a document is its smallest position; hash aggregation finds it
    before the range partitioning, so that repeats inside a document never travel twice.
    """
    spark = occurrences.sparkSession
    first = occurrences.groupBy("h", "d").agg(F.min("p").alias("p"))
    runs = (first.repartitionByRange(shuffle_partitions(spark), "h", "d", "p")
            .sortWithinPartitions("h", "d", "p").withColumn("run", F.spark_partition_id()))
    per_run = runs.groupBy("h", "run").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("h")


def drop_bitmaps(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(d, drops): per document with a dropped line, the words of its bitmap that are not zero."""
    occ = line_occurrences(docs)
    hit = salted_join(occ, frequent_keys(occ, min_docs), ["h"], F.col("d"), "left_semi")
    words = (hit.groupBy("d", F.expr("p div 64").cast("int").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")))
    return words.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).cast(DROPS).alias("drops"))


def dense(drops: Column) -> Column:
    """The words of a compressed bitmap from the first to the last that is not zero, in place: linear to make, and
    then one step to any word."""
    def words(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(drops, i - 1)["word"]).otherwise(-1)
        return F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - before - 1), F.array(x["bits"]))
    return F.flatten(F.transform(drops, words))


def _is_dropped(words: Column, i: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))
    return F.coalesce(F.get(words, F.floor(i / 64).cast("int")).bitwiseAND(bit) != 0, F.lit(False))


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with ``kept`` (the text without lines whose key is in ``min_docs`` documents or more),
    ``n_lines`` (before dropping) and ``n_dropped``; further columns pass through.

    Keys of no code points never drop. Null or empty text has one empty line, which stays. Rows equal
    in doc_id and text count as one document and get the same result; rows that share only a doc_id (or
    have none) are told apart by their text. A document whose lines all go keeps the empty text.
    """
    d, drops, n, kept = (fresh(docs, x) for x in ("d", "drops", "n", "kept"))
    maps = drop_bitmaps(docs.select("doc_id", "text"), min_docs)
    keyed = docs.withColumn(d, document_key(docs))
    # made dense before the join: inside the filter below it would be made again for every line
    joined = keyed.join(maps.select(F.col("d").alias(d), dense(F.col("drops")).alias(drops)), d, "left").drop(d)
    lines = lines_of(F.col("text"))
    left = F.when(F.col(drops).isNull(), lines).otherwise(
        F.filter(lines, lambda _, i: ~_is_dropped(F.col(drops), i)))
    out = joined.withColumn(n, F.size(lines).cast("long")).withColumn(kept, left)
    names = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    return out.select(*names, F.array_join(F.col(kept), "\n").alias("kept"), F.col(n).alias("n_lines"),
                      (F.col(n) - F.size(F.col(kept))).alias("n_dropped"))
