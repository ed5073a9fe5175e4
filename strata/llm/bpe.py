"""Byte-level BPE encoding and decoding over a public rank file.

Texts split by the public pattern into words; a word's bytes merge by rank, lowest first and leftmost
among equals, until no neighbouring pair has a rank. Only distinct words are merged.

``encode_native`` does so in Spark higher-order functions: the distinct words of the whole corpus fold
over arrays of byte pieces with the rank map as a literal, then join the documents' words.
``encode`` merges the distinct words of each task in a bounded cache where the texts lie, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, with_python_columns

#: Buckets of the literal rank map (a map literal is searched linearly; a bucket has about three entries).
BUCKETS = 1 << 14
#: Words that a task's cache holds before it starts anew.
CACHE_WORDS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """byte piece → rank, from a rank file (base64 piece, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# --- distinct words of the corpus, in Spark functions ---------------------------------------------

def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: an array of small maps, by the checksum of the piece.

    Pieces are written as strings with one character U+0000..U+00FF per byte.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.decode("latin-1")
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(literal: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(literal, (F.crc32(F.encode(piece, "UTF-8")) % BUCKETS).cast("int")), piece)


def fold_merges(word: Column, literal: Column) -> Column:
    """The array of merged pieces of a word: each step joins the lowest-ranked neighbours."""
    byte_chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    pieces = F.transform(F.sequence(F.lit(1), F.length(byte_chars)), lambda i: F.substring(byte_chars, i, F.lit(1)))

    def step(p: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: F.struct(
            _rank(literal, F.concat(F.get(p, i), F.get(p, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(ranked, lambda x: x["r"].isNotNull()))
        join = F.transform(F.array(best), lambda b: F.when(b.isNull(), p).otherwise(F.concat(
            F.slice(p, F.lit(1), b["i"]), F.array(F.concat(F.get(p, b["i"]), F.get(p, b["i"] + 1))),
            F.slice(p, b["i"] + 3, F.size(p)))))
        return F.get(join, F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(byte_chars)), pieces, step)


def encode_native(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded binary) per document, in Spark functions throughout."""
    java = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]").replace(
        r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
    literal = rank_literal(ranks)
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    words = keyed.select("doc_id", "r", F.posexplode_outer(F.regexp_extract_all("text", F.lit(java), F.lit(0))).alias("p", "word"))
    pieces = (words.select("word").filter("word is not null").distinct()
              .withColumn("pieces", fold_merges(F.col("word"), literal)))
    le = lambda i: F.concat_ws("", *[F.lpad(F.hex(F.shiftright(i, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    encoded = pieces.select("word", F.array_join(F.transform("pieces", lambda x: le(_rank(literal, x).cast("long"))), "").alias("ids"),
                            F.array_join("pieces", "").alias("bytes"))
    joined = words.join(encoded, "word", "left").groupBy("doc_id", "r").agg(
        F.array_sort(F.collect_list(F.struct("p", "ids", "bytes"))).alias("w"))
    ids = F.unhex(F.array_join(F.transform("w", lambda x: x["ids"]), ""))
    decoded = F.encode(F.array_join(F.transform("w", lambda x: x["bytes"]), ""), "ISO-8859-1")
    return joined.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), decoded.alias("decoded"))


# --- distinct words of each task ------------------------------------------------------------------

def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a word's pieces after all merges, lowest rank first and leftmost among equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while found := [r for r in pairs if r is not None]:
        i = pairs.index(min(found))
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same over a linked list and a heap: n log n for words of any length."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at i
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two pieces has changed since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class WordCache(dict):
    """word → its ids as little-endian 32-bit integers; merged on first sight, emptied when full."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        self.ranks, self.most = ranks, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = b"".join(i.to_bytes(4, "little") for i in merge(word.encode(), self.ranks))
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and, if asked,
    ``decoded`` (the bytes the ids stand for).

    Null text encodes as the empty text: no ids. Each row is encoded on its own, so repeated rows and
    rows without doc_id need no rule. Columns of ``docs`` named like the new ones are replaced. The rank
    file travels with the task (its size is that of the vocabulary).
    """
    ranks = read_ranks(ranks_path)
    base = docs.drop("ids", "n_tokens", "decoded")
    fields = "ids binary, n_tokens long" + ", decoded binary" * decode

    def make():
        import numpy as np
        import regex

        find, cache = regex.compile(pattern).findall, WordCache(ranks, cache_words)
        pieces = {r: p for p, r in ranks.items()}

        def run(b):
            ids = [b"".join(map(cache.__getitem__, find(t))) if (t := v.as_py()) else b""
                   for v in b.column(b.schema.get_field_index("text"))]
            out = [ids, [len(x) // 4 for x in ids]]
            if decode:
                out.append([b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids])
            return out
        return run

    return with_python_columns(base, fields, make)


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The bytes of a column of ids, as ``out``."""
    pieces = {r: p for p, r in read_ranks(ranks_path).items()}
    raw = fresh(df, "raw")

    def make():
        import numpy as np

        def run(b):
            col = b.column(b.schema.get_field_index(ids))
            return [[None if v is None else b"".join(map(pieces.__getitem__, np.frombuffer(v, "<u4").tolist()))
                     for v in col.to_pylist()]]
        return run

    return with_python_columns(df.drop(out) if out != ids else df, f"{raw} binary", make).withColumnRenamed(raw, out)


def document_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every document."""
    out = encode(docs.select("doc_id", "text"), ranks_path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def document_tokens_native(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The same by ``encode_native``."""
    out = encode_native(docs, read_ranks(ranks_path), pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
