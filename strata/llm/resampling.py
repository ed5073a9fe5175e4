"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of 1 to n consecutive words, joined by one space; a feature's bucket is the
CRC-32 of its UTF-8 bytes modulo the number of buckets. A bucket's gain is the logarithm of how much likelier
it is in the target than in the corpus; documents are drawn by their mean gain plus Gumbel noise from a
hash of doc_id, highest first, which samples without replacement.

Buckets come from an Aho-Corasick dictionary. Its patterns are words between two delimiters, each with the
payload (CRC, length in bytes); one automaton scan of a text emits the payloads in order, and payloads of
neighbours compose to those of longer runs (CRC of a concatenation from the CRCs and the length). A
task learns its dictionary from the texts it meets; stretches of a text that the automaton does not know are
cut into words and hashed directly, so that every word counts whatever the dictionary holds. Texts are
scanned in bounded pieces. Python in the tasks; nothing but counts per bucket and thin rows is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, UPPER, fresh, frozen, global_rows

#: Words in a task's dictionary, words met once that a task remembers, and characters scanned at a time.
DICTIONARY_WORDS, WORDS_ONCE, PIECE = 1 << 16, 1 << 18, 1 << 20
#: New words that make a task build its first automaton.
FIRST_WORDS = 1024
#: ASCII characters that are no part of a word (once A-Z are lower-cased) become the delimiter.
FOLD = str.maketrans({**{chr(i): " " for i in range(128) if not chr(i).isalnum()}, **dict(zip(UPPER, LOWER))})
CRC_POLYNOMIAL = 0xEDB88320


def _shift_tables(bits: int = 24):
    """For k < bits: 4 x 256 table that moves a CRC past 2^k zero bytes, by squaring the step of one byte."""
    import numpy as np

    def apply(t, c):
        return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]

    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(CRC_POLYNOMIAL) ^ (step >> 1), step >> 1)
    every = np.arange(256, dtype=np.uint32)
    one = np.stack([step[every], every, every << 8, every << 16])  # a zero byte: table of the low byte, rest moves down
    tables = [one]
    for _ in range(bits - 1):
        last = tables[-1]
        tables.append(np.stack([apply(last, part) for part in last]))
    return tables, apply


class Composer:
    """CRC-32 of concatenations from the parts' CRCs and byte lengths, over arrays."""

    def __init__(self):
        self.tables, self.apply = _shift_tables()

    def __call__(self, left, right, right_bytes):
        import numpy as np

        out = left.astype(np.uint32, copy=True)
        for k, t in enumerate(self.tables):
            some = (right_bytes >> k & 1).astype(bool)
            if some.any():
                out[some] = self.apply(t, out[some])
        return out ^ right

    def runs(self, crc, size, n: int):
        """CRCs of all runs of 1 to n neighbours joined by one space, shorter runs first."""
        import numpy as np

        space = np.uint32(zlib.crc32(b" "))
        spaced = self(np.full(len(crc), space, np.uint32), crc, size)  # " " + word
        out, run = [crc], crc
        for k in range(1, min(n, len(crc))):
            run = self(run[:-1], spaced[k:], size[k:] + 1)
            out.append(run)
        return np.concatenate(out)


class WordScanner:
    """Payloads (CRC, bytes) of a text's words in order, by an automaton that learns the words it meets."""

    def __init__(self, most: int = DICTIONARY_WORDS, once: int = WORDS_ONCE, piece: int = PIECE):
        self.most, self.once_most, self.piece = most, once, piece
        self.words: list[str] = []
        self.crc, self.size, self.chars = [], [], []
        self.once: set[str] = set()
        self.new: dict[str, tuple[int, int]] = {}
        self.automaton = None

    def learn(self) -> None:
        """The dictionary with the new words; rebuilt only when it doubles, so building costs as much as scanning."""
        import ahocorasick
        import numpy as np

        for w, (c, n) in self.new.items():
            self.words.append(w)
            self.crc.append(c)
            self.size.append(n)
            self.chars.append(len(w))
        self.new = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(self.words):
            self.automaton.add_word(f" {w} ", i)
        self.automaton.make_automaton()
        self.payload = (np.array(self.crc, np.uint32), np.array(self.size, np.int64), np.array(self.chars, np.int64))

    def meet(self, word: str) -> tuple[int, int]:
        """The payload of a word that the automaton lacks; met for the second time it is to be learnt."""
        known = self.new.get(word)
        if known:
            return known
        raw = word.encode()
        payload = (zlib.crc32(raw), len(raw))
        if len(self.words) + len(self.new) < self.most:
            if word in self.once:
                self.once.discard(word)
                self.new[word] = payload
            else:
                if len(self.once) >= self.once_most:
                    self.once.clear()
                self.once.add(word)
        return payload

    def scan(self, piece: str):
        """(crc, bytes) of the words of ``piece``: folded text that begins and ends with the delimiter."""
        import numpy as np

        if len(self.new) >= max(FIRST_WORDS, len(self.words)) or (self.new and len(self.words) + len(self.new) >= self.most):
            self.learn()
        found = np.array(list(self.automaton.iter(piece)) if self.automaton else [], np.int64).reshape(-1, 2)
        ends, which = found[:, 0], found[:, 1]
        if self.automaton:
            crc, size, chars = (x[which] for x in self.payload)
        else:
            crc, size, chars = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = ends - chars  # of the word; the delimiters lie at starts - 1 and ends
        left, right = np.append(0, ends), np.append(starts - 1, len(piece) - 1)
        at, own = [], []
        for g in np.flatnonzero(right > left).tolist():
            i = int(left[g])
            for w in piece[i:int(right[g])].split(" "):
                if w:
                    at.append(i)
                    own.append(self.meet(w))
                i += len(w) + 1
        if own:
            more = np.array(own, np.int64)
            order = np.argsort(np.concatenate([starts, np.array(at, np.int64)]), kind="stable")
            crc = np.concatenate([crc, more[:, 0].astype(np.uint32)])[order]
            size = np.concatenate([size, more[:, 1]])[order]
        return crc, size

    def __call__(self, text: str):
        import numpy as np

        parts, i = [], 0
        while i < len(text):
            j = i + self.piece
            if j < len(text):  # up to the next delimiter, so that no word is cut
                cut = next((k for k in range(j, len(text)) if text[k].translate(FOLD) == " "), len(text))
            else:
                cut = len(text)
            parts.append(self.scan(f" {text[i:cut].translate(FOLD)} "))
            i = cut
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def bucketed(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """``docs`` without text and with ``buckets`` (the bucket of every feature, little-endian unsigned 32-bit, or
    16-bit where that holds them), ``n_words`` and ``n_features``. Null text has no words."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "buckets", "n_words", "n_features")]
    spark = docs.sparkSession
    new = spark.createDataFrame([], "buckets binary, n_words long, n_features long").schema
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        scan, compose = WordScanner(), Composer()
        for b in batches:
            out, words, features = [], [], []
            for t in b.column(b.schema.get_field_index("text")):
                crc, size = scan(t.as_py() or "")
                runs = compose.runs(crc, size, n) if n > 1 else crc
                out.append((runs % np.uint32(buckets)).astype(kind).tobytes())
                words.append(len(crc))
                features.append(len(runs))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in kept], pa.array(out, pa.binary()),
                                              pa.array(words, pa.int64()), pa.array(features, pa.int64())],
                                             [*[f.name for f in kept], *new.names])

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, StructType(kept + new.fields))


def bucket_counts(features: DataFrame, buckets: int) -> dict[int, int]:
    """Features per bucket: each task counts its own, one row per bucket and task is shuffled."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(buckets, np.int64)
        for b in batches:
            counts += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])

    parts = features.select("buckets").mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most ``buckets`` rows


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (s_all + buckets)) / float((corpus.get(b, 0) + 1) * (t_all + buckets))))
            for b in range(buckets)]


def weighted(features: DataFrame, gains: list[int]) -> DataFrame:
    """``features`` with ``weight``, the floored mean of the gains of a row's features (none: 0), instead of ``buckets``."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"
    kept = [f for f in features.schema.fields if f.name not in ("buckets", "weight")]
    new = features.sparkSession.createDataFrame([], "weight long").schema

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        gain = np.array(gains, np.int64)  # one number per bucket
        for b in batches:
            of = [np.frombuffer(v.as_py(), kind) for v in b.column(b.schema.get_field_index("buckets"))]
            weights = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in of]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in kept], pa.array(weights, pa.int64())],
                                             [*[f.name for f in kept], *new.names])

    return features.mapInArrow(run, StructType(kept + new.fields))


def resampled(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
              seed: int = 2024) -> DataFrame:
    """``docs`` (without text) with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    score is weight plus Gumbel noise in thousandths, from the first 8 hex digits of sha256("seed:doc_id") (a
    null doc_id reads as "null"). Of the N rows with at least ``min_words`` words the floor(percent N / 100)
    highest scores are drawn and ranked from 1, ties to the smaller doc_id; rank is null for all others. Null
    and empty texts have no features and weight 0. Rows that repeat a doc_id are drawn each on its own, in no
    fixed order among equals. An empty target leaves the inverse corpus frequency; empty docs give no rows.
    Columns of ``docs`` named like the new ones are replaced.
    """
    docs = docs.drop("weight", "score", "rank")
    features = frozen(bucketed(docs, n, buckets), "buckets")
    gains = bucket_gains(bucket_counts(features, buckets),
                         bucket_counts(bucketed(target.select("text"), n, buckets), buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = frozen(weighted(features, gains).withColumn("score", F.col("weight") + noise), "scored")
    down, row = fresh(scored, "down"), fresh(scored, "row")
    fit = scored.filter(F.col("n_words") >= min_words).withColumn(down, -F.col("score"))
    ranked, total = global_rows(fit, [down, "doc_id"], row)
    drawn = percent * total // 100
    rank = F.when(F.col(row) < drawn, F.col(row) + 1).cast("long").alias("rank")
    rest = scored.filter(F.col("n_words") < min_words).select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*scored.columns, rank).unionByName(rest)


def document_ranks(docs: DataFrame, target: DataFrame, n: int, buckets: int, percent: int, min_words: int, seed: int) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    out = resampled(docs.select("doc_id", "text"), target, n, buckets, percent, min_words, seed)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
