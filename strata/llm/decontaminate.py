"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the word windows of the benchmark items. Per pattern length the search keeps a shift
table over two-word blocks (how far the window may slide when a text block ends it), buckets of
patterns by the hash of their last block, and compares candidates word by word. A text block that no
pattern holds moves the window by nearly its whole length, so most words of a clean text are never
looked up. Texts are searched where they lie: no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, frozen, with_python_columns

WINDOW = 10
#: UTF-8 text of benchmark items that one search holds at once; larger benchmarks take several passes.
PASS_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of digits, letters a-z and non-ASCII characters."""
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.size = len(next(iter(patterns)))
        self.block = min(2, self.size)
        self.far = self.size - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[int, list] = defaultdict(list)
        for words, names in patterns.items():
            for end in range(self.block, self.size + 1):
                key = b" ".join(words[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.far), self.size - end)
            self.buckets[hash(key)].append((list(words), names))

    def search(self, words: list[bytes]):
        """(first word, one past the last word, names) of each occurrence, left to right."""
        size, shift, far, at = self.size, self.shift, self.far, self.size - 1
        pair = self.block == 2
        while at < len(words):
            key = words[at - 1] + b" " + words[at] if pair else words[at]
            if move := shift.get(key, far):
                at += move
                continue
            lo = at - size + 1
            for pattern, names in self.buckets[hash(key)]:
                if words[lo:at + 1] == pattern:
                    yield lo, at + 1, names
            at += 1


def searchers(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """One searcher per window length; an item of fewer words than a window is one window itself."""
    patterns: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if size else ():
            patterns[size][tuple(words[i:i + size])].add(name)
    return [WuManber(p) for _, p in sorted(patterns.items())]


def merged(spans) -> list[list[int]]:
    """Sorted disjoint union of half-open spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, spans)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def item_batches(items: DataFrame, pass_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in batches of about ``pass_bytes`` of text, by a hash of their id and text; the driver holds one at a
    time. Of several, each is read from a written table of the items, where a batch lies in one file."""
    keyed = (items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
             .select(F.col("item_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("text")))
    total = keyed.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // pass_bytes))
    part = keyed.withColumn("b", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    if n > 1:
        part = frozen(part.repartition(n, "b"), "items")
    for b in range(n):
        yield [(r["name"], bytes(r["text"])) for r in part.filter(F.col("b") == b).collect()]


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (disjoint word ranges inside an occurrence, end
    exclusive) and ``items`` (sorted ids of items with an occurrence).

    A null text has no words. Items without an id, text or word match nothing; repeated items count
    once per id. Documents are rows: repeated rows are searched each. Columns of ``docs`` that clash
    with the three new ones are replaced; all others pass through. Each pass but the last writes its result, so
    neither the driver, a plan nor a task ever holds more items than one pass.
    """
    out = docs.drop("n_words", "hit_spans", "items")
    spans, names = fresh(docs, "spans"), fresh(docs, "names")
    raw = fresh(docs, "raw")
    out = (out.withColumn(raw, F.encode("text", "UTF-8")).withColumn(spans, F.array().cast("array<array<int>>"))
           .withColumn(names, F.array().cast("array<string>")).withColumn("n_words", F.lit(0).cast("long")))
    keep = [c for c in out.columns if c not in (spans, names, "n_words")]
    for i, batch in enumerate(item_batches(items, pass_bytes)):
        if i:
            out = frozen(out, "searched")

        def make(batch=batch):
            found = searchers(batch, window)

            def run(b):
                new, who, n = [], [], []
                col = dict(zip(b.schema.names, b.columns))
                for text, old, had in zip(col[raw], col[spans], col[names]):
                    words = words_of(text.as_py())
                    hits = [h for s in found for h in s.search(words)]
                    n.append(len(words))
                    new.append(merged([*old.as_py(), *(h[:2] for h in hits)]) if hits else old.as_py())
                    who.append(sorted({*had.as_py()}.union(*(h[2] for h in hits))) if hits else had.as_py())
                return new, who, n
            return run

        step = with_python_columns(out, "_s array<array<int>>, _i array<string>, _n long", make)
        out = step.select(*keep, F.col("_s").alias(spans), F.col("_i").alias(names), F.col("_n").alias("n_words"))
    return out.drop(raw).withColumnsRenamed({spans: "hit_spans", names: "items"})


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_items(docs.select("doc_id", "text"), items.select("item_id", "text"), window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    found = find_items(docs, items, window)
    return found.filter(F.size("hit_spans") == 0).select(*docs.columns)
