"""Importance resampling against brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import resampling as R
from tests.llm.test_llm_operators import DOCS, ODD, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(R.UPPER, R.LOWER)))


def runs(text, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + m]).encode()) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute(rows, target, n, buckets, percent, least, seed):
    """(doc_id, n_features, weight, score) of every row, and the drawn ones as (score, doc_id) in order."""
    s = Counter(c % buckets for _, t in rows for c in runs(t, n))
    t = Counter(c % buckets for x in target for c in runs(x, n))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out, fit = [], []
    for i, x in rows:
        f = [gain[c % buckets] for c in runs(x, n)]
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(f) // len(f) if f else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        if len(words(x)) >= least:
            fit.append((-score, i))
    fit.sort()
    return out, fit[:percent * len(fit) // 100]


def corpus(rng):
    voc = [f"w{i}" for i in range(60)] + ["É", "übel", "a1", "😀b"]
    text = lambda k: "".join(rng.choice(voc) + rng.choice([" ", ", ", "\n", " ", "--"]) for _ in range(k))
    rows = [r for r in ODD if r[0] is not None or r[1] is None] + [(1000 + i, text(rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(250)]
    return rows + [(5000 + i, "the same text of all " * 8) for i in range(60)], [text(30) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (2, 97), (3, 70_000)])
def test_ranks_against_brute_force(spark, n, buckets):
    rows, target = corpus(random.Random(n))
    want, drawn = brute(rows, target, n, buckets, 10, 20, 2024)
    docs = frame(spark, rows).withColumnRenamed("lang", "rank").repartition(4)
    out = R.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), n, buckets, 10, 20, 2024)
    assert set(out.columns) == (set(docs.columns) - {"text"}) | {"n_words", "n_features", "weight"}
    got = out.collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(want)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [r[1:] for r in ranked] == drawn and [r[0] for r in ranked] == list(range(1, len(drawn) + 1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert R.resampled(empty, empty).count() == 0
    one = R.resampled(frame(spark, [(1, "a b " * 20), (2, None)]), empty, 1, 10, 100, 20).collect()
    assert {r["doc_id"]: r["rank"] for r in one} == {1: 1, 2: None}


def test_the_scanner_counts_words_that_its_dictionary_lacks(monkeypatch):
    monkeypatch.setattr(R, "FIRST_WORDS", 10)
    rng, scan, compose = random.Random(3), R.WordScanner(most=150, once=100, piece=500), R.Composer()
    voc = [f"v{i}" for i in range(400)] + ["É", "long" * 300]
    for _ in range(120):
        text = "".join(rng.choice(voc) + rng.choice(" \n,É") for _ in range(rng.choice([0, 1, 7, 900])))
        crc, size = scan(text)
        assert crc.tolist() == [zlib.crc32(w.encode()) for w in words(text)]
        assert compose.runs(crc, size, 3).tolist() == runs(text, 3)
    assert len(scan.words) == 150 and len(scan.once) <= 100


def test_composition_of_long_parts():
    a, b = b"left", bytes(range(256)) * 300
    got = R.Composer()(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got.tolist() == [zlib.crc32(a + b)]
