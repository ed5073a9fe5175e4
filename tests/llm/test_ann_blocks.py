"""op2's blocks: a vector moves once per block of the other side, and each query gets the best of all it meets."""

import os

import numpy as np
import pytest

from strata.llm import ann


def _vectors(n, dim, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shuffle_bytes(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(os.path.getsize(os.path.join(at, f)) for d in dirs for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_"))


@pytest.mark.parametrize("block", [ann.BLOCK, 50])
def test_each_query_gets_the_best_of_what_it_meets(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "ASKED_BLOCK", 16)
    x, k = _vectors(300, 16).astype(float), 5
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 4 == 0, k, tables=2, probes=6, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    flips, scores = ann.signs(2, 16, 7), ann.exact(x, x)
    for q in range(0, 300, 4):
        met = [i for i in range(300) if any(ann.axes(ann.rotate(x[i:i + 1], f), 1)[0, 0] in ann.axes(ann.rotate(x[q:q + 1], f), 6)[0] for f in flips)]
        best = sorted(((-scores[q, i], i) for i in met))[:k + 1]
        assert len(met) > k + 1 and got[q] == [(i, -s) for s, i in best if i != q][:k], q


def test_the_fast_product_leaves_out_none_of_the_best():
    x = _vectors(400, 8)
    y = np.concatenate([x, x[:40], x[:40] * np.float32(1 + 2e-7)]).astype(float)  # equal and nearly equal products
    q = x[:20].astype(float)
    rng = np.random.default_rng(5)
    near, at = rng.random((3, 20, 16)) < 0.1, rng.integers(0, 16, (3, 480))
    for j, (rows, score) in enumerate(ann.top_met(q, y, near, at, 6)):
        met = np.flatnonzero(np.any([near[t, j][at[t]] for t in range(3)], axis=0))
        exact = ann.exact(q, y)[j]
        assert set(rows) <= set(met) and (score == exact[rows]).all()
        cut = np.sort(exact[met])[::-1][:6][-1]
        assert set(met[exact[met] >= cut]) <= set(rows)


def test_a_search_moves_few_bytes_and_keeps_no_shuffle(spark):
    x = _vectors(2000, 32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = _shuffle_bytes(spark)
    out = ann.nearest(df, lambda i: i % 20 == 0, 20)
    assert _shuffle_bytes(spark) <= before  # was 5 MB: every table and probe with the vector, every candidate with it again
    assert out.count() == 100 * 20
