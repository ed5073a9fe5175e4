"""Line dedup of a document with very many lines takes linear time."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from strata.llm import line_dedup


def test_bitmaps_of_many_lines(spark):
    n = 200_000
    common = [f"common {i}" for i in range(40)]
    long = "\n".join(common[i % 40] if i % 2 or 70_000 < i < 90_000 else f"own {i}" for i in range(n))
    rows = [(i, "\n".join(common)) for i in range(11)] + [(100, long), (101, None), (102, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, 10).collect()}
    assert time.time() - start < 60
    kept = [x for x in long.split("\n") if x.startswith("own")]
    assert got[100]["kept"] == "\n".join(kept) and (got[100]["n_lines"], got[100]["n_dropped"]) == (n, n - len(kept))
    assert got[0]["kept"] == "" and got[0]["n_dropped"] == 40 and got[102]["n_dropped"] == got[101]["n_dropped"] == 0


def test_dense_words(spark):
    df = spark.createDataFrame([([(0, 5), (1, 6), (4, 7)],), ([(3, 1)],), ([],)], f"drops {line_dedup.DROPS}")
    assert [r[0] for r in df.select(line_dedup.dense(F.col("drops"))).collect()] == [[5, 6, 0, 0, 7], [0, 0, 0, 1], []]
