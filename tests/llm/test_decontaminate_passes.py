"""A benchmark larger than one pass: the result of a single pass, with the items of one pass in the plan and on the driver."""

from __future__ import annotations

import random

from strata.llm import decontaminate


def _tables(spark):
    rng = random.Random(5)
    items = [(f"i{i}", " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(2, 14)))) for i in range(40)]
    items += [("i0", "twice the same id"), (None, "no id"), ("n", None), ("e", "")]
    texts = [" ".join(["x y", rng.choice(items[:40])[1], "z", rng.choice(items[:40])[1]]) for _ in range(30)] + [None, "", "clean words only"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id bigint, text string, names string")
    return docs, spark.createDataFrame(items, "item_id string, text string")


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("doc_id", "text", "names", "n_words", "hit_spans", "items").collect())


def test_several_passes_equal_one(spark):
    docs, items = _tables(spark)
    assert len(list(decontaminate.item_batches(items, 300))) > 3
    one, many = decontaminate.find_items(docs, items), decontaminate.find_items(docs, items, pass_bytes=300)
    assert _rows(one) == _rows(many) and many.filter("size(hit_spans) > 0").count() >= 30


def test_a_plan_holds_one_pass(spark):
    docs, items = _tables(spark)
    many = decontaminate.find_items(docs, items, pass_bytes=300)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(x for b in decontaminate.item_batches(items, 300) for x in b) == sorted(x for b in decontaminate.item_batches(items, 1 << 20) for x in b)
