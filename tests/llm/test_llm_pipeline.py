"""The corpus pipeline and the registered queries of the training-data operators."""

from __future__ import annotations

import importlib
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import queries as llm
from tests.llm.test_llm_operators import ODD, brute_components, brute_hits, brute_lines
from tests.oracle_check import duck_views, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    duck_views(con, SF)
    df = llm.QUERIES[name](spark, SF)
    cur = con.execute(llm.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 11))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    import random

    rng = random.Random(12)
    item = " ".join(f"b{i}" for i in range(14))
    words = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    rows = [(100 + i, words(60) + "\nshared line of the site\n" + words(20)) for i in range(40)]
    rows += [(200, rows[0][1] + " more"), (201, rows[1][1]), (202, words(30) + " " + item[3:40] + " " + words(5)), (203, words(9) + " " + item + " end")]
    rows += ODD
    toxic = [(300 + i, f"{words(20)} idiot {words(5)} moron {words(5)} scum {words(9)}") for i in range(60)]
    docs = documents(spark, rows + toxic)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows + toxic if i], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, stages = docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    have = Counter(rows)

    def step(name):
        out = stages[name](spark, now, str(tmp_path))
        assert out.columns == docs.columns
        return out

    now = step("toxicity")
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == have
    now = step("line_dedup")
    cut = Counter((i, None if t is None else k) for (i, t), (_, _, _, k) in zip(rows, brute_lines(rows, 10)))
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == cut
    assert now.filter(F.col("n_chars") != F.length("text")).count() == 0
    kept = list(cut.elements())
    now = step("ngram_jaccard_join")
    parts = brute_components(kept, 5, 80)
    left = Counter((r["doc_id"], r["text"]) for r in now.collect())
    assert {i for i, t in left if i is not None} == {p[2] for p in parts if p[2] is not None}
    assert not {200, 201} & {i for i, _ in left}
    now = step("benchmark_decontamination")
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter({k: v for k, v in left.items() if not brute_hits(k[1], [(1, item)], 10)[4]})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"] or "") for r in now.collect())
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lives_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    full = set(entry.queries())
    for name in ("corpus_pipeline", "strata.llm", "strata.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    try:
        assert full - set(importlib.reload(entry).queries()) == {*llm.QUERIES, "pipeline"}
        assert not set(llm.ORACLE) & set(entry.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
    assert set(entry.queries()) == full
