"""Words of all texts are counted before terms are looked up among them."""

from __future__ import annotations

from strata.llm import pii
from tests.llm.test_llm_operators import frame


def join_rows(df):
    """Rows that each join made while ``df`` was collected."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [
            node.children().apply(i) for i in range(node.children().length())]
    return out


def test_words_that_every_text_shares_with_an_entity_are_not_joined_per_text(spark):
    rows = [(i, f"one common passage that every text holds again and again n{i}") for i in range(500)]
    rows += [(900, "one common passage that every text holds again and again mail joe@example.com"), (901, None)]
    docs = frame(spark, rows)
    df = pii.disclosing_terms(docs.select("text"), pii.frozen(pii.profiles(docs), "pii"))
    got = {rows[500][1][r["start"]:r["end"]] for r in df.collect()}
    made = join_rows(df)
    assert got == {"mail"} and made and max(made) < 100


def test_terms_are_counted_in_distinct_texts(spark):
    rows = [(1, "alpha Beta beta"), (2, "alpha Beta beta"), (3, "beta-gamma"), (4, None), (5, ""), (6, "delta")]
    terms = spark.createDataFrame([("beta",), ("beta",), ("gamma",), ("absent",)], "term string")
    got = {r["term"]: r["nt"] for r in pii.text_counts(frame(spark, rows).select("text"), terms).collect()}
    assert got == {"beta": 2, "gamma": 1, "absent": 0}
