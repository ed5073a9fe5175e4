"""Property tests (hypothesis): an incremental refresh (target up to a high-water mark, then MERGE of
the later rows) equals a full rebuild whenever the non-updatable columns are functions of the key;
the result never depends on the order rows arrive in."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.operators.merge import merge_upsert
from strata.operators.windows import dedup_latest

T0 = dt.datetime(2024, 1, 1)
RUN = dt.datetime(2026, 1, 1)
SCHEMA = "k bigint, cust string, qty bigint, ts timestamp"

rows_st = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 20), st.integers(-5, 50)), min_size=1, max_size=40)


def _frame(spark, rows):
    return spark.createDataFrame([(k, f"C{k}", q, T0 + dt.timedelta(days=d)) for k, d, q in rows], SCHEMA)


def _latest(df):
    return dedup_latest(df, ["k"], [F.col("ts").desc()], ["ts"])


def _set(df):
    return sorted(tuple(r) for r in df.select("k", "cust", "qty", "ts").collect())


@settings(max_examples=20, deadline=None)
@given(rows=rows_st, mark_day=st.integers(0, 20))
def test_incremental_equals_full_rebuild(spark, rows, mark_day):
    df = _frame(spark, rows)
    mark = F.lit(T0 + dt.timedelta(days=mark_day))
    full = _latest(df)
    target = merge_upsert(None, _latest(df.filter(F.col("ts") <= mark)), ["k"], [], RUN)
    inc = merge_upsert(target, _latest(df.filter(F.col("ts") > mark)), ["k"], ["qty", "ts"], RUN)
    assert _set(inc) == _set(full)


@settings(max_examples=10, deadline=None)
@given(rows=rows_st, seed=st.integers(0, 1000))
def test_dedup_is_order_independent(spark, rows, seed):
    import random
    shuffled = list(rows)
    random.Random(seed).shuffle(shuffled)
    a = _latest(_frame(spark, rows))
    b = _latest(_frame(spark, shuffled).repartition(3))
    assert _set(a) == _set(b)
