"""Unit tests on tiny hand-made frames: NULL keys, duplicate sources, zero divisors, empty targets,
unmatched sides of full outer joins, repeat-run properties (SURVEY §5 edge cases)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.functions import scalars as P
from strata.operators import aggs as A
from strata.operators import dq as Q
from strata.operators import joins as J
from strata.operators import merge as M
from strata.operators import spines as D
from strata.operators import windows as W

T1 = dt.datetime(2026, 1, 1)
T2 = dt.datetime(2026, 2, 1)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((v is not None, v if v is not None else 0) for v in t))


def test_fingerprint_null_and_known_value(spark):
    df = spark.createDataFrame([("NSG",), (None,)], "c string")
    out = dict(rows(df.select("c", K.fingerprint64("c").alias("k")), "c", "k"))
    assert out[None] is None
    assert out["NSG"] == -7112920183317685251  # MD5-based value, identical in DuckDB


def test_product_key_null_half(spark):
    df = spark.createDataFrame([("A1", None), ("A1", "2")], "t string, d string")
    got = [r.k for r in df.select(K.product_key("t", "d").alias("k")).collect()]
    assert got[0] is None and got[1] is not None


def test_iso_week_and_weekday(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2024, 12, 29),), (dt.date(2024, 12, 28),)], "d date")
    out = {r.d: r for r in P.date_parts(df, "d").withColumn("w", P.is_weekend("d")).collect()}
    assert out[dt.date(2024, 12, 30)].WEEK_OF_YEAR == 1          # ISO week of the next year
    assert out[dt.date(2024, 12, 29)].DAY_OF_WEEK == 1 and out[dt.date(2024, 12, 29)].w  # Sunday
    assert out[dt.date(2024, 12, 28)].DAY_OF_WEEK == 7 and out[dt.date(2024, 12, 28)].w  # Saturday


def test_safe_divide_zero(spark):
    df = spark.createDataFrame([(10, 0), (10, 4), (None, 2)], "n int, d int")
    assert [r.x for r in df.select(P.safe_divide("n", "d").alias("x")).collect()] == [None, 2.5, None]


def _target(spark):
    return spark.createDataFrame(
        [("O1", 1, "SHIPPED", 5, "C1", T1, T1), ("O2", 1, "SHIPPED", 7, "C2", T1, T1)],
        "ORDER_ID string, LINE bigint, STATUS string, QTY bigint, CUST string, RAW_LOAD_DATE timestamp, "
        "CDL_LOAD_DATE timestamp")


def _source(spark):
    return spark.createDataFrame(
        [("O1", 1, "INVOICED", 6, "CX", T2), ("O3", 1, "SHIPPED", 9, "C3", T2)],
        "ORDER_ID string, LINE bigint, STATUS string, QTY bigint, CUST string, RAW_LOAD_DATE timestamp")


def test_merge_upsert_matched_unmatched_and_nonupdatable(spark):
    out = M.merge_upsert(_target(spark), _source(spark), ["ORDER_ID", "LINE"], ["STATUS", "QTY", "RAW_LOAD_DATE"], T2)
    got = {r.ORDER_ID: r for r in out.collect()}
    assert got["O1"].STATUS == "INVOICED" and got["O1"].QTY == 6        # updated
    assert got["O1"].CUST == "C1"                                       # not in update list: target kept (T7)
    assert got["O1"].CDL_LOAD_DATE == T2                                 # stamped
    assert got["O2"].CDL_LOAD_DATE == T1 and got["O2"].QTY == 7          # target only: untouched
    assert got["O3"].CUST == "C3" and got["O3"].CDL_LOAD_DATE == T2      # inserted


def test_merge_twice_same_as_once(spark):
    once = M.merge_upsert(_target(spark), _source(spark), ["ORDER_ID", "LINE"], ["STATUS", "QTY"], T2)
    twice = M.merge_upsert(once, _source(spark), ["ORDER_ID", "LINE"], ["STATUS", "QTY"], T2)
    assert rows(once, *once.columns) == rows(twice, *twice.columns)


def test_merge_null_key_never_matches(spark):
    t = spark.createDataFrame([(None, 1, T1)], "K string, V bigint, CDL_LOAD_DATE timestamp")
    s = spark.createDataFrame([(None, 2)], "K string, V bigint")
    assert M.merge_upsert(t, s, ["K"], ["V"], T2).count() == 2                 # literal (T21)
    assert M.merge_upsert(t, s, ["K"], ["V"], T2, null_safe=True).count() == 1  # option


def test_merge_empty_target(spark):
    empty = _target(spark).limit(0)
    out = M.merge_upsert(empty, _source(spark), ["ORDER_ID", "LINE"], ["STATUS"], T2)
    assert out.count() == 2


def test_cardinality_guard(spark):
    s = _source(spark).unionByName(_source(spark).limit(1))
    with pytest.raises(M.MergeCardinalityError):
        M.assert_unique_source(s, ["ORDER_ID", "LINE"])
    assert M.duplicate_source_keys(s, ["ORDER_ID", "LINE"]).count() == 1


def test_insert_only(spark):
    t = spark.createDataFrame([(1, "a", T1)], "K bigint, V string, CDL_LOAD_DATE timestamp")
    s = spark.createDataFrame([(1, "changed"), (2, "b")], "K bigint, V string")
    out = {r.K: r for r in M.merge_insert_only(t, s, ["K"], T2).collect()}
    assert out[1].V == "a" and out[2].V == "b" and out[2].CDL_LOAD_DATE == T2


def test_dedup_latest_is_order_independent(spark):
    data = [("k", T1, "b"), ("k", T2, "z"), ("k", T2, "a")]
    a = spark.createDataFrame(data, "k string, ts timestamp, v string")
    b = spark.createDataFrame(list(reversed(data)), "k string, ts timestamp, v string").repartition(3)
    pick = lambda df: W.dedup_latest(df, ["k"], [F.col("ts").desc()], ["ts"]).collect()[0].v
    assert pick(a) == pick(b) == "a"


def test_drill_across_keeps_both_unmatched_sides(spark):
    d = spark.createDataFrame([("p", 1, 10), ("p", 2, 5)], "p string, m int, q int")
    f = spark.createDataFrame([("p", 2, 7), ("p", 3, 1)], "p string, m int, q int")
    out = J.drill_across([(d, [F.sum("q").alias("dq")]), (f, [F.sum("q").alias("fq")])], ["p", "m"])
    assert rows(out, "m", "dq", "fq") == [(1, 10, None), (2, 5, 7), (3, None, 1)]


def test_interval_join_latest_effective(spark):
    s = spark.createDataFrame([(1, "o1", dt.date(2024, 6, 1)), (2, "o2", dt.date(2024, 6, 1))], "k int, id string, d date")
    h = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 12, 31), 5),
                               (1, dt.date(2024, 5, 1), dt.date(2024, 12, 31), 6)],
                              "k int, EFFECTIVE_DATE date, EXPIRY_DATE date, price int")
    out = dict(rows(J.interval_join(s, h, "k", "d", ["id"], ["price"]), "id", "price"))
    assert out == {"o1": 6, "o2": None}


def test_fill_defaults_by_type(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a bigint, b string, c date, d boolean")
    r = P.fill_defaults(df).collect()[0]
    assert (r.a, r.b, r.c, r.d) == (0, "N/A", dt.date(1900, 1, 1), False)


def test_categorize_messages_first_match(spark):
    df = spark.createDataFrame([("FLOAT64 vs NUMERIC, column not found",), ("Syntax error at x",), (None,)], "m string")
    got = [r.c for r in df.select(P.categorize_messages("m").alias("c")).collect()]
    assert got == ["type_mismatch_float_numeric", "syntax_error", "other"]


def test_dq_suite_detects_duplicates_but_not_deleted(spark):
    df = spark.createDataFrame([(1, False), (1, None), (2, False), (2, True)], "ADMIN_COMPOSITEKEY_HASH bigint, "
                               "ADMIN_ISDELETED boolean")
    v = {r.check_name: r for r in Q.run_suite(df).collect()}
    assert v["duplicate_check"].status == "fail" and v["duplicate_check"].violations == 1   # key 1 only
    assert v["null_check"].violations == 1 and v["row_count_check"].status == "pass"
    assert Q.suite_passed(Q.run_suite(df)).collect()[0].passed is False


def test_weekly_calendar_week_numbers(spark):
    w = D.weekly_calendar(spark, dt.date(2024, 1, 1), dt.date(2025, 12, 31)).orderBy("WEEK_START_DATE").collect()
    assert len(w) == 105 and w[0].WEEK_START_DATE == dt.date(2024, 1, 1)
    first_2025 = [r for r in w if r.YEAR == 2025][0]
    assert first_2025.WEEK_OF_YEAR == 2 and w[-1].WEEK_OF_YEAR == 53   # T9


def test_forecast_horizon_thirty_day_steps(spark):
    snaps = spark.createDataFrame([(dt.date(2024, 1, 31),)], "AS_OF_DATE date")
    got = [r.FORECAST_DATE for r in D.forecast_horizon(snaps, "AS_OF_DATE", 3).orderBy("_step").collect()]
    assert got == [dt.date(2024, 1, 1), dt.date(2024, 3, 1), dt.date(2024, 3, 1)]  # T10: skip and repeat


def test_top_lessons_limit_then_first_per_category(spark):
    df = spark.createDataFrame([("a", "m1", "f", "c")] * 3 + [("a", "m2", "f", "c")] * 2 + [("b", "m3", "f", "c")],
                               "error_category string, error_message string, fix_description string, context string")
    out = rows(A.top_lessons(df, 10), "error_pattern", "example_error", "occurrences")
    assert out == [("a", "m1", 3), ("b", "m3", 1)]


def test_filter_in_is_one_predicate_at_any_length(spark):
    from strata.operators.filters import filter_in
    df = spark.sql("SELECT date_add(date'2020-01-01', cast(id as int)) AS d FROM range(5000)")
    days = [str(dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(0, 3000, 2)]
    for n in (1, 1000, 1001, 1500):
        assert filter_in(df, "d", days[:n] + days[:1]).count() == n
    assert filter_in(df, "d", spark.createDataFrame([(days[0],)], "x string").selectExpr("cast(x as date) x")).count() == 1


def test_approx_count_distinct_close(spark):
    df = spark.range(20000).selectExpr("id % 3 AS g", "id AS v")
    exact = {r.g: r.n for r in df.groupBy("g").agg(A.count_distinct("v").alias("n")).collect()}
    approx = {r.g: r.n for r in df.groupBy("g").agg(A.count_distinct("v", approx=True).alias("n")).collect()}
    assert all(abs(approx[g] - exact[g]) / exact[g] < 0.05 for g in exact)


def test_interval_join_equal_effective_dates_is_deterministic(spark):
    s = spark.createDataFrame([(1, "o1", dt.date(2024, 6, 1))], "k int, id string, d date")
    rows = [(1, dt.date(2024, 1, 1), dt.date(2024, 12, 31), 9), (1, dt.date(2024, 1, 1), dt.date(2024, 12, 31), 7)]
    for data in (rows, rows[::-1]):
        h = spark.createDataFrame(data, "k int, EFFECTIVE_DATE date, EXPIRY_DATE date, price int").repartition(2)
        assert J.interval_join(s, h, "k", "d", ["id"], ["price"]).collect()[0].price == 7


def test_missing_keys_by_bucket_digests(spark):
    from strata.operators import dq as Q
    want = [(i, None if i % 50 == 0 else f"k{i % 7}") for i in range(2000)]
    lost = {3, 50, 1999}
    expected = spark.createDataFrame(want + want[:30], "a int, b string")
    actual = spark.createDataFrame([r for r in want if r[0] not in lost] + [(9999, "more")] + want[100:140], "a int, b string")
    got = Q.missing_keys(expected, actual, ["a", "b"], buckets=64)
    assert {tuple(r) for r in got.collect()} == {r for r in want if r[0] in lost} and got.count() == 3
    assert Q.missing_keys(expected, expected, ["a", "b"]).count() == 0
    assert Q.missing_keys(expected, actual.limit(0), ["a", "b"]).count() == 2000
    once = [spark.createDataFrame(rows, "a int, b string") for rows in (want, want[5:])]
    assert {r.a for r in Q.missing_keys(*once, ["a", "b"], unique=True).collect()} == set(range(5))
