"""Loads and suites that follow the change: mappings executed twice, profiles by folder, files with disjoint keys."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from strata.operators import dq as Q
from strata.operators.aggs import top_lessons
from strata.operators.merge import merge_upsert
from strata.plans.mapping import FieldMapping, TableMapping, load_mapping, read_mapped
from strata.plans.profiles import refresh_profile, stored_suite
from strata.sources import store


def _rows(df):
    return sorted(tuple("NULL" if v is None else str(v) for v in r) for r in df.collect())


def _mapping(**more):
    return TableMapping("t", [FieldMapping("ID", "INT64", "id", is_key=True), FieldMapping("DAY", "DATE", "day"),
                              FieldMapping("V", "STRING", "v", value="none"), FieldMapping("AT", "INT64", "at")], **more)


def _feed(spark, rows):
    return spark.createDataFrame(rows, "id bigint, day string, v string, at bigint").select("id", F.col("day").cast("date"), "v", "at")


@pytest.mark.parametrize("parts", [[], ["DAY"], ["DAY", "V"]])
def test_a_mapping_loads_what_its_lists_say(spark, parts):
    path, tm = tempfile.mkdtemp(prefix="strata-map-"), _mapping(incremental_field="AT", partition_fields=parts)
    first = [(1, "2024-01-01", "a", 1), (2, "2024-02-01", None, 2), (2, "2024-02-01", "old", 1), (3, "2024-03-01", "c", None)]
    assert load_mapping(_feed(spark, first), tm, path) == {"inserted": 3, "updated": 0, "unchanged": 0}
    seq = store.current_seq(spark, path)
    assert sum(load_mapping(_feed(spark, first), tm, path).values()) == 0 and store.current_seq(spark, path) == seq
    # key 1 moves to another partition; key 2 again at the mark; key 3 without a stamp never replaces; key 4 is before the mark
    second = [(1, "2024-02-01", "a2", 3), (2, "2024-02-01", "tie", 2), (3, "2024-03-01", "later", None), (4, "2024-01-01", "late", 1), (5, None, "e", 4)]
    counts = load_mapping(_feed(spark, second), tm, path)
    assert (counts["inserted"], counts["updated"]) == (1, 2)
    assert _rows(read_mapped(spark, tm, path)) == sorted([("1", "2024-02-01", "a2", "3"), ("2", "2024-02-01", "tie", "2"),
                                                          ("3", "2024-03-01", "c", "NULL"), ("5", "NULL", "e", "4")])
    seq = store.current_seq(spark, path)
    load_mapping(_feed(spark, second), tm, path)
    assert store.current_seq(spark, path) == seq


def test_a_mapping_without_a_mark_merges_what_differs(spark):
    path, tm = tempfile.mkdtemp(prefix="strata-map-"), _mapping()
    load_mapping(_feed(spark, [(1, "2024-01-01", "a", 1), (2, None, "b", None)]), tm, path)
    assert load_mapping(_feed(spark, [(1, "2024-01-01", "a", 1), (2, None, "c", None)]), tm, path)["updated"] == 1
    assert _rows(read_mapped(spark, tm, path)) == [("1", "2024-01-01", "a", "1"), ("2", "NULL", "c", "NULL")]


def test_the_mark_reaches_the_scan_and_null_keys_fail(spark):
    base = tempfile.mkdtemp(prefix="strata-map-")
    tm = _mapping(incremental_field="AT")
    spark.range(100).selectExpr("id", "date'2024-01-01' day", "'x' v", "id at").write.parquet(os.path.join(base, "feed"))
    feed = spark.read.parquet(os.path.join(base, "feed"))
    from strata.plans.mapping import _from_mark
    plan = _from_mark(feed, tm, 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at,50)" in plan
    with pytest.raises(Exception, match="NULL in key"):
        load_mapping(_feed(spark, [(None, None, "x", 1)]), tm, os.path.join(base, "t"))
    with pytest.raises(ValueError):
        load_mapping(feed, TableMapping("t", [FieldMapping("V", "STRING", "v")]), os.path.join(base, "u"))


def _by_column(df):
    return _rows(df.select("check_name", "expected", "severity", "violations", "detail", "status"))


def test_stored_suite_equals_the_full_scan_and_reads_new_folders_only(spark):
    path, state = tempfile.mkdtemp(prefix="strata-prof-"), tempfile.mkdtemp(prefix="strata-prof-")
    kind = "k bigint, m string, v string, ADMIN_ISDELETED boolean"

    def land(rows):
        store.merge_partitions(spark, path, spark.createDataFrame(rows, kind), "m", ["m"], lambda old, new: new)

    def check(read):
        assert len(refresh_profile(spark, path, state, ["k"])) == read
        table = store.read_table(spark, path)
        assert _by_column(stored_suite(spark, path, state, ["k"], table.schema)) == _by_column(Q.run_suite(table, ["k"], table.schema))

    land([(1, "a", "x", False), (2, "a", None, None), (2, "b", "y", False), (3, None, "z", False)])
    check(3)
    check(0)
    land([(2, "b", None, True), (4, "c", "y", False), (4, "c", "y", False), (None, "c", None, False)])
    check(2)
    land([(3, "a", "x", False)])       # key 3 lies in two months now
    check(1)
    # other keys: every folder is read again
    assert len(refresh_profile(spark, path, state, ["k", "m"])) == 4


def test_stored_suite_of_an_empty_table_and_a_new_column(spark):
    path, state = tempfile.mkdtemp(prefix="strata-prof-"), tempfile.mkdtemp(prefix="strata-prof-")
    store.full_refresh(spark.createDataFrame([], "k bigint, v string"), path)
    assert _by_column(stored_suite(spark, path, state, ["k"])) == _by_column(Q.run_suite(store.read_table(spark, path), ["k"]))
    store.append_log(spark.createDataFrame([(1, "a")], "k bigint, v string"), path)
    refresh_profile(spark, path, state, ["k"])
    store.append_log(spark.createDataFrame([(1, "a", None), (2, "b", "w")], "k bigint, v string, w string"), path)
    got = stored_suite(spark, path, state, ["k"])
    assert _by_column(got) == _by_column(Q.run_suite(store.read_table(spark, path), ["k"]))
    assert {r["check_name"]: r["violations"] for r in got.collect()} == {"row_count_check": 3, "null_check": 2, "duplicate_check": 1}


def test_files_of_a_month_have_disjoint_key_ranges(spark):
    path = tempfile.mkdtemp(prefix="strata-mart-")
    # one key holds a third of all rows
    df = spark.range(30000).selectExpr("date_add(date'2024-01-01', cast(id % 60 as int)) d", "if(id % 3 = 0, 7, id * 37 % 1001) a", "id b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_mart(df, path, "d", ["a", "b"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = store.read_table(spark, path).withColumn("f", F.input_file_name())
    spans = {}
    for r in table.groupBy("LOAD_MONTH", "f").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).collect():
        spans.setdefault(r["LOAD_MONTH"], []).append((tuple(r["lo"]), tuple(r["hi"])))
    assert table.count() == 30000 and max(len(v) for v in spans.values()) >= 3
    for v in spans.values():
        v.sort()
        assert all(hi < lo for (_, hi), (lo, _) in zip(v, v[1:]))
    month = max(spans, key=lambda m: len(spans[m]))
    read = [s for s in spans[month] if s[0][0] <= 900 <= s[1][0]]   # the files whose statistics admit the key
    assert len(read) < len(spans[month])


@pytest.mark.parametrize("n", [1, 2, 3, 10])
def test_top_lessons_with_and_without_ties(spark, n):
    rows = [("c1", "m1", "f", "x")] * 5 + [("c1", "m2", "f", None)] * 3 + [("c2", "m3", None, "x")] * 3 + [(None, None, None, None)] * 2 + [("c2", "", "g", "y")]
    df = spark.createDataFrame(rows, "error_category string, error_message string, fix_description string, context string")
    groups = {}
    for r in rows:
        groups[r] = groups.get(r, 0) + 1
    nulls_first = lambda r: [(v is not None, v or "") for v in r]
    top = sorted(groups, key=lambda r: (-groups[r], nulls_first(r)))[:n]
    want = {}
    for r in sorted(top, key=lambda r: (-groups[r], nulls_first(r[1:]))):
        want.setdefault(r[0] or "other", (r[0] or "other", r[2] or "", r[1] or "", r[3] or "execution", str(groups[r])))
    got = top_lessons(df, n)
    assert sorted(tuple(str(v) for v in r) for r in got.collect()) == sorted(want.values())
