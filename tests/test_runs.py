"""Write paths, refresh runs and the stream: versioned swap, idempotent re-runs, stream = batch,
incremental = merge of the rows after the high-water mark."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from strata.plans import changes as CH
from strata.plans import runs as R
from strata.plans.cdl import DEFAULT_RUN_TS, build_fact_sales
from strata.plans.mapping import FieldMapping, TableMapping, apply_mapping
from strata.registry import Ctx
from strata.sources import schemas as S
from strata.sources import store

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple("NULL" if v is None else str(v) for v in r) for r in df.collect())


def test_full_refresh_swaps_versions(spark):
    path = tempfile.mkdtemp(prefix="strata-test-")
    store.full_refresh(spark.range(3).toDF("x"), path)
    v1 = store.current_version(spark, path)
    store.full_refresh(spark.range(5).toDF("x"), path)
    assert store.current_version(spark, path) != v1
    assert store.read_table(spark, path).count() == 5
    assert spark.read.parquet(v1).count() == 3          # the old version is still intact


def test_ensure_table_is_idempotent(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="strata-test-"), "runs")
    t1 = store.ensure_table(spark, path, S.PIPELINE_RUNS)
    v1 = store.current_version(spark, path)
    store.ensure_table(spark, path, S.PIPELINE_RUNS)
    assert t1.count() == 0 and store.current_version(spark, path) == v1
    assert t1.schema.fieldNames() == S.PIPELINE_RUNS.fieldNames()


def test_stream_upsert_equals_batch(spark):
    q = E.queries()
    streamed = q["r6_stream_upsert"](spark, SF)
    batch = q["m1_merge_upsert"](spark, SF)
    assert _rows(streamed.select(*batch.columns)) == _rows(batch)


def test_refresh_cdl_second_run_changes_nothing(spark):
    ctx = Ctx(spark, SF)
    root = tempfile.mkdtemp(prefix="strata-wh-")
    log1 = R.refresh_cdl(spark, ctx.raw, root, DEFAULT_RUN_TS, run_id="a")
    sales1 = store.read_table(spark, store.table_path(root, "cdl", "cdl_fact_sales"))
    before = _rows(sales1)
    log2 = R.refresh_cdl(spark, ctx.raw, root, DEFAULT_RUN_TS, run_id="b")
    after = _rows(store.read_table(spark, store.table_path(root, "cdl", "cdl_fact_sales")))
    assert [r[4] for r in log1] == ["success"] * 11 and [r[4] for r in log2] == ["success"] * 11
    assert before == after                      # same source, same run stamp: a repeat run is a no-op
    assert set(R.cdl_seqs(spark, root).values()) == {1}                        # and commits no version
    assert all(r[9:] == (0, 0, r[5]) for r in log2) and all(r[9:] == (r[5], 0, 0) for r in log1)


def test_late_unstamped_and_same_day_rows_are_merged(spark):
    ol = Ctx(spark, SF).raw["raw_order_line"]
    table, keys = "cdl_fact_sales", ["ORDER_ID", "ORDER_LINE_NO"]
    ids = F.xxhash64("ORDER_ID") % 5
    stamp = F.when(ids == 0, F.lit("2025-01-05")).when(ids == 1, F.lit("2025-01-01")).when(ids == 2, F.lit(None)).otherwise(F.lit("2025-01-03"))
    whole = ol.withColumn("LOAD_DATE", stamp.cast(ol.schema["LOAD_DATE"].dataType))
    # a later row of the first landing's keys with an equal stamp, and an older one that must not win
    tied = whole.filter(ids == 3).withColumn("ORDER_QTY", F.col("ORDER_QTY") - 1)
    old = whole.filter(ids == 4).withColumn("ORDER_QTY", F.col("ORDER_QTY") + 7).withColumn("LOAD_DATE", F.lit(None).cast(ol.schema["LOAD_DATE"].dataType))
    half = F.xxhash64(*keys) % 2 == 0
    first, rest = whole.filter(half | (F.abs(ids) >= 3)), whole.unionByName(tied).unionByName(old)
    got, want = tempfile.mkdtemp(prefix="strata-wh-"), tempfile.mkdtemp(prefix="strata-wh-")
    for raw in (first, rest):
        R._merge_months(spark, {"raw_order_line": raw}, got, table, DEFAULT_RUN_TS)
    R._merge_months(spark, {"raw_order_line": rest}, want, table, DEFAULT_RUN_TS)
    tables = [store.read_table(spark, store.table_path(x, "cdl", table)) for x in (got, want)]
    assert first.select(*keys).distinct().count() < tables[0].count()
    assert _rows(tables[0].select(*tables[1].columns)) == _rows(tables[1])


def test_refresh_bl_continues_after_failure(spark):
    root = tempfile.mkdtemp(prefix="strata-wh-")

    def bad():
        raise ValueError("x" * 5000)

    marts = {"a": R.Mart(lambda: spark.range(2), ["id"]), "bad": R.Mart(bad, ["id"]), "c": R.Mart(lambda: spark.range(3), ["id"])}
    log = R.refresh_bl(spark, marts, root, DEFAULT_RUN_TS)
    assert [(r[3], r[4], r[5]) for r in log] == [("a", "success", 2), ("bad", "failed", 0), ("c", "success", 3)]
    assert len(log[1][7]) == 1000               # error text cut to 1000 characters


def test_incremental_refresh_loads_only_new_rows(spark):
    ctx = Ctx(spark, SF)
    ol = ctx.raw["raw_order_line"]
    cut = F.lit("1997-01-01 00:00:00").cast("timestamp")
    target = build_fact_sales(ol.filter(F.col("LOAD_DATE") < cut))
    seen = []

    def merge(src, tgt):
        seen.append(src)
        return build_fact_sales(src, tgt)

    out = R.incremental_refresh(ol, target, "LOAD_DATE", "RAW_LOAD_DATE", merge)
    mark = target.agg(F.max("RAW_LOAD_DATE")).collect()[0][0]
    assert seen[0].filter(F.col("LOAD_DATE") <= F.lit(mark)).count() == 0
    assert out.select("ORDER_ID", "ORDER_LINE_NO").distinct().count() == \
        ol.select("ORDER_ID", "ORDER_LINE_NO").distinct().count()


def test_apply_mapping_static_value_and_filter(spark):
    df = spark.createDataFrame([("a", None, 5), ("b", "x", -1)], "code string, seg string, lim bigint")
    tm = TableMapping("t", [FieldMapping("ID", "STRING", "code", is_key=True),
                            FieldMapping("SEG", "STRING", "seg", value="UNKNOWN"),
                            FieldMapping("LIM", "NUMERIC", "lim")], filters=["lim > 0"])
    out = apply_mapping(df, tm).collect()
    assert len(out) == 1 and out[0].SEG == "UNKNOWN" and str(out[0].LIM) == "5.000000000"
    assert tm.keys() == ["ID"]


def test_stream_second_drop_merges_only_new_rows(spark):
    from strata.streaming.upsert import INGEST_COL, stage_stream, staged_since
    ctx = Ctx(spark, SF)
    base = tempfile.mkdtemp(prefix="strata-stream-")
    src, staging, ckpt = (os.path.join(base, d) for d in ("in", "staging", "ckpt"))
    ol = ctx.raw["raw_order_line"]
    cut = F.lit("1997-01-01").cast("date")
    store.write_jsonl(ol.filter(F.col("TRANSACTION_DATE") < cut), os.path.join(src, "drop1"))
    stage_stream(spark, os.path.join(src, "*"), S.RAW_ORDER_LINE, staging, ckpt)
    mark = spark.read.parquet(staging).agg(F.max(INGEST_COL)).collect()[0][0]
    store.write_jsonl(ol.filter(F.col("TRANSACTION_DATE") >= cut), os.path.join(src, "drop2"))
    stage_stream(spark, os.path.join(src, "*"), S.RAW_ORDER_LINE, staging, ckpt)   # only drop2 is new
    new = staged_since(spark, staging, S.RAW_ORDER_LINE, F.lit(mark))
    assert new.count() == ol.filter(F.col("TRANSACTION_DATE") >= cut).count()
    assert staged_since(spark, staging, S.RAW_ORDER_LINE).count() == ol.count()   # exactly once overall


def test_merge_partitions_rewrites_only_touched(spark):
    from strata.operators.merge import merge_upsert
    path = os.path.join(tempfile.mkdtemp(prefix="strata-part-"), "t")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k bigint, v string, m int")
    merge = lambda t, s: merge_upsert(t, s, ["k"], ["v", "m"], stamp_col=None)
    store.merge_partitions(spark, path, first, "m", ["k"], merge)
    before = dict(store._folders(spark, path))
    second = spark.createDataFrame([(2, "B", 2), (3, "c", 2)], "k bigint, v string, m int")
    store.merge_partitions(spark, path, second, "m", ["k"], merge)
    after = dict(store._folders(spark, path))
    assert after["1"] == before["1"] and after["2"] != before["2"]             # partition 1 never rewritten
    got = sorted((r.k, r.v, r.m) for r in store.read_table(spark, path).collect())
    assert got == [(1, "a", 1), (2, "B", 2), (3, "c", 2)]


def test_merge_partitions_equals_the_whole_merge(spark):
    """NULL partitions, string partitions that look like numbers, keys that change their partition."""
    from strata.operators.merge import merge_upsert
    path = os.path.join(tempfile.mkdtemp(prefix="strata-part-"), "t")
    merge = lambda t, s: merge_upsert(t, s, ["k"], ["v", "p"], stamp_col=None)
    loads = [[(1, "a", None), (2, "b", "01")], [(3, "c", None), (4, "d", "02")], [(1, "z", "02"), (2, "y", None), (5, "e", "1")]]
    whole = None
    for rows in loads:
        load = spark.createDataFrame(rows, "k bigint, v string, p string")
        store.merge_partitions(spark, path, load, "p", ["k"], merge)
        whole = spark.createDataFrame(merge(whole, load).collect(), "k bigint, v string, p string")
        got = store.read_table(spark, path)
        assert _rows(got) == _rows(whole) and dict(got.dtypes)["p"] == "string"
    assert _rows(got) == _rows(spark.createDataFrame([(1, "z", "02"), (2, "y", None), (3, "c", None), (4, "d", "02"), (5, "e", "1")], got.schema))


def test_merge_rejects_repeated_keys_and_unknown_columns(spark):
    import pytest as _pytest
    from strata.operators.merge import merge_upsert
    t = spark.createDataFrame([(1, "a")], "k bigint, v string")
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k bigint, v string")
    with _pytest.raises(Exception, match="several source rows"):
        merge_upsert(t, twice, ["k"], ["v"], stamp_col=None).collect()
    with _pytest.raises(ValueError, match="no columns"):
        merge_upsert(t, t.withColumn("w", F.lit(1)), ["k"], ["v"], stamp_col=None)
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "k bigint, v string")
    assert merge_upsert(t, nulls, ["k"], ["v"], stamp_col=None).count() == 3    # NULL never matches


def test_marts_keep_cluster_order_and_reject_a_fifth_column(spark):
    import pytest as _pytest
    path = tempfile.mkdtemp(prefix="strata-mart-")
    df = spark.range(3000).selectExpr("date_add(date'2024-01-01', cast(id * 7 % 90 as int)) d", "id * 37 % 101 a", "id * 11 % 13 b")
    store.write_mart(df, path, "d", ["a", "b"])
    files = store.read_table(spark, path).select(F.input_file_name().alias("f"), "a", "b").collect()
    by = {}
    for r in files:
        by.setdefault(r.f, []).append((r.a, r.b))
    assert len(by) >= 3 and all(v == sorted(v) for v in by.values())
    with _pytest.raises(ValueError):
        store.write_mart(df, path, "d", ["a", "b", "d", "a", "b"])


def test_profit_and_demand_keep_currencies_apart(spark):
    from strata.plans import marts as M
    ctx = Ctx(spark, SF)
    c = ctx.cdl
    two = F.when(F.col("ORDER_LINE_NO") % 2 == 0, "AAA").otherwise("BBB")
    sales = c["cdl_fact_sales"].withColumn("CURRENCY_CODE", two)
    returns = c["cdl_fact_returns"].withColumn("CURRENCY_CODE", two)
    out = M.fact_product_profitability(sales, returns, c["cdl_fact_product_price"], c["cdl_fact_product_cost"], c["cdl_dim_product"],
                                       F.lit("1998-08-02").cast("date"))
    got = {r.CURRENCY_CODE: r.n for r in out.groupBy("CURRENCY_CODE").agg(F.sum("TOTAL_RETURN_QTY").alias("n")).collect()}
    pairs = sales.select("KEY_PRODUCT", "KEY_COMPANY", "CURRENCY_CODE").distinct()
    want = {r.CURRENCY_CODE: r.n for r in returns.join(pairs, ["KEY_PRODUCT", "KEY_COMPANY", "CURRENCY_CODE"], "left_semi")
            .groupBy("CURRENCY_CODE").agg(F.sum("RETURN_QTY").alias("n")).collect()}
    assert set(got) == {"AAA", "BBB"} and got == want


def test_marts_from_written_cdl_match_lazy_plans(spark):
    log = E.queries()["r2_refresh_bl"](spark, SF).collect()
    counts = {(r.run_id, r.table_name): r.rows_affected for r in log}
    assert len(log) == 10 and counts["bl2", "fact_sales_summary"] == E.queries()["b1_fact_sales_summary"](spark, SF).count()
    assert counts["bl3", "fact_demand_vs_sales"] == E.queries()["b3_fact_demand_vs_sales"](spark, SF).count()
    assert {r.status for r in log if r.table_name == "broken_mart"} == {"failed"}


def test_sized_conf():
    from strata.session import sized_conf
    assert sized_conf(100 * 2**40, 8000)["spark.sql.shuffle.partitions"] == str(100 * 2**40 // 4 // 2**29)
    assert sized_conf(10, 8)["spark.sql.shuffle.partitions"] == "16"


def test_uncommitted_version_is_never_read(spark):
    path = tempfile.mkdtemp(prefix="strata-test-")
    store.full_refresh(spark.range(3).toDF("x"), path)
    spark.range(7).toDF("x").write.parquet(os.path.join(path, "v-crashed"))   # data written, never committed
    assert store.read_table(spark, path).count() == 3
    v2 = store.full_refresh(spark.range(5).toDF("x"), path)
    assert store.current_version(spark, path) == v2 and store.read_table(spark, path).count() == 5
    store.full_refresh(spark.range(6).toDF("x"), path)
    removed = store.vacuum(spark, path, keep=2)
    assert "v-crashed" in removed and len(removed) == 2 and store.read_table(spark, path).count() == 6


def test_concurrent_writers_on_one_base_conflict(spark):
    import pytest as _pytest
    path = tempfile.mkdtemp(prefix="strata-test-")
    store.full_refresh(spark.range(3).toDF("x"), path)
    base = store.current_seq(spark, path)
    store.full_refresh(spark.range(4).toDF("x"), path, expected_seq=base)      # writer A commits first
    with _pytest.raises(store.ConcurrentWriteError):
        store.full_refresh(spark.range(9).toDF("x"), path, expected_seq=base)  # writer B, same base
    assert store.read_table(spark, path).count() == 4                          # A's update is not lost


def test_strict_build_raises_on_repeated_merge_keys(spark):
    import pytest as _pytest
    from strata.operators.merge import MergeCardinalityError
    ctx = Ctx(spark, SF)
    with _pytest.raises(MergeCardinalityError):
        build_fact_sales(ctx.raw["raw_order_line"], strict=True)      # the test data repeats (order, line)
    assert build_fact_sales(ctx.raw["raw_company"].limit(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.RAW_ORDER_LINE.fields]), strict=True).count() == 0


def test_daily_refresh_end_to_end(spark):
    log = E.queries()["r7_daily_refresh"](spark, SF).collect()
    steps = [(r.step, r.status) for r in log]
    assert steps.count(("cdl", "success")) == 22 and steps.count(("bl", "success")) == 6
    assert steps.count(("dq", "success")) == 6
    rows = {r.table_name: r.rows_affected for r in log if r.step == "bl" and r.run_id == "day2"}
    assert rows["fact_sales_summary"] == E.queries()["b1_fact_sales_summary"](spark, SF).count()


LINE = dict(zip(S.RAW_ORDER_LINE.names, [None] * len(S.RAW_ORDER_LINE.names)))


def _lines(spark, *rows):
    """RAW order lines (order, line, day of the order, quantity, load day, customer)."""
    full = [LINE | {"ORDER_ID": o, "ORDER_LINE_NO": n, "TRANSACTION_DATE": dt.date.fromisoformat(d), "ORDER_QTY": q,
                    "LOAD_DATE": dt.datetime.fromisoformat(t) if t else None, "CUSTOMER_CODE": c} for o, n, d, q, t, c in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], T.StructType([T.StructField(f.name, f.dataType) for f in S.RAW_ORDER_LINE.fields]))


DAY = [("A", 1, "2024-01-05", 1, "2024-01-06", "c1"), ("B", 1, "2024-02-05", 2, "2024-02-06", "c1"), ("C", 1, "2024-03-05", 3, None, "c1"),
       ("T", 1, "2024-03-06", 5, "2024-03-07", "c2"), ("T", 1, "2024-03-06", 4, "2024-03-07", "c1"), ("N", None, "2024-03-09", 1, "2024-03-09", "c1")]


def _run(spark, root, *rows):
    """One refresh of the sales fact; its changes and the folders its commit replaced or added, by month."""
    path = store.table_path(root, "cdl", "cdl_fact_sales")
    before = store.partition_folders(spark, path)
    total, counts = R._merge_months(spark, {"raw_order_line": _lines(spark, *rows)}, root, "cdl_fact_sales", DEFAULT_RUN_TS)
    after = store.partition_folders(spark, path)
    assert total == store.read_table(spark, path).count()
    return counts["inserted"], counts["updated"], sorted(v[:7] for f, v in after.items() if f not in before)


def _held(spark, root):
    table = store.read_table(spark, store.table_path(root, "cdl", "cdl_fact_sales"))
    return sorted((r.ORDER_ID, r.ORDER_QTY, r.CUSTOMER_CODE) for r in table.collect())


def test_refresh_converges_and_touches_the_changed_month(spark):
    root = tempfile.mkdtemp(prefix="strata-wh-")
    assert _run(spark, root, *DAY) == (5, 0, ["2024-01", "2024-02", "2024-03"])
    assert _run(spark, root, *reversed(DAY)) == (0, 0, [])                     # equal RAW in another order: no version
    # a newer row whose customer, which a MERGE never updates, is another one: taken in once
    two = [*DAY, ("B", 1, "2024-02-05", 7, "2024-02-20", "c9")]
    assert _run(spark, root, *two) == (0, 1, ["2024-02"]) and _run(spark, root, *two) == (0, 0, [])
    assert ("B", 7, "c1") in _held(spark, root)
    # rows tied on key and stamp are settled once, also when a third tied row lands in another month
    assert ("T", 4, "c1") in _held(spark, root)
    three = [*two, ("T", 1, "2024-01-20", 9, "2024-03-07", "c3")]
    assert _run(spark, root, *three)[0] == 0 and _run(spark, root, *three) == (0, 0, [])
    # late: an older row of a known key changes nothing, a new key without a stamp is inserted
    four = [*three, ("A", 1, "2024-01-05", 99, "2023-01-01", "c1"), ("Z", 1, "2024-01-09", 8, None, "c1")]
    assert _run(spark, root, *four) == (1, 0, ["2024-01"]) and ("A", 1, "c1") in _held(spark, root)
    # a value corrected in place under the same stamp
    fixed = [("C", 1, "2024-03-05", 33, None, "c1") if r[0] == "C" else r for r in four]
    assert _run(spark, root, *fixed) == (0, 1, ["2024-03"]) and ("C", 33, "c1") in _held(spark, root)
    assert _run(spark, root, *fixed) == (0, 0, [])
    # a run that died before it noted its digests finds its rows held
    state = R._state_path(root, "raw_digests", "cdl_fact_sales")
    store.full_refresh(store.read_table(spark, state).filter("month is null"), state)
    assert _run(spark, root, *fixed) == (0, 0, [])


def test_month_digests_see_multisets(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string").withColumn("d", F.lit("2024-05-07").cast("date"))
    digest = lambda df: CH.table_digest(df, "d")
    assert digest(one) == digest(one.orderBy(F.col("a").desc()).repartition(3))
    assert digest(one) != digest(one.dropDuplicates()) and digest(one) != digest(one.withColumn("b", F.lit("x")))
    swapped = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert CH.table_digest(swapped[0]) != CH.table_digest(swapped[1]) and digest(one.limit(0)) == {}


def test_marts_follow_their_tables(spark):
    """A second landing, a renamed product, a new price and a later as-of date: the touched groups are recomputed, and
    every mart equals one built anew; a run without changes commits nothing."""
    from strata.queries import io
    ctx, root = Ctx(spark, SF), tempfile.mkdtemp(prefix="strata-wh-")
    first, second = io.landings(ctx)
    later = F.lit("2030-01-01").cast("timestamp")
    product = second["raw_product"]
    renamed = F.col("TOY_NO") == product.agg(F.min("TOY_NO")).first()[0]
    price = second["raw_price"].withColumn("PRICE", F.when(renamed, F.col("PRICE") + 1).otherwise(F.col("PRICE")).cast(S.NUMERIC))
    second = second | {"raw_product": product.withColumn("PRODUCT_NAME", F.when(renamed, "renamed").otherwise(F.col("PRODUCT_NAME")))
                       .withColumn("LOAD_DATE", F.when(renamed, later).otherwise(F.col("LOAD_DATE"))), "raw_price": price}
    logs = []
    for run, raw, as_of in (("a", first, "1996-06-30"), ("b", second, "1998-08-02"), ("c", second, "1998-08-02")):
        R.refresh_cdl(spark, raw, root, DEFAULT_RUN_TS, run)
        marts = io.standard_marts(R.written_cdl(spark, root), as_of)
        logs.append(R.refresh_bl(spark, marts, root, DEFAULT_RUN_TS, run))
        assert [r[4] for r in logs[-1]] == ["success"] * 3, logs[-1]
        if run == "b":
            seqs = {m: store.current_seq(spark, store.table_path(root, "bl", m)) for m in marts}
    assert seqs == {m: store.current_seq(spark, store.table_path(root, "bl", m)) for m in marts}
    assert all(r[9] + r[10] == 0 and r[11] == r[5] for r in logs[2]) and all(r[10] for r in logs[1]) and logs[1][0][11]
    for name, mart in marts.items():
        whole, held = mart.build(), store.read_table(spark, store.table_path(root, "bl", name))
        assert _rows(held.select(*whole.columns)) == _rows(whole), name
    assert store.read_table(spark, store.table_path(root, "bl", "fact_sales_summary")).filter("PRODUCT_NAME = 'renamed'").count() > 0


def test_a_mart_keeps_the_stamps_of_equal_rows(spark):
    from strata.functions.scalars import add_admin
    from strata.operators.merge import merge_mart
    later = DEFAULT_RUN_TS + dt.timedelta(days=1)
    mart = lambda rows, ts: add_admin(spark.createDataFrame(rows, "k int, v int"), ["k"], [], ts, "CDL")
    old = mart([(1, 1), (2, 2), (4, 4)], DEFAULT_RUN_TS)
    got = merge_mart(old, mart([(1, 1), (2, 9), (3, 3)], later), later, change_col="c", skip_equal=True).collect()
    assert {r.k: (r.v, r.c, r.ADMIN_LAST_MODIFIED_DATE == later, r.ADMIN_DML_OPERATION_FLAG) for r in got} == {
        1: (1, "unchanged", False, "INSERT"), 2: (9, "updated", True, "UPDATE"), 3: (3, "inserted", True, "INSERT"), 4: (4, "unchanged", False, "INSERT")}
