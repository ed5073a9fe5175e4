"""What a query holds on disk: shuffles of a step go when it ends, tables that nothing reads are deleted, and rows are moved without
what can be computed where they are written."""

import os

import __spark_entry__ as E
import pytest
from pyspark.sql import functions as F

from strata import session
from strata.plans import marts as M
from strata.plans.cdl import DEFAULT_RUN_TS
from strata.registry import Ctx
from strata.sources import store

SF = "/root/testdata/sf0.001"


def _shuffles(spark):
    """Shuffle files that are on disk now."""
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def _relations(df, col):
    return sum("Relation" in x and f"{col}#" in x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_steps_keep_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 90).alias("k"), "id").groupBy("k").agg(F.sum("id").alias("v"))
    before, had = _shuffles(spark), spark.conf.get(session.CLEANUP, None)
    kept = session.frozen(rows, "kept")
    store.full_refresh(rows, str(tmp_path / "t"))
    store.write_jsonl(rows, str(tmp_path / "j"))
    store.append_log(rows, str(tmp_path / "l"))
    for _ in range(2):
        store.merge_partitions(spark, str(tmp_path / "m"), rows.withColumn("p", F.col("k") % 3), "p", ["k"],
                               lambda old, new: new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new))
    assert not _shuffles(spark) - before
    assert spark.conf.get(session.CLEANUP, None) == had
    assert kept.count() == store.read_table(spark, str(tmp_path / "m")).count() == 90


def test_a_failed_step_restores_the_setting(spark):
    had = spark.conf.get(session.CLEANUP, None)
    with pytest.raises(ZeroDivisionError), session.own_shuffles(spark):
        1 / 0
    assert spark.conf.get(session.CLEANUP, None) == had


def test_forgotten_tables_are_deleted(spark):
    ctx = Ctx(spark, SF)
    ctx.keep(ctx.raw, "raw_customer")
    folder = os.path.dirname(ctx.raw["raw_customer"].inputFiles()[0]).removeprefix("file://")
    assert os.path.isdir(folder)
    ctx.forget("raw_customer")
    ctx.forget("raw_customer")
    assert not os.path.exists(folder) and ctx.raw["raw_customer"].count() > 0  # built anew


def test_ndjson_is_written_small_and_read_as_before(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("ORD-"), "id").alias("ORDER_ID"), F.lit("2020-01-01").cast("date").alias("DAY"),
                                    F.when(F.col("id") % 3 > 0, F.col("id")).alias("N"))
    store.write_jsonl(rows, str(tmp_path / "j"), gzipped=True)
    files = [f for f in (tmp_path / "j").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 3 < 2000 * 55
    back = store.read_raw_jsonl(spark, str(tmp_path / "j"), rows.schema)
    assert back.exceptAll(rows).isEmpty() and back.count() == 2000


def test_admin_columns_are_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", 2), (2, "c", 3)], "k int, s string, v int")
    mart = M.build_mart(rows, ["k"], ["v"], DEFAULT_RUN_TS, "CDL")
    plan = mart._jdf.queryExecution().optimizedPlan().toString()
    assert "ADMIN_ROW_HASH" in plan.split("Window")[0] and "ADMIN_ROW_HASH" not in plan.split("Window", 1)[1]
    from strata.functions.scalars import add_admin
    want = add_admin(rows.filter("s <> 'b'").fillna(0), ["k"], ["v"], DEFAULT_RUN_TS, "CDL")
    assert mart.columns == want.columns and {r["k"] for r in mart.collect()} == {1, 2}
    assert mart.filter("k = 2").collect() == want.filter("k = 2").collect()
    store.write_mart(rows.withColumn("d", F.lit("2020-05-05").cast("date")), str(tmp_path / "t"), "d", ["k"],
                     finish=lambda df: df.withColumn("twice", F.col("k") * 2))
    assert sorted((r["k"], r["twice"], str(r["LOAD_MONTH"])) for r in store.read_table(spark, str(tmp_path / "t")).collect()) == [
        (1, 2, "2020-05-01"), (1, 2, "2020-05-01"), (2, 4, "2020-05-01")]


@pytest.mark.parametrize("name", ["b3_fact_demand_vs_sales", "b5_company_category_report"])
def test_parts_are_written_one_after_another(spark, name):
    assert _relations(E.queries()[name](spark, SF), "l_orderkey") == 0


def test_both_marts_of_u2_read_sales_that_are_written_once(spark):
    assert _relations(E.queries()["u2_combine_marts"](spark, SF), "l_orderkey") == 1  # the returns
