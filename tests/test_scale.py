"""What a task, a join or a query holds must not grow with a table: yearly rows, interval arrays, shared steps."""

import datetime as dt

import __spark_entry__ as E
from pyspark.sql import functions as F

from strata.operators.joins import interval_join
from strata.sources import testdata as D

SF = "/root/testdata/sf0.001"


def _scans(df, table):
    return df._jdf.queryExecution().optimizedPlan().toString().count("l_linenumber#" if table == "lineitem" else table)


def test_yearly_rows_are_made_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "PARTS_A_TASK", 100)
    rows = [(i, i % 50, 900.0 + i) for i in range(1000)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(dt.datetime(1992, 1, 1),), (dt.datetime(1994, 1, 1),)], "o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    price = D.raw_price(spark, str(tmp_path))
    tasks = price.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 1000 * 3 * 2
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 2000


def test_interval_arrays_are_never_broadcast(spark):
    d = dt.date
    facts = spark.createDataFrame([(1, d(2020, 5, 1)), (1, d(2021, 5, 1)), (None, d(2020, 5, 1)), (2, d(2020, 5, 1))], "k long, day date")
    hist = spark.createDataFrame([(1, d(2020, 1, 1), d(2020, 12, 31), 10), (1, d(2021, 1, 1), d(2021, 12, 31), 11)],
                                 "k long, EFFECTIVE_DATE date, EXPIRY_DATE date, v int")
    out = interval_join(facts, hist, "k", "day", ["k", "day"], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r["v"] for r in out.collect() if r["v"] is not None) == [10, 11] and out.count() == 4


def test_order_lines_are_shuffled_without_the_customer_key(spark):
    plan = D.order_lines_joined(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    depth = {name: next(len(x) - len(x.lstrip(" :+-")) for x in lines if "Relation" in x and f"{name}#" in x) for name in ("l_orderkey", "c_custkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]  # joined to the orders, below the join with the lines


def test_shared_steps_are_computed_once(spark):
    q = E.queries()
    for name, most in (("b3_fact_demand_vs_sales", 1), ("b4_build_mart", 0), ("b5_company_category_report", 1)):
        plan = q[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation" in x and "l_orderkey#" in x for x in plan.split("\n")) <= most, name
