"""Sources, sinks, table management, refresh runs and the stream.

These queries write to a fresh folder under the shared scratch root (next to the cluster's
checkpoint folder) and return what they read back, so the driver's rows-only check exercises the
real read/write path. They have no SQL oracle: their output is files.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from ..plans import cdl as C
from ..plans import runs as R
from ..plans.cdl import DEFAULT_RUN_TS, build_fact_sales
from .. import oracle_sql as O
from ..registry import register
from . import marts as _marts, relational as _rel, upserts as _ups  # noqa: F401  (register the CTEs used below)
from ..session import discard, own_shuffles, scratch_root
from ..sources import schemas as S
from ..sources import store
from ..sources.testdata import MONTHLY, pipeline_runs
from ..streaming.upsert import stream_upsert


def _scratch(ctx, what: str) -> str:
    return os.path.join(scratch_root(ctx.spark), f"{what}-{uuid.uuid4().hex}")


@register("s1_read_raw_jsonl", O.sql(f"SELECT {O.render(S.RAW_RETURN)} FROM raw_return", "raw_return"))
def s1(ctx):
    """S1 + S3: RAW returns written as NDJSON (ISO dates), read back with the declared schema, FAILFAST."""
    path = _scratch(ctx, "jsonl")
    store.write_jsonl(ctx.raw["raw_return"], path)
    return store.read_raw_jsonl(ctx.spark, path, S.RAW_RETURN)


@register("s2_read_raw_csv", O.sql(f"SELECT {O.render(S.RAW_CUSTOMER)} FROM raw_customer", "raw_customer"))
def s2(ctx):
    """RAW customers written as headered CSV and read back with the declared schema."""
    path = _scratch(ctx, "csv")
    store.write_csv(ctx.raw["raw_customer"], path)
    return store.read_raw_csv(ctx.spark, path, S.RAW_CUSTOMER)


@register("s4_load_truncate", O.sql(f"SELECT {O.render(S.RAW_PRODUCT)} FROM raw_product", "raw_product"))
def s4(ctx):
    """Truncate-and-load twice; readers see exactly the second load (version swap)."""
    path = _scratch(ctx, "table")
    store.load_truncate(ctx.raw["raw_product"].filter(F.col("STATUS") == "ACTIVE"), path)
    store.load_truncate(ctx.raw["raw_product"], path)
    return store.read_table(ctx.spark, path)


@register("s5_ensure_table_append_log", O.sql(f"SELECT {O.render(S.PIPELINE_RUNS)} FROM runs", "runs"))
def s5(ctx):
    """S5 + S6: create the run-log table only if missing (typed, empty), then append the runs;
    the second ensure is a no-op and the table reads back what was appended."""
    path = _scratch(ctx, "ops")
    store.ensure_table(ctx.spark, path, S.PIPELINE_RUNS)
    store.append_log(pipeline_runs(ctx.spark, ctx.sf_dir), path)
    store.ensure_table(ctx.spark, path, S.PIPELINE_RUNS)
    return store.read_table(ctx.spark, path)


_S7_OUT = ["KEY_CALENDAR", "KEY_PRODUCT", "KEY_COMPANY", "KEY_CUSTOMER", "KEY_SELLING_METHOD", "TOTAL_ORDER_QTY"]


@register("s7_write_mart", O.sql(f"""
SELECT {', '.join(_S7_OUT[:-1])}, cast(TOTAL_ORDER_QTY as bigint) TOTAL_ORDER_QTY,
       cast(cast(date_trunc('month', TRANSACTION_DATE) as date) as varchar) LOAD_MONTH FROM b1_mart""", "b1_mart"))
def s7(ctx):
    """The sales summary mart with its ADMIN block, month-partitioned and clustered by two keys,
    committed as a version and read back."""
    from ..functions.scalars import add_admin
    from ..session import frozen
    from .marts import b1

    def with_admin(rows):
        mart = add_admin(rows, ["KEY_CALENDAR", "KEY_PRODUCT", "KEY_COMPANY", "KEY_CUSTOMER", "KEY_SELLING_METHOD"],
                         ["COMPANY_CODE"], DEFAULT_RUN_TS, "CDL", beside=("LOAD_MONTH",))
        return mart.withColumn("ADMIN_LOAD_DATE", F.col("TRANSACTION_DATE").cast("timestamp"))

    ctx.keep(ctx.cdl, "cdl_fact_sales")
    summary = frozen(b1(ctx), "summary")
    ctx.forget("cdl_fact_sales")
    path = _scratch(ctx, "mart")
    store.write_mart(summary, path, "TRANSACTION_DATE", ["KEY_COMPANY", "KEY_PRODUCT"], finish=with_admin)
    return store.read_table(ctx.spark, path).select(*_S7_OUT, F.col("LOAD_MONTH").cast("string"))


@register("s10_schema_from_sample", O.sql(" UNION ALL ".join(
    f"SELECT '{f.name}' column_name, 'string' data_type, count({f.name}) = 0 null_only FROM raw_company"
    for f in S.RAW_COMPANY.fields) + " UNION ALL SELECT 'SPARE', 'string', true", "raw_company"))
def s10(ctx):
    """The company table and one column that is always NULL, written as JSON lines and described
    as (column, type, null_only) from the files alone."""
    path = _scratch(ctx, "sample")
    ctx.raw["raw_company"].withColumn("SPARE", F.lit(None).cast("string")).write.option("ignoreNullFields", False).json(path)
    return store.schema_from_sample(ctx.spark, path)


@register("m7_replace_table", O.sql("SELECT COMPANY_CODE, REGION, CURRENCY_CODE FROM raw_company", "raw_company"))
def m7(ctx):
    """M7: CREATE OR REPLACE: the second version of the table has a different schema."""
    path = _scratch(ctx, "replace")
    store.replace_table(ctx.raw["raw_company"].select("COMPANY_CODE"), path)
    store.replace_table(ctx.raw["raw_company"].select("COMPANY_CODE", "REGION", "CURRENCY_CODE"), path)
    return store.read_table(ctx.spark, path)


# The landings of the refresh queries: order lines and returns stamped before the day, then all rows.
DAY2 = "1997-01-01 00:00:00"
_EARLY = f"LOAD_DATE < TIMESTAMP '{DAY2}'"


def landings(ctx) -> tuple[dict, dict]:
    """RAW tables, written once, as they lie on two days: the second day adds order lines and returns, some for orders
    of the first."""
    path = _scratch(ctx, "raw")
    ctx.keep(ctx.raw, MONTHLY)
    for name in S.RAW:
        with own_shuffles(ctx.spark):
            ctx.raw[name].write.options(**store.PARQUET).parquet(os.path.join(path, name))
    ctx.forget(MONTHLY)
    raw = {n: ctx.spark.read.schema(ctx.raw[n].schema).parquet(os.path.join(path, n)) for n in S.RAW}
    early = F.col("LOAD_DATE") < F.lit(DAY2).cast("timestamp")
    return {n: df.filter(early) if n in ("raw_order_line", "raw_return") else df for n, df in raw.items()}, raw


def _two_days(table: str, raw: str, schema, keys: dict, merge_keys: list[str], update: list[str]) -> None:
    """CTEs <table>_day1 and <table>_day2: the fact after the first landing, and after the second merged into it."""
    O._cdl(f"{table}_day1", raw, schema, keys, merge_keys, where=f"WHERE {_EARLY}")
    O._cdl(f"{table}_late", raw, schema, keys, merge_keys, where=f"WHERE NOT {_EARLY}", stamp=None)
    O.cte(f"{table}_day2", O.merge_sql(f"{table}_day1", f"{table}_late", schema, merge_keys, [*update, "RAW_LOAD_DATE"], "CDL_LOAD_DATE", O.RUN_TS),
          f"{table}_day1", f"{table}_late")


_two_days("cdl_fact_sales", "raw_order_line", S.CDL_FACT_SALES, O.SALES_KEYS, ["ORDER_ID", "ORDER_LINE_NO"], C.SALES_UPDATE)
_two_days("cdl_fact_returns", "raw_return", S.CDL_FACT_RETURNS, O.RETURN_KEYS, ["RETURN_ID", "ORDER_LINE_NO"], C.RETURNS_UPDATE)
O.cte("days", f"""
SELECT min(d) FILTER (early) lo1, max(d) FILTER (early) hi1, min(d) FILTER (o) lo2, max(d) hi2
FROM (SELECT TRANSACTION_DATE d, {_EARLY} early, true o FROM raw_order_line UNION ALL SELECT RETURN_DATE, {_EARLY}, false FROM raw_return) x""",
      "raw_order_line", "raw_return")

_WHOLE = [t for t in R.CDL_ORDER if t not in ("cdl_dim_calendar", "cdl_fact_sales", "cdl_fact_returns")]


def _log_rows(run, step, table, total, inserted, updated) -> str:
    """One run-log row (without times) as SQL over scalar expressions."""
    return (f"SELECT '{run}' run_id, '{step}' step, '{table}' table_name, 'success' status, cast({total} as bigint) rows_affected, "
            f"cast({inserted} as bigint) rows_inserted, cast({updated} as bigint) rows_updated, "
            f"cast(({total}) - ({inserted}) - ({updated}) as bigint) rows_unchanged")


def _n(cte: str) -> str:
    return f"(SELECT count(*) FROM {cte})"


def _fresh(run: str, tables) -> str:
    """A first run: all rows are inserted."""
    return " UNION ALL ".join(_log_rows(run, "cdl", t, _n(t), _n(t), 0) for t in tables)


def _cdl_runs(first: str, second: str, idle: str | None = None) -> str:
    """The conformed layer's log of the two landings, and of a run that finds nothing new."""
    facts = ("cdl_fact_sales", "cdl_fact_returns")
    keys = {"cdl_fact_sales": "ORDER_ID, ORDER_LINE_NO", "cdl_fact_returns": "RETURN_ID, ORDER_LINE_NO"}
    days1, days2 = "(SELECT date_diff('day', lo1, hi1) + 1 FROM days)", "(SELECT date_diff('day', least(lo1, lo2), hi2) + 1 FROM days)"
    rows = [_fresh(first, _WHOLE), _log_rows(first, "cdl", "cdl_dim_calendar", days1, days1, 0)]
    rows += [_log_rows(first, "cdl", t, _n(f"{t}_day1"), _n(f"{t}_day1"), 0) for t in facts]
    rows += [_log_rows(second, "cdl", t, _n(t), 0, 0) for t in _WHOLE]
    rows.append(_log_rows(second, "cdl", "cdl_dim_calendar", days2, f"{days2} - {days1}", 0))
    rows += [_log_rows(second, "cdl", t, _n(f"{t}_day2"), f"{_n(f'{t}_day2')} - {_n(f'{t}_day1')}",
                       f"(SELECT count(*) FROM {t}_day1 JOIN {t}_late USING ({keys[t]}))") for t in facts]
    if idle:
        rows += [_log_rows(idle, "cdl", t, _n(f"{t}_day2") if t in facts else days2 if t == "cdl_dim_calendar" else _n(t), 0, 0) for t in R.CDL_ORDER]
    return " UNION ALL ".join(rows)


_CDL_RUNS = (*_WHOLE, "days", *(f"{t}_{d}" for t in ("cdl_fact_sales", "cdl_fact_returns") for d in ("day1", "day2", "late")))


def _log(df):
    return df.select("run_id", "step", "table_name", "status", *[F.col(c).cast("bigint").alias(c) for c in (
        "rows_affected", "rows_inserted", "rows_updated", "rows_unchanged")])


@register("r1_refresh_cdl", O.sql(_cdl_runs("first", "second", "third"), *_CDL_RUNS))
def r1(ctx):
    """R1 + R3: the eleven CDL MERGEs in order into a fresh warehouse, then the landing of a second day, then a
    run that finds nothing new and commits no version (else it fails); all run logs, with the rows inserted, updated and
    unchanged counted while writing."""
    root = _scratch(ctx, "warehouse")
    first, second = landings(ctx)
    log = R.refresh_cdl(ctx.spark, first, root, DEFAULT_RUN_TS, run_id="first")
    log += R.refresh_cdl(ctx.spark, second, root, DEFAULT_RUN_TS, run_id="second")
    seqs = R.cdl_seqs(ctx.spark, root)
    log += R.refresh_cdl(ctx.spark, second, root, DEFAULT_RUN_TS, run_id="third")
    if R.cdl_seqs(ctx.spark, root) != seqs:
        raise AssertionError("a run without new rows committed a version")
    R.append_run_log(ctx.spark, log, root)
    return _log(store.read_table(ctx.spark, os.path.join(root, "ops", "pipeline_runs")))


SUMMARY_KEYS = ["KEY_CALENDAR", "KEY_PRODUCT", "KEY_COMPANY", "KEY_CUSTOMER", "KEY_SELLING_METHOD", "CURRENCY_CODE"]
PROFIT_KEYS = ["KEY_PRODUCT", "KEY_COMPANY", "CURRENCY_CODE"]
DEMAND_KEYS = ["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD", "AS_OF_DATE", "FORECAST_DATE", "CURRENCY_CODE"]


def standard_marts(c, as_of):
    """The three marts over conformed tables ``c``, each following its changes; ``as_of`` is a date."""
    from ..plans import marts as M
    follows = M.incremental_marts(str(as_of))

    def mart(name, keys, cluster=()):
        follow = follows[name]
        return R.Mart(lambda: follow.rows(c, follow.params), keys, ["COMPANY_CODE"], list(cluster), follow=follow)

    return {"fact_sales_summary": mart("fact_sales_summary", SUMMARY_KEYS, ["KEY_COMPANY", "KEY_PRODUCT"]),
            "fact_product_profitability": mart("fact_product_profitability", PROFIT_KEYS),
            "fact_demand_vs_sales": mart("fact_demand_vs_sales", DEMAND_KEYS)}


def _on_day(cte: str, day: str) -> str:
    """The mart ``cte`` over the facts as they were on a day."""
    facts = ("cdl_fact_sales", "cdl_fact_returns")
    body, deps = O.CTE[cte]
    for t in facts:
        body = re.sub(rf"\b{t}\b", f"{t}_{day}", body)
    O.cte(f"{cte}_{day}", body, *[f"{d}_{day}" if d in facts else d for d in deps])
    return f"{cte}_{day}"


MART_CTES = (("fact_sales_summary", "b1_mart", SUMMARY_KEYS), ("fact_product_profitability", "b2_mart", PROFIT_KEYS),
             ("fact_demand_vs_sales", "b3_mart", DEMAND_KEYS))
_MART_DAYS = [_on_day(cte, day) for _, cte, _ in MART_CTES for day in ("day1", "day2")]


def _mart_runs(first: str, second: str, idle: str | None = None) -> str:
    """The marts' log of the two landings: a group is updated where any of its columns differs between the days."""
    rows = []
    for name, cte, keys in MART_CTES:
        k = ", ".join(keys)
        n1, n2 = (f"(SELECT count(*) FROM (SELECT DISTINCT {k} FROM {cte}_{d}) x)" for d in ("day1", "day2"))
        new = f"(SELECT count(*) FROM (SELECT {k} FROM {cte}_day2 EXCEPT SELECT {k} FROM {cte}_day1) x)"
        other = f"(SELECT count(*) FROM (SELECT * FROM {cte}_day2 EXCEPT SELECT * FROM {cte}_day1) x)"
        rows += [_log_rows(first, "bl", name, n1, n1, 0), _log_rows(second, "bl", name, n2, new, f"{other} - {new}")]
        rows += [_log_rows(idle, "bl", name, n2, 0, 0)] if idle else []
    return " UNION ALL ".join(rows)


def as_of_day(ctx):
    """The latest order date, as a value: it is kept with the marts' state."""
    from ..sources.testdata import read_table
    return read_table(ctx.spark, ctx.sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]


@register("r2_refresh_bl", O.sql(_mart_runs("bl", "bl2", "bl3") + " UNION ALL SELECT 'bl', 'bl', 'broken_mart', 'failed', 0, 0, 0, 0",
                                 *_MART_DAYS))
def r2(ctx):
    """R2 + R3: after the first landing every mart is built from the *written* conformed tables, given its
    ADMIN block and merged into its table; a failing mart is logged and the others still run. After the second only
    the groups that its changes touch are recomputed; a third refresh finds nothing to do."""
    root, spark = _scratch(ctx, "warehouse"), ctx.spark
    as_of = as_of_day(ctx)

    def broken():
        raise RuntimeError("mart definition refers to a missing column")

    log = []
    for run, raw in zip(("bl", "bl2"), landings(ctx)):
        R.refresh_cdl(spark, raw, root, DEFAULT_RUN_TS, run_id=run)
        marts = standard_marts(R.written_cdl(spark, root), as_of)
        log += R.refresh_bl(spark, marts | ({"broken_mart": R.Mart(broken, ["x"])} if run == "bl" else {}), root, DEFAULT_RUN_TS, run_id=run)
    log += R.refresh_bl(spark, marts, root, DEFAULT_RUN_TS, run_id="bl3")
    return _log(R.log_frame(spark, log))


@register("r6_stream_upsert", O.sql(f"SELECT {O.render(S.CDL_FACT_SALES)} FROM m1_merged", "m1_merged"))
def r6(ctx):
    """RAW order-line files arrive in two overlapping drops; after each the stream (availableNow)
    stages what is new and merges it into the written sales fact: the second updates and inserts. Equals
    the batch merge of the two loads (m1)."""
    from ..sources.testdata import raw_order_line
    from .upserts import CUT, RUN2
    base = _scratch(ctx, "stream")
    src, table = os.path.join(base, "incoming"), os.path.join(base, "cdl_fact_sales")
    ol = raw_order_line(ctx.spark, ctx.sf_dir, by_order_id=False)  # r6's rows depend on how the lines lie where columns are NULL (F8)
    day = F.col("TRANSACTION_DATE")
    drops = ((ol.filter(day < F.lit(CUT).cast("date")), DEFAULT_RUN_TS), (ol.filter(day >= F.lit("1996-07-01").cast("date")), RUN2))
    for i, (rows, run_ts) in enumerate(drops):
        store.write_jsonl(rows, os.path.join(src, f"drop{i}"))
        out = stream_upsert(ctx.spark, os.path.join(src, "*"), S.RAW_ORDER_LINE, os.path.join(base, "staging"), table,
                            ["ORDER_ID", "ORDER_LINE_NO"], lambda new, old, ts=run_ts: build_fact_sales(new, old, ts),
                            checkpoint=os.path.join(base, "_checkpoint"))
    for folder in (src, os.path.join(base, "staging")):
        discard(ctx.spark, folder)  # the table holds what it took in
    return out


@register("r7_daily_refresh", O.sql(
    _cdl_runs("day1", "day2") + " UNION ALL " + _mart_runs("day1", "day2") + " UNION ALL " + " UNION ALL ".join(
        f"SELECT '{d}', 'dq', '{m}', 'success', 0, 0, 0, 0" for d in ("day1", "day2")
        for m in ("fact_sales_summary", "fact_product_profitability", "fact_demand_vs_sales")),
    *_CDL_RUNS, *_MART_DAYS))
def r7(ctx):
    """§3.3 daily refresh end to end, on two days: the RAW tables land as NDJSON files, are loaded with their
    declared schemas, conformed (R1), the marts' touched groups merged from the written conformed layer (R2),
    each mart checked by its DQ suite, everything logged. Returns the run logs without times."""
    base = _scratch(ctx, "daily")
    as_of, log = as_of_day(ctx), None
    for day, raw in zip(("day1", "day2"), landings(ctx)):
        landing = os.path.join(base, f"landing-{day}")
        for name in S.RAW:
            store.write_jsonl(raw[name], os.path.join(landing, name))
        done = R.daily_refresh(ctx.spark, R.read_landing(ctx.spark, landing), os.path.join(base, "warehouse"),
                               lambda c: standard_marts(c, as_of), DEFAULT_RUN_TS, day)
        discard(ctx.spark, landing)  # the log is made of values
        log = done if log is None else log.unionByName(done)
    return _log(log)
