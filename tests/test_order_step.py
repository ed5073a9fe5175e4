"""The steps that every query over the order lines shares: what is shuffled, and that cheaper expressions give the same values."""

import decimal

import __spark_entry__ as E
from pyspark.sql import functions as F

from strata.functions.keys import fingerprint64
from strata.sources import testdata as D

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_lines_are_ranked_where_their_order_lies(spark):
    plan = _plan(E.queries()["b1_fact_sales_summary"](spark, SF))
    moved = [x for x in plan if "Exchange hashpartitioning(" in x]
    assert any("ORDER_ID#" in x for x in moved)
    assert not any("ORDER_LINE_NO#" in x for x in moved)  # W1 takes the rows as the join leaves them
    assert sum("KEY_CALENDAR#" in x for x in moved) == 1  # distinct orders are found per order, then shuffled once by the grain


def test_lines_by_order_id_are_the_same_rows(spark):
    cols = ["l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "o_orderdate", "c_custkey", "n_regionkey", "p_size"]
    rows = [sorted(map(str, D.order_lines_joined(spark, SF, by_order_id=by).select(*cols).collect())) for by in (False, True)]
    assert rows[0] == rows[1] and rows[0]


def test_codes_equal_the_format_at_every_width(spark):
    keys = [None, 0, 7, 99, 100, 10 ** 9 - 1, 10 ** 9, 2 ** 62, -1, -5]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for width in (2, 9):
        for got, want in df.select(D._code("C", F.col("k"), width), F.format_string(f"C%0{width}d", "k")).collect():
            assert got == want


def test_fingerprints_and_cents_equal_the_decimal_formulas(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("s"))
    old = (F.conv(F.substring(F.md5("s"), 1, 16), 16, 10).cast("decimal(20,0)") - F.lit(decimal.Decimal(2 ** 63))).cast("bigint")
    assert df.filter(~fingerprint64("s").eqNullSafe(old)).isEmpty()
    assert spark.sql("SELECT conv('8000000000000000', 16, -10), conv('ffffffffffffffff', 16, -10), conv('7fffffffffffffff', 16, -10)").first()[:] == (
        str(-2 ** 63), "-1", str(2 ** 63 - 1))
    cents = spark.createDataFrame([(c,) for c in (None, 0, 1, -1, 199, -250, 10 ** 18 - 1, -(10 ** 18 - 1))], "c long")
    old = (F.col("c").cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)").cast(D.NUMERIC)
    now = D._cents_to_decimal(F.col("c"))
    assert cents.filter(~now.eqNullSafe(old)).isEmpty() and cents.select(now.alias("x")).schema["x"].dataType == D.NUMERIC


def test_written_tables_are_compressed_with_zstd(spark, tmp_path):
    from strata.session import frozen
    from strata.sources import store
    store.full_refresh(spark.range(10).toDF("id"), str(tmp_path / "t"))
    files = [*(tmp_path / "t").rglob("*.parquet")] + frozen(spark.range(10).toDF("id"), "ids").inputFiles()
    assert files and all(str(f).endswith(".zstd.parquet") for f in files)
