"""New columns of texts are computed in pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.llm import common


def test_new_columns_are_computed_in_pieces_of_bounded_bytes(spark):
    n, wide = 3000, 8 << 10
    docs = spark.range(0, n, 1, 1).select("id", F.repeat(F.lit("x"), wide).alias("text"))

    def make():
        return lambda b: [[b.nbytes] * b.num_rows, [len(t) for t in b.column(1).to_pylist()]]

    out = common.with_python_columns(docs, "held long, chars long", make)
    got = out.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d"), F.sum("chars").alias("c"), F.max("held").alias("held")).first()
    assert (got["n"], got["d"], got["c"]) == (n, n, n * wide)
    assert got["held"] <= common.PIECE_BYTES + wide
