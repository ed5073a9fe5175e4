"""Texts that are not parsed at all have the types that parsing all of them gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.sources import store

ODD = ["", " ", "7", " 7 ", "+7", "-7", "7-", "7.", ".7", "7.5", "-7.5", "1e5", "1E-5", "1e+5", "e", "E5", "1e", "0x1F", "1_000", "1,000",
       "NaN", "Infinity", "7L", "7d", "1996-01-02", "1996-1-2", "+1996-01-02", "1996", "1996-01", "1996-01-02T03", "1996-01-02 03:04:05",
       "T12:34", "12:34", "today", "epoch", "ORD-1", "P-7", "٧", "\t7\n", "9" * 30, "99999999999999999999", "1996/01/02", "--7", "+-7", "7 7"]


def test_a_text_not_parsed_is_one_that_does_not_parse(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "v string")
    for name, kind in store.INFER_ORDER:
        wrong = df.filter(F.col("v").try_cast(kind).isNotNull() & F.col("v").rlike(store.NEVER[name])).collect()
        assert wrong == [], name
    texts = df.select(*[F.max(F.when(F.col("v") == x, F.col("v"))).alias(f"c{i}") for i, x in enumerate(ODD)])
    parsed = texts.select(*[F.array(*[F.col(c).try_cast(k).isNotNull() for _, k in store.INFER_ORDER]).alias(c) for c in texts.columns]).first()
    got = {r["column_name"]: r["inferred_type"] for r in store.infer_column_types(texts).collect()}
    names = [n for n, _ in store.INFER_ORDER]
    assert got == {c: next((n for n, ok in zip(names, parsed[c]) if ok), "STRING") for c in texts.columns}


def test_codes_and_dates_are_never_parsed_as_numbers(spark):
    for name in ("INT64", "NUMERIC"):
        for x in ("ORD-1", "1996-01-02"):
            assert spark.range(1).select(F.lit(x).rlike(store.NEVER[name])).first()[0]
    assert spark.range(1).select(F.lit("ORD-1").rlike(store.NEVER["DATE"])).first()[0]
