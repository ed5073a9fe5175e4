"""Every registered query against its DuckDB oracle on the smallest test tables (sf0.001),
plus the smoke contract of ``__spark_entry__``."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from strata.registry import ORACLE, QUERIES, load_all
from tests.oracle_check import duck_views, rows_of

SF = "/root/testdata/sf0.001"
load_all()  # the registry's own queries; the training-data operators have tests of their own


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    duck_views(con, SF)
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_value" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 90


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, cur.fetchall())


_FAMILY = {"bigint": "int", "BIGINT": "int", "double": "float", "DOUBLE": "float", "string": "str",
           "VARCHAR": "str", "boolean": "bool", "BOOLEAN": "bool"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_output_types_agree(spark, duck, name):
    """Both engines return only bigint / double / string / boolean, column by column (no HUGEINT,
    INTEGER or DECIMAL on either side), so any value hash sees identical representations."""
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert _FAMILY.get(t) is not None and _FAMILY.get(t) == _FAMILY.get(dtypes[f.name]), (f.name, t, dtypes[f.name])
