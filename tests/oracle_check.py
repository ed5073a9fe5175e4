"""Run every registered query on Spark and its oracle SQL on DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts; exits non-zero on any failure.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if hasattr(v, "item"):
        return canon(v.item())
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in records)


def duck_views(con, sf_dir):
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")


def main(argv):
    import duckdb
    from strata.session import build_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    # this harness collects every result into Python: give the driver room for sf0.1-sized results
    spark = build_session("local[8]", 8, extra={"spark.driver.memory": "12g", "spark.driver.maxResultSize": "4g"})
    qs, orc = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    duck_views(con, sf_dir)
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR    {name}: spark {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in orc:
            print(f"ROWS     {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(orc[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR    {name}: duckdb {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(cols) == sorted(dcols)
        a, b = rows_of(cols, srows), rows_of(dcols, drows)
        if same_cols and a == b:
            print(f"OK       {name}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"MISMATCH {name}: cols_equal={same_cols} spark={len(a)} duck={len(b)}")
            if not same_cols:
                print("   spark cols", sorted(cols), "\n   duck cols ", sorted(dcols))
            else:
                sa, sb = set(a), set(b)
                print("   spark-only", list(sa - sb)[:2], "\n   duck-only ", list(sb - sa)[:2])
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
