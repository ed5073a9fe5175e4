"""Exact deduplication against brute force: nulls, empty and long texts, repeated rows, clashing columns, hot groups."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from strata.llm import common, exact_dedup
from tests.llm.test_llm_operators import DOCS, ODD, frame

UPPER, LOWER = common.UPPER, common.LOWER


def fold(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def brute(rows):
    """Multiset of (doc_id, keep_id, group_size, sha256), and per text the doc_id of its one kept row."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i)) for t, ids in groups.items()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    return Counter((i, best[fold(t)], len(groups[fold(t)]), sha[fold(t)]) for i, t in rows), {sha[t]: b for t, b in best.items()}


def many():
    rows = list(ODD)
    rows += [(i, "Ein Satz, Ä GROSS.") for i in range(100, 500)] + [(i, "ein satz, Ä gross.") for i in range(500, 600)]
    rows += [(i, "ein satz, ä gross.") for i in range(600, 610)]  # Ä and ä are different texts of one length
    rows += [(700 + i, "p" * exact_dedup.PREFIX + f"tail{i % 3}") for i in range(9)]  # one prefix, three texts
    rows += [(800 + i, f"only{i:04}") for i in range(50)]  # one length, all different
    rows += [(900, "long " * 60000), (901, "LONG " * 60000), (902, "long " * 59999 + "lonG "), (902, "long " * 60000)]
    return rows


def test_groups_against_brute_force(spark):
    rows = many()
    want, best = brute(rows)
    out = exact_dedup.exact_groups(frame(spark, rows).repartition(5), digests=True).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    kept = [(r["text_sha256"], r["doc_id"]) for r in out if r["kept"]]
    assert dict(kept) == best and len(kept) == len(best)
    assert {r["_raw"] for r in out} == {"a"}


def test_only_survivors_are_read_as_a_whole(spark):
    rows = many()
    out = exact_dedup.exact_groups(frame(spark, rows), keep=["doc_id"]).collect()
    assert {r["doc_id"] for r in out if r["text_sha256"] is None} >= set(range(800, 850))
    groups = Counter(fold(t) for _, t in rows)
    assert all(r["text_sha256"] for r in out if r["group_size"] > 1)
    assert sum(r["group_size"] > 1 for r in out) == sum(n for n in groups.values() if n > 1)


def test_one_of_each_keeps_rows_and_columns(spark):
    rows = many()
    docs = frame(spark, rows).withColumnsRenamed({"lang": "keep_id", "score": "kept"})
    out = exact_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(fold(r["text"]) for r in got) == Counter({fold(t) for _, t in rows})
    assert {(r["keep_id"], r["kept"]) for r in got} == {("en", "d")}
    assert exact_dedup.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_split_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(2000)] + [(None, 1)], "k string, v long")
    groups = left.filter("k is not null").groupBy("k").count()
    got = common.split_join(left, groups, "k", "count").collect()
    assert Counter((r["k"], r["v"], r["count"]) for r in got) == Counter([("hot", i, 3000) for i in range(3000)] + [(f"k{i}", i, 1) for i in range(2000)])
