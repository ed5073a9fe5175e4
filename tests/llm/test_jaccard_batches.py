"""The Jaccard join takes meetings a batch at a time."""

from __future__ import annotations

import numpy as np

from strata.llm import jaccard_join


def test_meetings_and_leaders_are_found_a_batch_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(t), int(c)) for t, c in zip(rng.integers(0, 60, 900), rng.integers(-40, 40, 900))})
    n = {c: int(rng.integers(5, 30)) for _, c in rows}
    rows = [(t, c, n[c], (t * 7 + c) % 4) for t, c in rows]
    prefixes = spark.createDataFrame(rows + rows[::3], "token long, class long, n int, pos int")
    met = jaccard_join._meetings(prefixes)
    size = {t: sum(r[0] == t for r in rows) for t, *_ in rows}
    assert sorted(map(tuple, met.collect())) == sorted((*r, size[r[0]]) for r in rows if size[r[0]] > 1)

    weight = {c: sum(size[t] for t, x, *_ in rows if x == c and size[t] > 1) for c in n}
    want, percent = set(), 70
    for t in size:
        left = sorted((r for r in rows if r[0] == t), key=lambda r: (-weight[r[1]], r[1]))
        while len(left) > 1:
            (_, a, na, pa_), rest, left = left[0], left[1:], []
            for r in rest:
                if 100 * min(na, r[2]) < percent * max(na, r[2]):
                    left.append(r)
                elif min(na - pa_, r[2] - r[3]) >= jaccard_join.needed(na, r[2], percent):
                    want.add((min(a, r[1]), max(a, r[1])))
    got = {(r["a"], r["b"]) for r in jaccard_join._leader_pairs(met, percent).collect()}
    assert want and got == want

    cut = [spark.createDataFrame(rows, "token long, class long, n int, pos int").toArrow().to_batches(max_chunksize=7)]
    whole = list(jaccard_join._whole_groups(cut[0], 1))
    assert len(whole) > 1 and all(x[0][-1] < y[0][0] for x, y in zip(whole, whole[1:])) and sum(len(x[0]) for x in whole) == len(rows)


def test_shingles_need_no_cache_of_words():
    got = jaccard_join.shingles(b"A b\tc D a B c d e", 3)
    assert len(got) == 5 and (np.diff(got.astype(object)) > 0).all()
    assert np.array_equal(got, jaccard_join.shingles(b"a b c d a b c d e", 3))
    assert len(jaccard_join.shingles(b"one two", 3)) == 1 and not len(jaccard_join.shingles(b" \t", 3)) and not len(jaccard_join.shingles(None, 3))
