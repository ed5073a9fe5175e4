"""The training-data operators against brute force, on small frames with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strata.llm import ann, bpe, components, decontaminate, html_text, jaccard_join, line_dedup, pii, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, _raw string, _key string, n_words string, score string"


def frame(spark, rows, schema=DOCS):
    """Rows of (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "en", "a", "b", "c", "d") for r in rows], schema)


def rng_text(rng, n, vocab=40):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


ODD = [(None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two"), (5, "x " * 30000), (6, "É 😀 a\u0085b\x1cc")]


# --- 3: sharding ------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p) == list(range(n))
    assert (sharding.unpermute(p, n, 5) == np.arange(n)).all()
    assert n < 1000 or abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_shards_are_even_and_gapless(spark):
    docs = frame(spark, ODD + [(i, f"t{i % 7}") for i in range(10, 200)])
    rows = sharding.shard_documents(docs, 40, 3).collect()
    assert len(rows) == len(ODD) + 190
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert all(got[k] >= v for k, v in want.items())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(docs.repartition(5), 40, 3).collect()))
    first = next(r for r in rows if r["doc_id"] == 199)
    assert sharding.row_at(first["shard"], first["slot"], len(rows), 40, 3) == len(rows) - 1  # the largest id has the last number


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_documents(frame(spark, []).limit(0)).count() == 0


# --- 10: line dedup ---------------------------------------------------------------------------------

def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for t in set(rows) for k in {key(x) for x in (t[1] or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "\n".join(rng.choice(["A b", " a B\t", "c", "", "É", "é", f"own {i}", "long " * 50]) for _ in range(rng.randrange(1, 150))))
                  for i in range(40)]
    got = line_dedup.dedup_lines(frame(spark, rows), 5)
    assert got.columns == [*[c.split()[0] for c in DOCS.split(", ")], "kept", "n_lines", "n_dropped"]
    have = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect())
    assert have == Counter(brute_lines(rows, 5))


def test_line_dedup_of_an_empty_table_and_of_a_text_that_goes(spark):
    assert line_dedup.dedup_lines(frame(spark, []).limit(0)).count() == 0
    got = line_dedup.dedup_lines(frame(spark, [(i, "same") for i in range(10)]), 10).collect()
    assert {(r["n_lines"], r["n_dropped"], r["kept"]) for r in got} == {(1, 1, "")}


# --- 4: decontamination -----------------------------------------------------------------------------

def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        v = words(t)
        k = min(window, len(v))
        for i in range(len(v) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j:j + k] == v[i:i + k]:
                    hit.update(range(j, j + k))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, pass_bytes):
    rng = random.Random(2)
    items = [(i, rng_text(rng, n, 4)) for i, n in enumerate([3, 4, 5, 6, 9, 1])] + [(7, None), (8, ""), (None, "w1 w2 w3"), (10, "W1-w2.w3 É"), (10, "zz"), (0, rng_text(rng, 7, 4))]
    docs = ODD + [(100 + i, rng_text(rng, rng.randrange(0, 60), 4).replace(" ", rng.choice([" ", "\n", "--"]))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(frame(spark, docs), bench, 4, pass_bytes)
    assert set(found.columns) >= {"doc_id", "text", "score", "n_words", "hit_spans", "items"}
    known = [x for x in items if x[0] is not None]
    got = Counter(tuple(r) for r in decontaminate.contamination(frame(spark, docs), bench, 4).collect())
    assert got == Counter((i, *brute_hits(t, known, 4)) for i, t in docs)
    left = Counter((r["doc_id"], r["text"]) for r in decontaminate.decontaminated(frame(spark, docs), bench, 4).collect())
    assert left == Counter(d for d in docs if not brute_hits(d[1], known, 4)[4])
    sums = found.select("n_words", F.aggregate("hit_spans", F.lit(0), lambda a, s: a + s[1] - s[0])).collect()
    assert Counter(map(tuple, sums)) == Counter(brute_hits(t, known, 4)[:2] for _, t in docs)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(frame(spark, ODD), none).collect())
    assert decontaminate.contamination(frame(spark, []).limit(0), none).count() == 0


# --- 5: n-gram Jaccard join -------------------------------------------------------------------------

def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        n = min(k, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    return [(r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


def near_copies(rng, n, bases=6):
    """Documents that differ from one of a few bases by single words, so that chains of links arise."""
    base = [rng_text(rng, rng.randrange(30, 90), 500).split() for _ in range(bases)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # so that meetings and partners are cut into blocks
    rng = random.Random(k)
    rows = ODD + [(100 + i, t) for i, t in enumerate(near_copies(rng, 150))]
    got = jaccard_join.document_components(frame(spark, rows), k, percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, k, percent))


def test_one_of_each_component_stays(spark):
    rng = random.Random(9)
    rows = ODD + [(100 + i, t) for i, t in enumerate(near_copies(rng, 60))]
    got = jaccard_join.one_of_each(frame(spark, rows), 5, 80).collect()
    parts = brute_components(rows, 5, 80)
    empty = Counter(r for r, p in zip(rows, parts) if p[1] == 0)
    full = [(r["doc_id"], r["text"]) for r in got if (r["text"] or "").strip(" \t\n\x0b\f\r")]
    assert Counter((r["doc_id"], r["text"]) for r in got if not (r["text"] or "").strip(" \t\n\x0b\f\r")) == empty
    assert len(full) == len(set(full))
    assert {i for i, _ in full if i is not None} == {p[2] for p in parts if p[1] and p[2] is not None}


def test_prefix_tree_finds_all_similar_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(120)]
    sets += [sets[0], sets[0][:3], sets[1][:-1]]
    tree = jaccard_join.PrefixTree(list(enumerate(sets)))
    for x in sets[::5]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(x, s)) >= 55 * len(np.union1d(x, s))}
        assert set(tree.similar(x, 55)) == want


def test_bitmap_bounds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)) for _ in range(2))
        b = np.union1d(a[::2], b[:5])
        assert jaccard_join.distance_at_least(jaccard_join.bitmap(a), jaccard_join.bitmap(b)) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_join.document_components(frame(spark, []).limit(0)).count() == 0


# --- 9: byte-level BPE --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, encoding):
    path, lib = encoding
    rows = ODD + [(20, "I'll don't 123 ١٢٣ 日本語 😀 %%%***"), (21, "abab" * 300), (22, "  lead  trail  \r\n\n x"), (23, "<|endoftext|>")]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    got = bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, cache_words=50).collect()
    want = Counter((i, struct.pack(f"<{len(x)}I", *x)) for i, t in rows for x in [lib.encode_ordinary(t or "")])
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_bpe_in_higher_order_functions(spark, encoding):
    path, lib = encoding
    rows = [(1, None), (2, ""), (3, "I'll don't 123 日本語 😀 %%%*** \u0085 x\x1c y"), (4, "hello  world hello"), (4, "hello  world hello"), (None, "a")]
    got = bpe.encode_native(frame(spark, rows), bpe.read_ranks(path), public_tokenizers.PATTERN).collect()
    want = Counter((i, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t in rows for x in [lib.encode_ordinary(t or "")])
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_long_merge_equals_short_merge(encoding):
    ranks = bpe.read_ranks(encoding[0])
    rng = random.Random(5)
    for n in (65, 200, 700):
        word = bytes(rng.choice(b"abtheing ") for _ in range(n)).replace(b" ", b"e")
        short = bpe.merge_long(word, ranks)
        assert short == [i for i in encoding[1]._encode_single_piece(word)]
    assert bpe.merge(b"abcabc", ranks) == bpe.merge_long(b"abcabc", ranks)


# --- 7: WARC ----------------------------------------------------------------------------------------

def test_warc_round_trip_with_chunks(spark, tmp_path):
    big = "x" * 5000 + "é\r\n\r\n"
    rows = [(1, "http://a", big), (2, None, None), (3, "u", ""), (4, "http://a b", "WARC/1.1\r\n\r\n"), (5, "", big), (None, "q", "z"),
            (7, "q", "dup"), (7, "q", "dup"), (6, "q", "dup")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, chunk_bytes=512, file_records=4)
    chunks = warc.read_chunks(spark, path)
    assert chunks.filter("chunk > 0").count() == 9 and chunks.filter("bytes is not null").count() == 10
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.assembled(chunks).collect())
    want = Counter()
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        last = max(same, default=None)
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        want[i, len((h or "").encode()), digest, "response" if i == last else "revisit", None if i == last else last] += 1
    assert got == want
    again = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert again == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_small_payloads_are_all_responses_and_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "dup"), (2, "u", "dup"), (3, "u", "y" * 900)], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.round_trip(pages, min_bytes=4).collect()} == {"response"}
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, chunk_bytes=300)
    chunks = warc.read_chunks(spark, path)
    with pytest.raises(Exception, match="out of place|no last chunk"):
        warc.assembled(chunks.filter("chunk <> 1")).collect()
    with pytest.raises(Exception, match="is damaged"):
        warc.assembled(chunks.withColumn("bytes", F.when(F.col("chunk") == 1, F.encode(F.lit("z" * 300), "UTF-8")).otherwise(F.col("bytes")))).collect()


# --- 2: nearest neighbours --------------------------------------------------------------------------

def brute_nearest(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    wide = max(map(len, good.values()))
    good = {i: np.pad(v, (0, wide - len(v))) for i, v in good.items()}
    out = {}
    for q in (i for i in good if i % every == 0):
        s = sorted(((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q))
        out[q] = [i for _, i in s[:k]]
    return out


def nearest_of(spark, rows, k, every, **more):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    out = defaultdict(list)
    for r in sorted(ann.nearest(df, lambda i: i % every == 0, k, **more).collect()):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append(r["vec_id"])
    return out


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [None] * 16), (1060, [float("nan")] * 16), (1080, []), (None, rows[0][1])]
    rows += [(2000 + i, rows[3][1]) for i in range(60)]  # copies of one vector, three of them queries
    got, want = nearest_of(spark, rows, 20, 20, block=64), brute_nearest(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = sum(len(set(got[q]) & set(v)) for q, v in want.items())
    assert hit >= 0.9 * 20 * len(want)
    assert all(got[q] == want[q] for q in want if q >= 2000)  # ties go to the smaller id


def test_nearest_with_few_rows_or_uneven_lengths(spark):
    few = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.5, 0.1, 7.0]), (20, [1.0, 0.0])]
    assert nearest_of(spark, few, 20, 20) == brute_nearest(few, 20, 20)
    assert nearest_of(spark, [(0, [1.0])], 20, 20) == {}
    assert nearest_of(spark, [(0, None)], 20, 20) == {}
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in np.float32(v * rng.uniform(0.2, 3))]) for i, v in enumerate(rng.normal(size=(500, 12)))]
    got, want = nearest_of(spark, rows, 10, 20), brute_nearest(rows, 10, 20)
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) >= 0.9 * 10 * len(want)


def test_registered_nearest_reaches_its_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    got, want = nearest_of(spark, rows, 20, 20), brute_nearest(rows, 20, 20)
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) >= 0.9 * 20 * len(want)


# --- 6: toxicity ------------------------------------------------------------------------------------

def test_automaton_and_trie_match_by_edit_distance():
    lex = toxicity.Lexicon({"idiot$": 5.0, "worthless$": 4.0, "bad$": 6.0, "common$": 3.0, "vequ": 2.5})
    assert lex.match("idiot") == (5.0, True)
    assert {w: lex.match(w) for w in ("idiit", "idot", "idioot", "1diot")} == dict.fromkeys(("idiit", "idot", "idioot", "1diot"), (5.0, False))
    assert lex.match("veqution") == (2.5, True)
    assert [lex.match(w) for w in ("bid", "idxxt", "patriot", "", "vequ", "wrthlss", "commom")] == [None] * 7
    near = {w for w in ("worthles", "wortless", "worthlesss", "xworthless", "worthiess", "orthless")}
    assert {w: lex.match(w) for w in near} == dict.fromkeys(near, (4.0, False))


def test_context_tells_quotation_from_abuse():
    m = toxicity.Matches(toxicity.Lexicon({"idiot$": 3.0}))
    abuse, quoted = toxicity.features("you are an idiot, go", m), toxicity.features('they shouted “such an idiot” at noon', m)
    assert abuse[0] > 0 and abuse[1] == 0 and abuse[3] > 0 and quoted[0] == 0 and quoted[1] > 0
    assert toxicity.features("he said idiot was spelt wrong", m)[1] > 0
    assert toxicity.features(None, m) == toxicity.features("", m) == toxicity.features("fine words", m) == [0.0] * toxicity.FEATURES


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "worthless", "scum"]
    rows, labels = [], []
    for i in range(600):
        w = rng_text(rng, 60, 300).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            word = rng.choice(bad)
            w[rng.randrange(60)] = word[:-1] + "x" if rng.random() < 0.1 else word
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.document_toxicity(frame(spark, rows + ODD[:4]), lab).collect()
    assert len(got) == 604
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    clean = toxicity.clean_documents(frame(spark, rows), lab)
    assert clean.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert clean.count() == sum(r["predicted"] == 0 for r in got) - 4


def test_words_behind_stems_are_met_misspelt_and_stems_share_no_bound(spark):
    rng = random.Random(14)
    families = [["grumbald", "grumbalds", "grumbalder"], ["vorqueno", "vorquenos", "vorquenoso"]]
    rows = [(f"{rng_text(rng, 20, 100)} {rng.choice(families[i % 2])}", 1) for i in range(400)]
    rows += [(rng_text(rng, 20, 100), 0) for _ in range(400)]
    weights = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), most=2)
    lex = toxicity.Lexicon(weights)
    assert len(lex.stems) == 2
    for w in sum(families, []):
        stem = next(s for s in lex.stems if w.startswith(s))
        assert lex.match(w) == (lex.stems[stem], True)
        assert lex.match(w[:2] + "x" + w[3:]) == (weights[w + "$"], False)


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.document_toxicity(frame(spark, ODD), none).collect())
    assert toxicity.document_toxicity(frame(spark, []).limit(0), none).count() == 0


# --- 8: personal data ---------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


PII_ODD = ["😀a@b.c+d@e.f-g 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 x", "9" * 40 + " a@b a..b@c.d.. 4111-1111-1111-1111-", "1" * 3000 + "a" * 3000,
           "+1 (555) 010-9999 +123 4567 +49 30 1234567890123456 0001.02.3.255", "a@b.c " * 600, "4111111111111111 4111111111111112 5500-0000-0000-0004 1"]


def test_pii_equals_brute_force(spark):
    rows = ODD + [(50 + i, t) for i, t in enumerate(PII_ODD)]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = pii.document_spans(frame(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        b = brute_spans(t)
        want[i, *[sum(x.startswith(k) for x in b) for k in PATTERNS], hashlib.sha256(",".join(b).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def test_disclosing_terms_are_found_and_masked(spark):
    rng = random.Random(10)
    rows = [(i, rng_text(rng, 30, 30)) for i in range(60)]
    rows += [(100 + i, f"{rng_text(rng, 8, 30)} w{i} Zanzibari mail joe@example.com w{i + 3} {rng_text(rng, 8, 30)}") for i in range(6)]
    got = {r["doc_id"]: r for r in pii.document_spans(frame(spark, rows)).collect()}
    text = dict(rows)
    for i in range(100, 106):
        spans = dict((s.split(":", 1)[1], s.split(":")[0]) for s in got[i]["spans"].split(","))
        at = text[i].index("Zanzibari")
        assert spans[f"{at}:{at + 9}"] == "remove"
    assert not any(got[i]["spans"] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, rows + [(7, None)])).collect() if r["text"]}
    assert all("Zanzibari" not in clean[i] and "joe@" not in clean[i] and "<EMAIL>" in clean[i] for i in range(100, 106))
    assert clean[5] == text[5]


def disclosed(docs, doc_id):
    got = {r["doc_id"]: r for r in pii.document_spans(docs).collect()}[doc_id]
    spans = [x.split(":") for x in got["spans"].split(",")]
    return {(kind, int(lo), int(hi)) for kind, lo, hi in spans if kind in ("remove", "generalise")}


def test_a_name_beside_an_address_met_once_is_disclosed(spark):
    rng = random.Random(12)
    rows = [(i, f"{rng_text(rng, 30, 30)} plainword") for i in range(100)]
    text = f"{rng_text(rng, 8, 30)} plainword Zanzibari mail <joe@example.com> plainword {rng_text(rng, 8, 30)}"
    got = disclosed(frame(spark, [*rows, (200, text), (201, "a second Rarename +1 555 010 9999 plainword")]), 200)
    at = text.index("Zanzibari")
    assert {(lo, hi) for _, lo, hi in got} >= {(at, at + 9)}
    assert not any(text[lo:hi] == "plainword" for _, lo, hi in got)


def test_copies_of_a_document_change_no_spans(spark):
    rng = random.Random(13)
    rows = [(i, f"{rng_text(rng, 30, 30)} only{i}") for i in range(60)]
    rows += [(100 + i, f"{rng_text(rng, 8, 30)} w{i} Zanzibari mail joe@example.com w{i + 3} {rng_text(rng, 8, 30)}") for i in range(4)]
    once = disclosed(frame(spark, rows), 101)
    again = disclosed(frame(spark, rows + [(1000 + i, rows[60][1]) for i in range(300)]), 101)
    at = rows[61][1].index("Zanzibari")
    assert any((lo, hi) == (at, at + 9) for _, lo, hi in once) and again == once


def test_pii_of_an_empty_table(spark):
    assert pii.document_spans(frame(spark, []).limit(0)).count() == 0


# --- 1: HTML extraction -------------------------------------------------------------------------------

def test_lines_and_structure():
    page = ("<!DOCTYPE html><head><title>t &amp; u</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav>"
            "<div class='ad'>Buy</div><!-- c --><article><header>h</header><h1>A&amp;B&nbsp;</h1><p>One <b>two<br>three<p>Four&#33; 5 < 6</p>"
            "<form>f</form><section class=comments><p>said</p></section></article><footer>&copy; me</footer>")
    lines = html_text.lines_of(page)
    assert [lines[i].text for i in html_text.candidates(lines)] == ["A&B", "One two three", "Four! 5 < 6"]
    assert html_text.lines_of(None) == html_text.lines_of("") == []
    assert [x.text for x in html_text.lines_of("plain & simple")] == ["plain & simple"]
    assert [x.text for x in html_text.lines_of("<p class=ad>gone<p>stays")] == ["gone", "stays"]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common_lines(a, b)
        assert got == sorted(set(got)) and len(got) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_shared_lines_go_and_copies_stay(spark):
    def page(body):
        return f"<html><body><div>Site name</div><div>Log in</div>{body}<div>All rights reserved</div></body></html>"

    rows = [(i, f"http://host/a/{i}?x=1", page(f"<div>Own text number {i} of this page.</div>")) for i in range(150)]
    rows += [(200, "http://other/1", "<p>alone on its host</p>"), (201, None, None), (202, None, ""), (203, "::", "<p>x")]
    rows += [(300 + i, f"https://copy/{i}", "<p>The same text on every page.</p>") for i in range(3)]
    rows += [(400 + i, f"https://art/{i}", f"<article><p>A sentence that both have.</p><p>Read more</p><p>Mine {i}.</p></article>") for i in range(2)]
    rows += [(5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "k", "t") for r in rows], "page_id long, url string, html string, _key string, text string")
    got = defaultdict(list)
    for r in html_text.extract(pages).collect():
        got[r["page_id"]].append(r["text"])
    assert all(set(got[i]) == {f"Own text number {i} of this page."} for i in range(150)) and len(got[5]) == 2
    assert [got[i][0] for i in (200, 201, 202, 203)] == ["alone on its host", "", "", "x"]
    assert all(got[300 + i] == ["The same text on every page."] for i in range(3))
    assert [got[400 + i] for i in range(2)] == [[f"A sentence that both have. Mine {i}."] for i in range(2)]
    assert html_text.page_texts(pages.limit(0)).count() == 0


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}


def test_a_teaser_in_an_article_is_not_the_page_and_article_boilerplate_goes(spark):
    body = "<p>Site name</p><div><p>The long body of page {0} in plain paragraphs.</p></div><article>Teaser {0}</article>"
    story = "<p>Site name</p><article><p>A story {0}, told at length and never twice: {0} {0}.</p><p>Please support our newsroom today.</p></article>"
    rows = [(i, f"http://plain/{i}", body.format(f"w{i}")) for i in range(4)]
    rows += [(10 + i, f"http://story/{i}", story.format(f"w{i}")) for i in range(4)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"The long body of page w{i} in plain paragraphs. Teaser w{i}" for i in range(4))
    assert all(got[10 + i] == f"A story w{i}, told at length and never twice: w{i} w{i}." for i in range(4))


def test_copies_are_one_page_and_short_pages_of_a_template_lose_it(spark):
    site = "<p>Site name</p><p>{}</p><p>All rights are reserved by us.</p>"
    rows = [(i, f"http://copies/a{i}", site.format("The text that five URLs have.")) for i in range(5)]
    rows += [(5, "http://copies/b", site.format("The text of another page."))]
    long = "<p>" + "Boilerplate of the site, many words of it. " * 20 + "</p>"
    rows += [(10 + i, f"http://template/{i}", f"{long}<p>Own text {i} of it.</p>{long}") for i in range(4)]
    # two near copies beside other pages keep their body
    body = "<p>Site name</p>" + "".join(f"<p>Sentence {j} of a body that two pages have.</p>" for j in range(20))
    rows += [(20 + i, f"http://near/{i}", body + f"<p>Copied by editor {i} this week.</p>") for i in range(2)]
    rows += [(22 + i, f"http://near/{2 + i}", f"<p>Site name</p><p>Quite another text, number {i}.</p>") for i in range(2)]
    got = texts_of(spark, rows)
    assert {got[i] for i in range(5)} == {"The text that five URLs have."} and got[5] == "The text of another page."
    assert all(got[10 + i] == f"Own text {i} of it." for i in range(4))
    assert all(got[i].count("of a body that two pages have.") == 20 for i in (20, 21)) and got[22] == "Quite another text, number 0."


def test_pages_of_the_given_table_keep_their_articles(spark):
    import html

    got = {r["page_id"]: r for r in html_text.page_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
