"""Tokenizer alignment against brute force over byte positions, with the two public libraries as they are documented."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import alignment
from tests.llm.test_llm_operators import DOCS, ODD, SF, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_names():
    """The byte-level alphabet as published: three printable ranges, all others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(t, sp, text):
    names = byte_names()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    left = [bytes(names[c] for c in t.id_to_token(i)) for i in a]
    right = []
    for i in b:
        p = sp.id_to_piece(i)
        right.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode())
    return a, b, left, right


def one(t, sp, text):
    """(a ids, b ids, groups, links) by comparing every byte."""
    if not text:
        return [], [], [], []
    a, b, left, right = token_bytes(t, sp, text)
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return [], [], [], []
    owner = [[i for i, x in enumerate(side) for _ in x] for side in (left, right)]
    links = sorted(set(zip(*owner)))
    ends = [{sum(map(len, side[:i + 1])): i + 1 for i in range(len(side))} for side in (left, right)] if len(left) < 500 else [_ends(left), _ends(right)]
    groups = [(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]
    return a, b, groups, links


def _ends(side):
    out, n = {}, 0
    for i, x in enumerate(side):
        n += len(x)
        out[n] = i + 1
    return out


def written(a, b, groups):
    out, i, j = [], 0, 0
    for x, y in groups:
        out.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return hashlib.sha256(";".join(out).encode()).hexdigest() if out else ""


def brute(t, sp, rows):
    parts = [one(t, sp, text) for _, text in rows]
    count = Counter((a[x], b[y]) for a, b, _, links in parts for x, y in links)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, parts):
        counts = [count[a[x], b[y]] for x, y in links]
        out.append((i, len(a), len(b), len(groups), len(links), sum(c == top[b[y]] for c, (_, y) in zip(counts, links)), sum(counts), written(a, b, groups)))
    return out


def odd_texts(rng):
    voc = ["the", "naïve", "😀", "漢字", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "\u2581", "\n", "  ", "\u00a0", "e\u0301", "ﬁ", "don't", "12345", "\x00", "\ufeff", "ＡＢ", "\u200b", "zz" * 40]
    texts = ["".join(rng.choice(voc) + rng.choice(["", " ", " "]) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(150)]
    return [(1000 + i, x) for i, x in enumerate(texts)] + [(2000 + i, "copies of one text, often") for i in range(40)] + [(3000, "a" * 5000)]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block_chars", [300, None])
def test_against_brute_force(spark, libraries, block_chars):
    rows = [r for r in ODD if r[0] != 5] + odd_texts(random.Random(7))
    docs = frame(spark, rows).withColumnsRenamed({"lang": "n_a", "score": "block"}).repartition(3)
    out = alignment.aligned(docs, A, B, block_chars=block_chars)
    assert [c for c in out.columns if c in ("_raw", "_key", "n_words")] == ["_raw", "_key", "n_words"]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in out.collect()) == Counter(brute(*libraries, rows))


def test_documents_of_the_given_table(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.document_alignment(docs, A, B).select(*COLUMNS).collect()) == sorted(brute(*libraries, rows))


def test_details(spark, libraries):
    rows = odd_texts(random.Random(9))[:60] + [(5, None), (6, "")]
    for r in alignment.aligned(frame(spark, rows), A, B, detail=True, block_chars=500).collect():
        a, b, groups, links = one(*libraries, dict(rows)[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert [tuple(g) for g in r["groups"]] == groups and [tuple(x) for x in r["links"]] == links


def test_very_long_text_and_empty_table(spark):
    out = alignment.aligned(frame(spark, [(1, "x " * 30000), (2, "one long word" + "y" * 20000)]), A, B).collect()
    assert {r["doc_id"]: r["n_groups"] > 0 for r in out} == {1: True, 2: True}
    assert alignment.aligned(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_ranked_merges_are_the_library_s(libraries):
    own, texts = alignment.ByteLevel(A), [x for _, x in odd_texts(random.Random(11))]
    assert own.encode(texts) == [libraries[0].encode(x, add_special_tokens=False).ids for x in texts]
