"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE (vocabulary file of the ``tokenizers`` library), B a sentencepiece model that
puts a space before the text; A therefore reads space + text. Tokens become byte ranges. Two tokens are
linked when their ranges overlap. ``merge_asof``, keyed by document, finds for each token start the other
side's token that covers it; two overlapping tokens differ in start or not, so the later start of the two is
covered by the other token, and the union of both directions is all overlaps. Where tokens of both sides end
together, a group ends.

Documents are tokenized in blocks of bounded size inside the tasks. A block hands on its distinct linked id
pairs with their counts, never its links: pairs are summed over the corpus, the corpus-wide count of each
pair goes back once to every block that holds it, and a block's documents add up their links from them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frozen

#: Characters of a block (one document at least), and of a piece of it that is aligned at a time.
BLOCK_CHARS, PIECE_CHARS = 4 << 20, 1 << 20
#: Fixed value: the pattern by which a byte-level pre-tokenizer splits text before the merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character → byte of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and not 0x7F <= b <= 0xA0 and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_pieces(path: str) -> tuple[dict[bytes, int], bool]:
    """(bytes → id without the added tokens, whether ids are ranked as the merges are) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, model = byte_alphabet(), spec["model"]
    added = {t["content"] for t in spec["added_tokens"]}
    pieces = {bytes(alphabet[c] for c in p): i for p, i in model["vocab"].items() if p not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    joined = [pieces.get(bytes(alphabet[c] for c in a + b)) for a, b in merges]
    split = spec["pre_tokenizer"] or {}
    plain = (spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not model.get("ignore_merges"))
    return pieces, plain and joined == list(range(256, 256 + len(merges))) and len(pieces) == 256 + len(merges)


class ByteLevel:
    """Ids and bytes of tokenizer A. Where the ids are ranked as the merges are, as in the public files, the
    merges run by rank in tiktoken; else the tokenizers library encodes."""

    def __init__(self, path: str):
        pieces, ranked = byte_level_pieces(path)
        self.bytes = {i: p for p, i in pieces.items()}
        if ranked:
            import tiktoken

            own = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=pieces, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Ids and bytes of tokenizer B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _table(of: dict[int, bytes], f, kind):
    import numpy as np

    out = np.zeros(max(of) + 1, kind) if kind is not object else np.full(max(of) + 1, b"", object)
    for i, b in of.items():
        out[i] = f(i, b)
    return out


class Aligner:
    """Token ids, groups and links of a list of texts."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np

        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.size = [_table(x.bytes, lambda i, b: len(b), np.int64) for x in (self.a, self.b)]
        # an id as text before a token of its group, and, further on, before the end of its side of the group
        self.written = [np.concatenate([_table(x.bytes, lambda i, b, e=e: str(i).encode() + e, object) for e in ends])
                        for x, ends in ((self.a, (b",", b"|")), (self.b, (b",", b";")))]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides per text; none where the text is null or empty or either side's bytes differ from space + text."""
        full = [" " + (t or "") for t in texts]
        out = ([], [])
        for t, s, a, b in zip(texts, full, self.a.encode(full), self.b.encode([t or "" for t in texts])):
            raw = s.encode()
            same = t and b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
            out[0].append(a if same else [])
            out[1].append(b if same else [])
        return out

    def align(self, texts: list[str | None]) -> dict:
        """Per text: token counts, groups, digest of the groups; over all texts: the links as token numbers."""
        import numpy as np
        import pandas as pd

        ids = self.tokens(texts)
        n = [np.array([len(x) for x in side], np.int64) for side in ids]
        flat = [np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in side]]) for side in ids]
        doc = [np.repeat(np.arange(len(texts)), k) for k in n]
        # both sides cover the same bytes, so that ends over all texts tell the document as well as the place in it
        end = [np.cumsum(size[x]) for size, x in zip(self.size, flat)]
        start = [e - size[x] for e, size, x in zip(end, self.size, flat)]
        sides = [pd.DataFrame({"at": s, "doc": d, k: np.arange(len(s))}) for s, d, k in zip(start, doc, "ab")]
        one, two = (pd.merge_asof(x, y.drop(columns="doc"), on="at") for x, y in (sides, sides[::-1]))
        if len(two):
            two = two[start[1] != start[0][two["a"].to_numpy(np.int64)]]  # equal starts are in ``one``
        links = [np.concatenate([one[k].to_numpy(np.int64), two[k].to_numpy(np.int64)]) for k in "ab"]
        link_doc = np.concatenate([one["doc"].to_numpy(np.int64), two["doc"].to_numpy(np.int64)])
        last = [self._closes(end[0], end[1]), self._closes(end[1], end[0])]
        return {"ids": flat, "n": n, "last": last, "links": links, "link_doc": link_doc,
                "n_groups": np.bincount(doc[0][last[0]], minlength=len(texts)),
                "digest": self._digests(flat, n, last, doc, len(texts))}

    @staticmethod
    def _closes(own, other):
        import numpy as np

        if not len(other):
            return np.zeros(len(own), bool)
        return other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own

    def _digests(self, flat, n, last, doc, docs: int) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` per text: tokens in the order group, side, place."""
        import numpy as np

        group = [np.cumsum(x) - x for x in last]  # number of groups closed before the token
        of_group = [np.bincount(g, minlength=int(last[0].sum())) for g in group]
        before = [np.cumsum(c) - c for c in of_group]
        text = np.empty(len(flat[0]) + len(flat[1]), object)
        k = np.arange(len(flat[0]))
        text[k + before[1][group[0]]] = self.written[0][flat[0] + last[0] * len(self.size[0])]
        k = np.arange(len(flat[1]))
        text[k + (before[0] + of_group[0])[group[1]]] = self.written[1][flat[1] + last[1] * len(self.size[1])]
        stop = np.cumsum(n[0] + n[1])
        return [hashlib.sha256(b"".join(text[j - m:j])[:-1]).hexdigest() if m else "" for j, m in zip(stop.tolist(), (n[0] + n[1]).tolist())]


def blocks_of(chars: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most ``most`` characters, or one longer text."""
    i = total = 0
    for j, c in enumerate(chars):
        if j > i and total + c > most:
            yield i, j
            i, total = j, 0
        total += c
    if i < len(chars):
        yield i, len(chars)


def blocked(docs: DataFrame, a_path: str, b_path: str, detail: bool = False, block_chars: int | None = None) -> DataFrame:
    """``docs`` without text, with the counts and digest of each row, the row's block, and its distinct linked
    pairs as numbers ``of`` (ascending differences) and ``times`` within the block's ``pairs``.

    A block's first row holds its ``pairs`` (id A shifted by 32 bits plus id B) and how often each is linked, ``met``.
    """
    names = {"block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "of", "times", "pairs", "met"}
    more = "a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int>>, links array<struct<a:int,b:int>>" if detail else ""
    new = docs.sparkSession.createDataFrame([], "block string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                            "of binary, times binary, pairs array<long>, met array<long>" + (", " + more if detail else "")).schema
    kept = [f for f in docs.schema.fields if f.name not in {*new.names, "text"} | names]
    most = block_chars or BLOCK_CHARS

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        aligner, kinds = Aligner(a_path, b_path), [to_arrow_type(f.dataType) for f in new.fields]
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            for i, j in blocks_of([len(t or "") for t in texts], most):
                rows, codes, where = [], [], []
                for p, q in blocks_of([len(t or "") for t in texts[i:j]], PIECE_CHARS):
                    part = aligner.align(texts[i + p:i + q])
                    (la, lb), n = part["links"], part["n"]
                    code = part["ids"][0][la] << 32 | part["ids"][1][lb]
                    n_links = np.bincount(part["link_doc"], minlength=q - p)
                    rows += zip(n[0].tolist(), n[1].tolist(), part["n_groups"].tolist(), n_links.tolist(), part["digest"],
                                *(_details(part, q - p) if detail else []))
                    codes.append(code)
                    where.append(part["link_doc"] + p)
                pairs, number = np.unique(np.concatenate(codes), return_inverse=True)
                met = np.bincount(number, minlength=len(pairs))
                # distinct (row, pair) with its count, in order
                cell, times = np.unique(np.concatenate(where) * max(len(pairs), 1) + number, return_counts=True)
                cut = np.searchsorted(cell, np.arange(j - i + 1) * max(len(pairs), 1))
                block = uuid.uuid4().hex
                out = []
                for k, r in enumerate(rows):
                    own = cell[cut[k]:cut[k + 1]] - k * max(len(pairs), 1)
                    first = (pairs, met) if k == 0 else (None, None)
                    out.append((block, *r[:5], np.diff(own, prepend=0).astype("<u4").tobytes(), times[cut[k]:cut[k + 1]].astype("<u4").tobytes(), *first, *r[5:]))
                mine = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[mine.column(mine.schema.get_field_index(f.name)) for f in kept],
                                                  *[pa.array(list(v), kind) for v, kind in zip(zip(*out), kinds, strict=True)]],
                                                 [*[f.name for f in kept], *new.names])

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, StructType(kept + new.fields))


def _details(part: dict, docs: int) -> list[list]:
    """Per text: ids of both sides, group ends and links as token numbers of the text."""
    import numpy as np

    n, out = part["n"], [[], [], [], []]
    base = [np.cumsum(x) - x for x in n]
    ends = [np.flatnonzero(x) for x in part["last"]]
    order = np.lexsort((part["links"][1], part["links"][0]))
    la, lb, ld = part["links"][0][order], part["links"][1][order], part["link_doc"][order]
    for k in range(docs):
        a0, b0 = base[0][k], base[1][k]
        a1, b1 = a0 + n[0][k], b0 + n[1][k]
        ea, eb = (e[(e >= lo) & (e < hi)] - lo + 1 for e, lo, hi in ((ends[0], a0, a1), (ends[1], b0, b1)))
        own = slice(*np.searchsorted(ld, [k, k + 1]))
        out[0].append(part["ids"][0][a0:a1].tolist())
        out[1].append(part["ids"][1][b0:b1].tolist())
        out[2].append([{"a_end": int(x), "b_end": int(y)} for x, y in zip(ea, eb)])
        out[3].append([{"a": int(x), "b": int(y)} for x, y in zip(la[own] - a0, lb[own] - b0)])
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): corpus-wide links of each id pair, and whether no pair of its B id has more.

    The largest count per B id is one row per id of B's vocabulary, which bounds the side that is broadcast.
    """
    met = rows.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "met")).alias("p")).select("p.pairs", "p.met")
    total = frozen(met.groupBy(F.col("pairs").alias("pair")).agg(F.sum("met").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = total.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return total.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, detail: bool = False, block_chars: int | None = None) -> DataFrame:
    """``docs`` (without text) with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` and
    ``count_sum``; with ``detail`` also the ids of both sides, the groups' ends and the links.

    n_best counts the links whose pair is linked corpus-wide as often as any pair of its B id; count_sum adds the
    corpus-wide counts over the links. Null and empty texts, and texts that either side does not
    reproduce byte by byte, have no tokens: zeros and an empty digest. Rows count each on its own, repeated ones
    too. An empty table gives no rows. Columns of ``docs`` named like the new ones are replaced.
    """
    docs = docs.drop("n_best", "count_sum")
    rows = frozen(blocked(docs, a_path, b_path, detail, block_chars), "aligned", compression="zstd")
    held = (rows.filter("pairs is not null").select("block", F.posexplode("pairs").alias("k", "pair"))
            .join(pair_counts(rows), "pair").select(F.col("block").alias("of_block"), "k", "count", "best"))
    back = rows.drop("pairs", "met")
    kept = [f for f in back.schema.fields if f.name not in ("block", "of", "times")]
    new = docs.sparkSession.createDataFrame([], "n_best long, count_sum long").schema

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        k = right.column("k").to_numpy()
        count, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        count[k], best[k] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for o, t in zip(left.column("of").to_pylist(), left.column("times").to_pylist()):
            own, times = np.cumsum(np.frombuffer(o, "<u4").astype(np.int64)), np.frombuffer(t, "<u4").astype(np.int64)
            n_best.append(int((best[own] * times).sum()))
            total.append(int((count[own] * times).sum()))
        out = left.select([f.name for f in kept])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    return back.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(run, StructType(kept + new.fields))


def document_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id with the counts and the digest of every document."""
    out = aligned(docs.select("doc_id", "text"), a_path, b_path)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
