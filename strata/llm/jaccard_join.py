"""N-gram Jaccard join over prefix trees.

Documents become sets of hashed word n-grams under one global order, rare n-grams first (a sketch of
the corpus counts sets the order; any order gives the same links). Two sets as similar as the threshold
share an n-gram among the first few of each, so documents meet by those n-grams; size and position
bounds and a parity bitmap (whose Hamming distance never exceeds the sets' difference) discard most
meetings. The rest are verified exactly: the partners of a document form a trie of their ordered sets,
the document walks it once, partial overlaps are shared by all sets below a node, and subtrees that
cannot reach the needed overlap any more are pruned.

Equal sets are one class from the start. A first round links each meeting's members to a leader, which
joins large groups of near copies with a linear number of tests; a second round tests all meetings of
documents that are still in different components, so no link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, frozen
from .components import components

#: Cells of the count sketch that sets the order (one byte each when it travels to the tasks).
CELLS_BITS = 22
SKETCH_BLOCK = 1 << 12
#: Members of one meeting, or partners of one document, that a task takes at once.
BLOCK = 1024
#: Classes that a task remembers to have seen before it starts anew.
CACHE_CLASSES = 300_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text; of all its words together if they are fewer.

    Words are hashed anew each time: that is cheaper than to look them up among the many of a task.
    """
    import xxhash

    parts = text.translate(_LOWER).split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    k = min(k, len(h))
    n = len(h) - k + 1
    out, shifted = np.full(n, np.uint64(k)), np.empty(n, np.uint64)
    for i in range(k):  # out = _stir(out * _C1 + h[i:i + n]) in place
        out *= _C1
        out += h[i:i + n]
        out ^= np.right_shift(out, np.uint64(30), out=shifted)
        out *= _C2
        out ^= np.right_shift(out, np.uint64(31), out=shifted)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_class(s: np.ndarray) -> int:
    """64 bits that stand for a set: equal sets have equal classes."""
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of one to two bits per element (at least 256): each element flips one bit."""
    bits = 256 << (len(s) // 256).bit_length()
    flips = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def distance_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def needed(na: int, nb: int, percent: int) -> int:
    """Least intersection of sets of na and nb elements with 100 * intersection >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def ordered(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set under the global order: each element is (count level, 58 bits of its hash), ascending."""
    cell = (s >> np.uint64(64 - CELLS_BITS)).astype(np.int64)
    mixed = _stir(s)  # cell bits must not decide the order within a level
    return np.sort((level[cell].astype(np.uint64) << np.uint64(58)) | (mixed >> np.uint64(6)))


# --- prefix tree ------------------------------------------------------------------------------------

@dataclass
class Node:
    part: np.ndarray                                   #: elements on the edge into this node
    below: dict = field(default_factory=dict)          #: first element → child
    names: list = field(default_factory=list)          #: sets that end here
    longest: int = 0                                   #: most elements on a path below this node
    smallest: int = 1 << 62                            #: least size of a set in this subtree


class PrefixTree:
    """Ordered sets in a compressed trie."""

    def __init__(self, sets: list[tuple[object, np.ndarray]]):
        self.root = Node(np.empty(0, np.uint64))
        for name, s in sets:
            self._add(name, s)
        self._measure()

    def _add(self, name, s: np.ndarray) -> None:
        node, at = self.root, 0
        while True:
            node.smallest = min(node.smallest, len(s))
            if at == len(s):
                node.names.append(name)
                return
            child = node.below.get(first := int(s[at]))
            if child is None:
                node.below[first] = Node(s[at:], names=[name], smallest=len(s))
                return
            m = min(len(child.part), len(s) - at)
            differs = np.flatnonzero(child.part[:m] != s[at:at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(child.part):
                top = Node(child.part[:same], smallest=child.smallest)
                child.part = child.part[same:]
                top.below[int(child.part[0])] = child
                node.below[first] = child = top
            node, at = child, at + same

    def _measure(self) -> None:
        order, todo = [], [self.root]
        while todo:
            order.append(node := todo.pop())
            todo.extend(node.below.values())
        for node in reversed(order):
            node.longest = max((len(c.part) + c.longest for c in node.below.values()), default=0)

    def similar(self, x: np.ndarray, percent: int):
        """(name) of the sets whose similarity to ``x`` reaches the threshold."""
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            if len(node.part):
                at = np.searchsorted(x, node.part)
                at[at == len(x)] = 0
                overlap += int((x[at] == node.part).sum())
                rest = min(node.longest, len(x) - int(np.searchsorted(x, node.part[-1], "right")))
            else:
                rest = min(node.longest, len(x))
            if overlap + rest < needed(len(x), node.smallest, percent):
                continue
            # the sets that end here are equal, and the smallest of the subtree
            if node.names and overlap >= needed(len(x), node.smallest, percent):
                yield from node.names
            todo.extend((c, overlap) for c in node.below.values())


# --- the join -----------------------------------------------------------------------------------------

def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """One scan: a row per document (kind 0: doc_id, th, class, n, bitmap) and each task's count sketch
    in blocks (kind 1: block number as n, counts as bitmap)."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "doc_id", "th", "class", "n", "bitmap"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names)

        counts = np.zeros(1 << CELLS_BITS, np.uint32)
        for b in batches:
            rows = []
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = shingles(text.as_py(), k)
                np.add.at(counts, (s >> np.uint64(64 - CELLS_BITS)).astype(np.int64), np.uint32(1))
                rows.append((0, doc, th, set_class(s) if len(s) else None, len(s), bitmap(s) if len(s) else None))
            yield batch(rows)
        for i in range(0, len(counts), SKETCH_BLOCK):
            if (part := counts[i:i + SKETCH_BLOCK]).any():
                kind = np.uint8 if part.max() < 256 else np.uint32
                yield batch([(1, None, None, None, i // SKETCH_BLOCK, part.astype(kind).tobytes())])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.encode("text", "UTF-8"))
    return keyed.mapInArrow(run, "kind int, doc_id long, th long, class long, n long, bitmap binary")


def _levels(sketch: DataFrame) -> np.ndarray:
    """Twice the binary logarithm of each cell's count."""

    def add(table):
        import pyarrow as pa

        total = np.zeros(SKETCH_BLOCK, np.uint64)
        for x in table.column("bitmap"):
            raw = x.as_py()
            total += np.frombuffer(raw, np.uint8 if len(raw) == SKETCH_BLOCK else np.uint32)
        level = np.minimum(63, 2 * np.log2(total + 1.0)).astype(np.uint8)
        return pa.table({"block": pa.array([table.column("n")[0].as_py()], pa.int64()), "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(1 << CELLS_BITS, np.uint8)
    for r in sketch.groupBy("n").applyInArrow(add, "block long, level binary").collect():  # the sketch: a fixed size
        out[r["block"] * SKETCH_BLOCK:(r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


def _prefix_rows(docs: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """(token, class, n, pos) for the first elements of each set; equal sets once per task."""

    def run(batches):
        import pyarrow as pa

        seen = set()
        for b in batches:
            out: list = [[], [], [], []]
            for text in b.column(0):
                s = shingles(text.as_py(), k)
                if not len(s) or (c := set_class(s)) in seen:
                    continue
                if len(seen) >= CACHE_CLASSES:
                    seen.clear()
                seen.add(c)
                n = len(s)
                first = ordered(s, level)[:n - -(-percent * n // 100) + 1]
                out[0].append(first.view(np.int64))
                out[1].append(np.full(len(first), c, np.int64))
                out[2].append(np.full(len(first), n, np.int32))
                out[3].append(np.arange(len(first), dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["token", "class", "n", "pos"])

    return docs.select(F.encode("text", "UTF-8")).mapInArrow(run, "token long, class long, n int, pos int")


def _starts(cols) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; the first does."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = False
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _whole_groups(batches, keys: int):
    """Sorted batches as lists of column arrays in which no run of rows equal in the first ``keys`` columns is cut."""
    held = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        if last := int(np.flatnonzero(_starts(cols[:keys]))[-1]):
            yield [c[:last] for c in cols]
        held = [c[last:] for c in cols]
    if held:
        yield held


def _groups(batches, keys: int):
    """Runs of two rows or more equal in the first ``keys`` columns of sorted batches, as lists of column arrays."""
    for cols in _whole_groups(batches, keys):
        cuts = [*np.flatnonzero(_starts(cols[:keys])).tolist(), len(cols[0])]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                yield [c[lo:hi] for c in cols]


def _group_sizes(cols) -> np.ndarray:
    """For each row of sorted columns the number of rows equal to it."""
    cuts = np.append(np.flatnonzero(_starts(cols)), len(cols[0]))
    return np.repeat(np.diff(cuts), np.diff(cuts))


def _meetings(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose token two classes or more share, each once, with the number of those classes."""

    def run(batches):
        import pyarrow as pa

        for cols in _whole_groups(batches, 1):
            once = _starts(cols[:2])
            cols = [c[once] for c in cols]
            size = _group_sizes(cols[:1])
            shared = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in (*cols, size)], ["token", "class", "n", "pos", "size"])

    part = prefixes.repartition("token").sortWithinPartitions("token", "class")
    return part.mapInArrow(_pack(run), "token long, class long, n int, pos int, size long")


def _pack(run, rows: int = 50_000):
    """Joins the small record batches of ``run`` to larger ones."""

    def packed(batches):
        import pyarrow as pa

        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return packed


PAIRS = "a long, b long, na int, nb int"


def _possible(n, pos, i, j, percent) -> np.ndarray:
    """Which of the members ``j`` can be as similar to member ``i``, by their sizes and the places of the shared token."""
    need = -(-percent * (n[i].astype(np.int64) + n[j]) // (100 + percent))
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need


def _pair_batch(cls, n, i, j):
    import pyarrow as pa

    a, b = cls[i], cls[j]
    swap = a > b
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j]), pa.array(n[i]), pa.array(n[j])], ["a", "b", "na", "nb"])


def _leader_pairs(meetings: DataFrame, percent: int) -> DataFrame:
    """Each member of a meeting with its leader: the most central member of a size that can match.

    Central is who meets most others: in a group of near copies that is the text they were made from,
    whose rare n-grams they share, while their own changes are met by nobody.
    """
    weight = meetings.groupBy("class").agg(F.sum("size").alias("weight"))
    part = (meetings.join(weight, "class").select("token", "class", "n", "pos", "weight")
            .repartition("token").sortWithinPartitions("token", "class"))

    def run(batches):
        for token, cls, n, pos, weight in _whole_groups(batches, 1):  # all its meetings at once, a leader of each in turn
            left = np.lexsort((cls, -weight, token))
            while len(left := left[_group_sizes([token[left]]) > 1] if len(left) else left):
                first = _starts([token[left]])
                leader = left[np.flatnonzero(first)][np.cumsum(first) - 1]
                i, j = leader[~first], left[~first]
                fits = 100 * np.minimum(n[i], n[j]).astype(np.int64) >= percent * np.maximum(n[i], n[j])
                mine = fits.copy()
                mine[fits] = _possible(n, pos, i[fits], j[fits], percent)
                if mine.any():
                    yield _pair_batch(cls, n, i[mine], j[mine])
                left = j[~fits]

    return part.mapInArrow(_pack(run), PAIRS).distinct()


def _folded(maps: list[bytes]) -> dict[int, np.ndarray]:
    """By each size that occurs, all bitmaps of that size or larger folded to it (zero rows for smaller ones)."""
    sizes = np.array([len(m) for m in maps])
    out = {}
    for s in np.unique(sizes):
        rows = np.zeros((len(maps), s), np.uint8)
        for i, m in enumerate(maps):
            if len(m) >= s:
                rows[i] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, s), axis=0)
        out[int(s)] = rows
    return out


def _open_pairs(meetings: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The possible pairs of meetings whose members lie in different components, block by block: those
    that pass the bounds of size, place and bitmap. What fails them is never handed on."""
    named = (meetings.join(roots, meetings["class"] == roots["node"], "left")
             .select("token", "class", "n", "pos", F.coalesce("root", "class").alias("root")))
    sizes = (named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
             .filter("lo <> hi").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    open_ = named.join(sizes, "token").join(classes.select("class", "bitmap"), "class")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    open_ = (open_.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "class", "n", "pos", "root", "mine", "bitmap"))

    def run(batches):
        for _, x, y, cls, n, pos, root, mine, maps in _groups(batches, 3):
            order = np.lexsort((cls, n))
            cls, n, pos, root, mine = cls[order], n[order], pos[order], root[order], mine[order]
            folded, length = _folded([maps[i] for i in order]), [len(maps[i]) for i in order]
            for i in range(len(n) - 1):
                j = np.arange(i + 1, np.searchsorted(n, 100 * int(n[i]) // percent, "right"))
                j = j[root[j] != root[i]]
                if x[0] != y[0]:
                    j = j[mine[j] != mine[i]]
                j = j[_possible(n, pos, i, j, percent)]
                if len(j):
                    rows = folded[length[i]]  # larger sets have bitmaps of this size or larger
                    apart = np.bitwise_count(rows[j] ^ rows[i]).sum(1, dtype=np.int64)
                    total = n[j].astype(np.int64) + n[i]
                    j = j[apart <= total - 2 * -(-percent * total // (100 + percent))]
                if len(j):
                    yield _pair_batch(cls, n, np.full(len(j), i), j)

    part = open_.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "class")
    return part.mapInArrow(_pack(run), PAIRS).distinct()


def _near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow the needed overlap."""
    maps = classes.select("class", "bitmap")
    both = (pairs.join(maps.withColumnsRenamed({"class": "a", "bitmap": "ma"}), "a")
            .join(maps.withColumnsRenamed({"class": "b", "bitmap": "mb"}), "b").select("a", "b", "na", "nb", "ma", "mb"))

    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [distance_at_least(x.as_py(), y.as_py()) <= p + q - 2 * needed(p, q, percent)
                  for x, y, p, q in zip(b.column(4), b.column(5), na, nb)]
            import pyarrow as pa
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """The linked pairs (a, b): each a walks the trie of its partners, in blocks of bounded size."""
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = classes.join(ends, "class", "left_semi").select(F.col("rep.doc_id").alias("doc"), F.col("rep.th").alias("th"))

    def make_sets(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(set_class(s), ordered(s, level).tobytes()) for x in b.column(0) if len(s := shingles(x.as_py(), k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["class", "set"])

    # one document of each class: by its id too, so that copies of one text do not meet in a task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.encode("text", "UTF-8").alias("text"))
    one = texts.alias("t").join(wanted.alias("w"), (F.col("t.th") == F.col("w.th")) & F.col("t.doc").eqNullSafe(F.col("w.doc")), "left_semi")
    sets = one.select("text").mapInArrow(make_sets, "class long, set binary").dropDuplicates(["class"])
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    sets = frozen(sets, "sets")
    left = (many.join(sets, many["a"] == sets["class"])
            .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "set"))
    right = (pairs.join(many, "a").join(sets, F.col("b") == F.col("class"))
             .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "set"))

    def walk(table):
        import pyarrow as pa

        names = table.column("b").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        x = next(s for n, s in zip(names, sets) if n is None)
        tree = PrefixTree([(n, s) for n, s in zip(names, sets) if n is not None])
        found = list(tree.similar(x, percent))
        return pa.table({"a": pa.array([table.column("a")[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return left.unionByName(right).groupBy("a", "salt").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, class, component_id, first): a row per document.

    ``component_id`` is the smallest doc_id that links reach (null only if the whole component has no
    doc_id). ``first`` marks the rows of the component's one representative: smallest doc_id, then text
    hash (rows without an id last). Two documents link when 100 * intersection >= percent * union of
    their shingle sets. A text without words, or a null text, has an empty set: no links, itself its
    component. Rows equal in id and text are told apart by nothing and are all marked if one is.
    """
    rows = frozen(_profiles(docs, k), "profiles")
    level = _levels(rows.filter("kind = 1"))
    mine = rows.filter("kind = 0").drop("kind")
    classes = (mine.filter("n > 0").groupBy("class")
               .agg(F.min("th").alias("th"), F.first("bitmap").alias("bitmap"),
                    F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")))
    classes = frozen(classes, "classes")
    meetings = frozen(_meetings(_prefix_rows(docs, k, percent, level)), "meetings")

    def linked(pairs: DataFrame) -> DataFrame:
        return frozen(_verified(frozen(pairs, "pairs"), docs, classes, k, percent, level), "links")

    links = linked(_near_enough(_leader_pairs(meetings, percent), classes, percent))
    roots = components(links)
    links = links.unionByName(linked(_open_pairs(meetings, roots, classes, percent).select("a", "b")))
    roots = components(links)

    named = (classes.select("class", "rep").join(roots, F.col("class") == F.col("node"), "left")
             .select("class", "rep", F.coalesce("root", "class").alias("root")))
    reps = named.groupBy("root").agg(F.min("rep").alias("best"))
    of_class = named.join(reps, "root").select("class", "best")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("th").eqNullSafe(F.col("best.th"))
    empty = F.col("n") == 0
    return (mine.drop("bitmap").join(of_class, "class", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"), "class",
                    F.when(empty, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
                    (empty | same).alias("first")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document per component (smallest doc_id); texts without words all stay, and
    rows equal in id and text count once unless they have no words."""
    th, had, stays = fresh(docs, "th"), fresh(docs, "had"), fresh(docs, "stays")
    found = near_duplicates(docs.select("doc_id", "text"), k, percent)
    keep = found.filter("first and n_shingles > 0").select(F.col("doc_id").alias(had), F.col("th").alias(th)).distinct()
    keyed = docs.withColumn(th, F.xxhash64("text"))
    full = (keyed.join(keep.withColumnRenamed(th, stays), keyed["doc_id"].eqNullSafe(F.col(had)) & (keyed[th] == F.col(stays)), "left_semi")
            .dropDuplicates(["doc_id", th]))
    wordless = F.coalesce(F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit("")) == ""
    return full.select(*docs.columns).unionByName(docs.filter(wordless))


def document_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return near_duplicates(docs.select("doc_id", "text"), k, percent).select("doc_id", "n_shingles", "component_id")
