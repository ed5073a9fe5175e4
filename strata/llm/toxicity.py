"""Toxicity by a learned lexicon, fuzzy matching and context windows.

Learning: words (and word stems, for inflected languages) that toxic training documents hold far more
often than clean ones form a lexicon, chosen by log-likelihood ratio. Scoring: each distinct word of a
task runs once through a Levenshtein automaton intersected with the lexicon's trie, so that one
misspelling is caught without listing variants; each hit is weighed by a window of words around it,
which tells quotation (quotation marks, reporting words) from abuse (address, further hits); a logistic
model over the document's window scores gives the probability.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, frozen, with_python_columns

#: Bounds of what is learned from: labelled rows of each class, and terms of the lexicon.
LABELLED_PER_CLASS = 5000
LEXICON_TERMS = 4096
STEMS = range(3, 9)
#: Terms in fewer training documents cannot pass the test and are not counted as tests.
TESTED_FROM = 4
WINDOW = 8
CACHE_WORDS = 300_000
#: Words that are matched up to one edit: at least so long, and at least so much likelier in toxic documents.
FUZZY_LETTERS, FUZZY_ODDS = 5, 4.0
#: Marks and words that announce quoted speech, and words that address a reader.
OPENING, CLOSING = "\"“”«»„‟‹›", "\"“”«»‹›"
REPORTING = frozenset("said says say quote quoted quotes called calls word words term wrote writes slur insult sagte schrieb zitat "
                      "wort dit écrit mot citation dijo escribió palabra cita".split())
ADDRESS = frozenset("you your youre you're u ur yourself du dich dein sie ihr tu te toi vous ton tú usted vosotros".split())
FEATURES = 6
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(token: str) -> str:
    """A token in lower case without punctuation at its ends."""
    return _EDGE.sub("", token.lower())


def terms_of(words) -> set[str]:
    """Countable terms of a set of words: ``word$`` for the word itself, and its proper stems."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:n] for n in STEMS if n < len(w))
    return out


# --- automaton and trie -----------------------------------------------------------------------------

class LevenshteinAutomaton:
    """Accepts the strings within ``most`` edits of a word; a state is the row of edit distances, cut at ``most + 1``."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.most + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        row = [min(state[0] + 1, self.most + 1)]
        for i, c in enumerate(self.word):
            row.append(min(state[i] + (c != letter), state[i + 1] + 1, row[i] + 1, self.most + 1))
        return tuple(row)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.most

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.most


def trie(words) -> dict:
    """Nested dictionaries by letter; the empty key holds the word that ends at a node."""
    root: dict = {}
    for key, word in words:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(word)
    return root


def within_one_edit(root: dict, word: str) -> list[tuple[int, str]]:
    """(edits, word) of a trie's words within one edit of ``word``: automaton and trie walk together."""
    auto, found = LevenshteinAutomaton(word, 1), []
    todo = [(root, auto.start())]
    while todo:
        node, state = todo.pop()
        for c, child in node.items():
            if c == "":
                if auto.accepts(state):
                    found.extend((state[-1], w) for w in child)
            elif auto.alive(after := auto.step(state, c)):
                todo.append((child, after))
    return found


class Lexicon:
    """Terms with weights: whole words, matched up to one edit, and stems, matched exactly. A word behind
    a stem has the stem's weight as it is, and its own where it is misspelt.

    One edit leaves the first or the second half of a term as it was. So a word is looked up by exact
    halves, and only the other half walks a trie: of the terms' rests behind that first half, or, read
    backwards, of their beginnings before that second half.
    """

    def __init__(self, weights: dict[str, float]):
        self.words = {t[:-1]: w for t, w in weights.items() if t.endswith("$")}
        self.stems = {t: w for t, w in weights.items() if not t.endswith("$")}
        heads, tails = defaultdict(list), defaultdict(list)
        for w, odds in self.words.items():
            if len(w) >= FUZZY_LETTERS and odds >= FUZZY_ODDS:
                h = len(w) // 2
                heads[w[:h]].append((w[h:], w))
                tails[w[h:]].append((w[:h][::-1], w))
        self.heads, self.tails = ({k: (trie(v), {len(x) + d for x, _ in v for d in (-1, 0, 1)}) for k, v in part.items()}
                                  for part in (heads, tails))
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in heads}), sorted({len(t) for t in tails})

    def fuzzy(self, word: str) -> str | None:
        """The nearest term within one edit (ties: larger weight, then the smaller term)."""
        found = []
        for n in self.head_sizes:
            if (sub := self.heads.get(word[:n])) and len(word) - n in sub[1]:
                found += within_one_edit(sub[0], word[n:])
        for n in self.tail_sizes:
            if len(word) >= n and (sub := self.tails.get(word[len(word) - n:])) and len(word) - n in sub[1]:
                found += within_one_edit(sub[0], word[:len(word) - n][::-1])
        return min((d, -self.words[w], w) for d, w in found)[2] if found else None

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the term that a normal word stands for."""
        for n in STEMS:
            if n < len(word) and (w := self.stems.get(word[:n])) is not None:
                return w, True
        if (w := self.words.get(word)) is not None:
            return w, True
        if len(word) >= FUZZY_LETTERS - 1 and (term := self.fuzzy(word)):
            return self.words[term], False
        return None


class Matches(dict):
    """token → its match or None; emptied when full."""

    def __init__(self, lexicon: Lexicon, most: int = CACHE_WORDS):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
        out = self[token] = self.lexicon.match(normal(token))
        return out


def window_score(tokens: list[str], at: int) -> tuple[bool, bool]:
    """(quoted, addressed) of the hit at a token, from the window of words around it."""
    before, after = tokens[max(0, at - WINDOW):at], tokens[at + 1:at + 1 + WINDOW]
    tok = tokens[at]
    opened = tok[0] in OPENING or any(t[0] in OPENING and not (len(t) > 1 and t[-1] in CLOSING) for t in before)
    closed = tok.rstrip(".,;:!?")[-1:] in tuple(CLOSING) or any(
        t.rstrip(".,;:!?")[-1:] in tuple(CLOSING) and not (len(t) > 1 and t[0] in OPENING) for t in after)
    near = {normal(t) for t in (*before[-4:], *after[:4])}
    return opened and closed or bool(near & REPORTING), bool(near & ADDRESS)


def features(text: str | None, matches: Matches) -> list[float]:
    """Window scores of a text: abuse, quotation, misspelt, addressed, distinct terms, and the density of abuse."""
    tokens = text.split() if text else []
    hits = [(i, m) for i, t in enumerate(tokens) if (m := matches[t])]
    if not hits:
        return [0.0] * FEATURES
    abuse = quote = misspelt = address = 0.0
    for i, (weight, exact) in hits:
        quoted, addressed = window_score(tokens, i)
        if quoted:
            quote += weight
        elif exact:
            abuse += weight
        else:
            misspelt += weight
        address += addressed and not quoted
    kinds = len({normal(tokens[i]) for i, _ in hits})
    return [math.log1p(abuse), math.log1p(quote), math.log1p(misspelt), math.log1p(address), math.log1p(kinds),
            min(1.0, 10 * (abuse + misspelt) / (10 + len(tokens)))]


# --- learning ---------------------------------------------------------------------------------------

@dataclass
class Model:
    weights: dict[str, float]  #: lexicon: term → its log odds
    coef: list[float]          #: logistic model: intercept, then one per feature


def is_held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: checksum of the id divisible by five, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of at most ``per_class`` labelled rows of each class, taken in hash order, and how
    many labelled rows one taken row of each class stands for."""
    known = (labels.filter(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = taken[0].unionByName(taken[1])  # at most 2 * per_class rows: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic").dropDuplicates()  # copies teach once
    return rows, {c: n / min(n, per_class) for c, n in totals.items()}


def learn_lexicon(rows: DataFrame, most: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms whose document counts differ between the classes beyond chance (log-likelihood ratio over
    twice the log of the number of tested terms), and their log odds: at most ``most`` after stems have
    taken in what begins with them, and the whole words behind those stems, which are met misspelt too."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[toxic == 1].update(terms_of({normal(t) for t in set((text or "").split())}))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()),
                                              pa.array([seen[0][t] for t in names], pa.int64())], ["term", "t", "c"])

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = frozen(rows.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "terms")
    limit = 2 * math.log(max(2, counts.filter(F.col("t") + F.col("c") >= TESTED_FROM).count()))
    t, c = F.col("t"), F.col("c")
    share = (t + c) / F.lit(float(n1 + n0))

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0) + F.when(
            F.lit(of) > seen, (of - seen) * F.log((of - seen) / (of * (1 - share)))).otherwise(0.0)

    odds = F.log((t + 0.5) / (n1 + 1.0)) - F.log((c + 0.5) / (n0 + 1.0))
    ratio = 2 * (part(t, n1) + part(c, n0))
    best = (counts.filter(t + c < n1 + n0).select("term", "t", odds.alias("odds"), ratio.alias("g"))
            .filter((F.col("odds") > 2.0) & (F.col("g") > limit))
            .orderBy(F.desc("g"), F.desc(F.length("term")), "term").collect())  # bounded by the rows learned from
    chosen: dict[str, float] = {}
    behind: dict[str, float] = {}  # whole words that a chosen stem takes in
    covered: set[str] = set()  # stems of chosen terms
    for r in best:
        term = r["term"]
        bare = term.rstrip("$")
        if any(bare[:n] in chosen for n in STEMS if n < len(bare)) or bare in chosen:
            if term != bare:
                behind[term] = round(r["odds"], 6)
        elif term not in covered and len(chosen) < most:
            chosen[term] = round(r["odds"], 6)
            covered.update(bare[:n] for n in STEMS)
    return chosen | behind


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 50) -> list[float]:
    """Ridge-penalised weighted logistic regression by Newton's method; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    b, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - pen * b
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        move = np.linalg.solve(h, g)
        b = b + move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return [float(v) for v in b]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS) -> Model:
    """A model from the labelled rows that are not held out; without rows of both classes, one that knows only the share of toxic rows."""
    rows, stands = training_rows(docs, labels, per_class)
    rows = frozen(rows, "labelled")
    weights = learn_lexicon(rows)

    def make():
        matches = Matches(Lexicon(weights))
        return lambda b: [[features(t, matches) for t in b.column(0).to_pylist()]]

    seen = with_python_columns(rows, "f array<double>", make).select("f", "toxic").collect()  # bounded by per_class
    if not seen:
        return Model({}, [-30.0] + [0.0] * FEATURES)
    y = np.array([r["toxic"] == 1 for r in seen], float)
    if y.min() == y.max():
        return Model({}, [30.0 if y[0] else -30.0] + [0.0] * FEATURES)
    w = np.array([stands.get(r["toxic"], 1.0) for r in seen])
    return Model(weights, fit_logistic(np.array([r["f"] for r in seen]), y, w))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic; a column of that name is replaced.

    Every whole text is read; a null or empty text has no hits and gets the base probability. Nothing
    but the text matters, so repeated rows score alike.
    """
    raw = fresh(docs, "raw")

    def make():
        matches, coef = Matches(Lexicon(model.weights)), np.array(model.coef)

        def run(b):
            texts = b.column(b.schema.get_field_index("text"))
            f = np.array([features(t.as_py(), matches) for t in texts]).reshape(-1, FEATURES)
            z = np.clip(coef[0] + f @ coef[1:], -30, 30)
            return [(1 / (1 + np.exp(-z))).tolist()]
        return run

    return with_python_columns(docs.drop(column), f"{raw} double", make).withColumnRenamed(raw, column)


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    flag = fresh(docs, "toxicity")
    return score(docs, learn(docs, labels), flag).filter(F.col(flag) < 0.5).select(*docs.columns)
