"""Personal data: spans by pattern, and terms that disclose them by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each is a protected entity. How
much a term t discloses about an entity e is their pointwise mutual information over the corpus,
log2(N p(e|t) / n(e)), against the information that e itself holds, log2(N / n(e)): a term that
is met almost only beside e gives e away although e is masked. Terms beside an entity whose share
reaches ``REMOVE`` are removed, from ``GENERALISE`` on they are generalised.

All counts are distinct texts, so copies of a document change nothing. Every entity counts, however
rare: p(e|t) = (n(e,t) + PRIOR n(e)/N) / (n(t) + PRIOR) draws low counts towards the chance rate n(e)/N.

Everything is a DataFrame expression. Positions are code points: a text split by a pattern and the
pattern's matches interleave, so running lengths give every start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case, fresh, frozen, salted_join
from .line_dedup import document_key

#: The patterns of the base kinds. Possessive runs and the look-behinds keep each search linear: a
#: match can start only where a run starts or the previous match ended.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}"
#: Code points of context on each side of an entity (up to the next entity of its kind), and the texts at the chance rate that are
#: added to those in which a term is met.
CONTEXT, PRIOR = 80, 1
REMOVE, GENERALISE = 0.9, 0.6
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "remove": "", "generalise": "<TERM>"}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc, i):
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^(?:{IP_PART}\.){{3}}{IP_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


MATCH = "array<struct<start:int,end:int,value:string,left:string,left_cut:boolean,right:string,right_cut:boolean>>"
#: Matches that one inner fold places; the outer fold appends that many at once.
FOLD = 256


def matched(text: Column, pattern: str) -> Column:
    """Each match of ``pattern`` with the length of the gap before it and its contexts, which reach to
    the next match of the pattern at most."""
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                        F.slice(gaps, F.lit(2), F.size(gaps)).alias("rest"))
    return F.transform(F.filter(rows, lambda x: x["hit"].isNotNull()), lambda x: F.struct(
        F.length(x["gap"]).alias("skip"), x["hit"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"),
        (F.length(x["gap"]) > CONTEXT).alias("left_cut"), F.left(x["rest"], F.lit(CONTEXT)).alias("right"),
        (F.length(x["rest"]) > CONTEXT).alias("right_cut")))


def placed(rows: Column) -> Column:
    """MATCH rows of ``matched`` rows: running lengths give each start. ``rows`` must be a plain column."""
    empty = F.array().cast(MATCH)

    def one(acc, x):
        lo = acc["at"] + x["skip"]
        hi = lo + F.length(x["value"])
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(
            lo.alias("start"), hi.alias("end"), *[x[c].alias(c) for c in ("value", "left", "left_cut", "right", "right_cut")]))).alias("out"))

    def some(acc, i):
        return F.aggregate(F.slice(rows, i * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), empty.alias("out")), one,
                           lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / FOLD).cast("int"))
    return F.when(F.size(rows) > 0, F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), some, lambda a: a["out"])).otherwise(empty)


def _accepts(kind: str):
    return lambda m: accepted(kind, m["value"])


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` plus a MATCH array per base kind, named as the kind; null text: empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({kind: matched(text, pattern) for kind, pattern in KINDS.items()})
    out = out.withColumns({kind: placed(F.col(kind)) for kind in KINDS})
    return out.withColumns({kind: F.filter(kind, _accepts(kind)) for kind in KINDS})


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), fold_case(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", ""))


def text_key() -> Column:
    """128 bits that name a text; null is the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


def profiles(docs: DataFrame) -> DataFrame:
    """Per document: key d, key of its text h, doc_id, the base arrays, and ``near``: each entity with its contexts."""
    base = with_base_spans(docs.select("doc_id", "text")).withColumn("d", document_key(docs)).withColumn("h", text_key())

    def context(kind: str):
        return lambda m: F.struct(_entity(kind, m["value"]).alias("entity"), m["start"].alias("start"), m["end"].alias("end"),
                                  *[m[c].alias(c) for c in ("left", "left_cut", "right", "right_cut")])

    near = [F.transform(F.col(kind), context(kind)) for kind in KINDS]
    return base.select("d", "h", "doc_id", *[F.transform(k, lambda m: F.struct(m["start"], m["end"])).alias(k) for k in KINDS],
                       F.concat(*near).alias("near"))


def _whole_words(words: str, at: Column, text: str, cut_left: Column, cut_right: Column) -> Column:
    """(term, start, end) of the words of a context that its edges do not cut."""
    whole = F.filter(words, lambda w: ~((w["start"] == 0) & cut_left) & ~((w["end"] == F.length(text)) & cut_right))
    return F.transform(whole, lambda w: F.struct(F.lower(w["value"]).alias("term"), (w["start"] + at).alias("start"), (w["end"] + at).alias("end")))


def text_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, nt: the number of distinct texts that hold it, for each of ``terms``, repeated or not.

    One grouping counts the words of the texts and marks those asked for: a join with the terms would hand on a
    row per word and text, which Spark moves below the count.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    words = F.array_distinct(F.transform(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+")), F.lower))
    words = texts.select(F.explode(words).alias("term"), F.lit(1).alias("n"))
    both = words.unionByName(terms.select("term", F.lit(0).alias("n")))
    return both.groupBy("term").agg(F.sum("n").alias("nt"), F.min("n").alias("least")).filter("least = 0").select("term", "nt")


def shares(pairs: DataFrame, total: int) -> DataFrame:
    """``pairs`` (ne, net, nt) with the share of the entity's information that the term discloses."""
    n, chance = F.lit(float(total)), F.col("ne") / F.lit(float(total))
    given = (F.col("net") + PRIOR * chance) / (F.col("nt") + PRIOR)
    return pairs.filter(F.col("ne") < total).withColumn("share", F.log2(given / chance) / F.log2(n / F.col("ne")))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(d, kind, start, end) of the terms beside an entity that disclose it."""
    total = found.select("h").distinct().count()
    near = found.select("d", "h", F.explode("near").alias("x")).select("d", "h", "x.*")
    entities = near.select("entity", "h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("ne"))
    near = near.withColumns({f"{x}_words": matched(F.col(x), WORD) for x in ("left", "right")})
    near = near.withColumns({f"{x}_words": placed(F.col(f"{x}_words")) for x in ("left", "right")})
    terms = F.concat(_whole_words("left_words", F.col("start") - F.length("left"), "left", F.col("left_cut"), F.lit(False)),
                     _whole_words("right_words", F.col("end"), "right", F.lit(False), F.col("right_cut")))
    beside = frozen(near.select("d", "h", "entity", F.explode(terms).alias("t")).select("d", "h", "entity", "t.*"), "beside")
    pairs = beside.select("entity", "term", "h").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("net"))
    pairs = salted_join(pairs, entities, ["entity"], F.col("term"))
    # only the counts of terms beside entities are repeated for the salts
    pairs = salted_join(pairs, text_counts(docs, beside), ["term"], F.col("entity"), "left")
    # a word that touches an entity is part of a longer one to the split: it is in the texts where it was met at least
    pairs = pairs.withColumn("nt", F.greatest("nt", "net"))
    flagged = (shares(pairs, total).filter(F.col("share") >= GENERALISE)
               .select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind")))
    return salted_join(beside, flagged, ["entity", "term"], F.col("d")).select("d", "kind", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """d, doc_id, one sorted array of (start, end) per base kind, and ``extra``: sorted (start, end,
    kind) of disclosing terms outside the base spans; ``remove`` wins over ``generalise``.

    A null text is empty. Rows equal in doc_id and text are one document to the spans and
    get the same result; documents of equal text count once as evidence. Patterns match in whole
    texts; a kind's spans do not overlap each other, spans of different kinds may. Other columns are
    ignored, whatever their names.
    """
    found = frozen(profiles(docs), "pii")
    spans = disclosing_terms(docs.select("text"), found).distinct()
    extra = spans.groupBy("d").agg(F.collect_list(F.struct("start", "end", "kind")).alias("extra"))
    out = found.drop("near", "h").join(extra, "d", "left")
    out = out.withColumn("all", F.concat(*KINDS))
    free = F.filter(F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")),
                    lambda x: ~F.exists(F.col("all"), lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    out = out.withColumn("extra", free)
    # of the two kinds of one span the later in the alphabet stays
    best = F.filter("extra", lambda x: ~F.exists(F.col("extra"), lambda y: (x["start"] == y["start"]) & (y["kind"] > x["kind"])))
    return out.withColumn("extra", F.array_sort(best)).drop("all")


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))


def document_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, the digest of the base spans and all spans of every document."""
    out = personal_data(docs)
    base = F.concat(*[_written(k, F.col(k)) for k in KINDS])
    extra = [_written(k, F.expr(f"filter(extra, x -> x.kind = '{k}')")) for k in ("generalise", "remove")]
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                      F.array_join(F.concat(base, *extra), ",").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts masked: base spans become their kind, disclosing terms go or become <TERM>.

    Where spans of different kinds overlap, the earlier start wins, then the kind listed first. Null
    texts stay null; all other columns pass through, repeated rows included.
    """
    d, all_, done = (fresh(docs, x) for x in ("d", "spans", "masked"))
    rank = {k: i for i, k in enumerate(MASKS)}
    parts = [F.expr(f"transform({k}, m -> named_struct('start', m.start, 'rank', {rank[k]}, 'end', m.end))") for k in KINDS]
    parts += [F.expr(f"transform(filter(extra, m -> m.kind = '{k}'), m -> named_struct('start', m.start, 'rank', {rank[k]}, 'end', m.end))")
              for k in ("generalise", "remove")]
    spans = F.array_sort(F.concat(*parts))
    found = personal_data(docs).select(F.col("d").alias(d), spans.alias(all_)).dropDuplicates([d])
    joined = docs.withColumn(d, document_key(docs)).join(found, d, "left")
    text, masks = F.col("text"), F.array(*[F.lit(m) for m in MASKS.values()])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(masks, s["rank"]))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    masked = F.aggregate(F.col(all_), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.withColumn(done, masked).drop("text", d, all_).withColumnRenamed(done, "text").select(*docs.columns)
