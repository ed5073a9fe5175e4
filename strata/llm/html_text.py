"""Main text of web pages by differencing each page with its nearest neighbour by URL.

A page is cut into lines (the text of its blocks) with their place in the markup. What markup itself
declares as menus, adverts, forms, comments and the like is deleted whether shared or not; all other
lines are differenced. Pages of a host with equal lines are one page. Within a host these are ordered by
URL path, and the lines of a page are aligned by longest common subsequence with those of its two
nearest pages, the one that shares the longer path prefix first. Shared lines are the site's, not the
page's, and are deleted, with the limits that copies call for: a neighbour proves something only if
either page has text of its own beside the shared lines. One such neighbour is enough for lines outside
articles and for article lines that are no sentences, unless it shares nearly everything; then, and for
sentences in articles, it takes both. Neighbours that share half of an article are copies of it and leave
its sentences.

Pairing works on line hashes only. Pages travel only to join the lines to delete, and only if that list
is too large to broadcast.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, frozen, global_rows, salted_join, with_python_columns

#: Elements whose text is never part of a page's main text, and those whose content is not markup.
DROPPED = frozenset("nav header footer aside form menu dialog button select noscript template iframe svg math object audio video canvas "
                    "map fieldset head".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
MAIN = frozenset(["article", "main"])
CONTAINERS = frozenset("article main section div ul ol dl table tbody thead tfoot tr td th figure details body html center".split()) | DROPPED
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address figcaption caption summary".split())
#: Words in class, id or role that declare what an element is.
DECLARED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent gdpr notice banner popup modal newsletter subscribe share sharing social related recommended "
    "comment comments disqus footer header masthead widget toolbar pagination pager login signup contentinfo complementary search".split())
ARTICLE_PARTS = frozenset("article post entry content".split())
#: First parts of names that tell the state or layout of an element that holds more than what they name.
STATES = frozenset("has with no not is without js show hide".split())
#: Elements that hold the page or its article: their names tell themes and states, not what they are.
ROOTS = frozenset("html body main article".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SENTENCE_END = tuple(".!?…。！？;:\"”»)")
SENTENCE_WORDS = 5
#: A neighbour that shares this much of a page's text does not prove alone that it is the site's; nor do neighbours
#: that share this much of its article's text prove it of the article's sentences.
COPY_SHARE, ARTICLE_SHARE = 0.9, 0.5
BLOCK_ROWS = 64
#: Flags of a line.
IN_ARTICLE, SENTENCE = 1, 2


@dataclass
class Line:
    text: str
    main: bool      #: inside an article or main element
    declared: bool  #: inside an element that markup declares to be something else

    @property
    def sentence(self) -> bool:
        return self.text.endswith(SENTENCE_END) or self.text.count(" ") + 1 >= SENTENCE_WORDS


def _is_declared(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role") and tag not in ROOTS and any(map(_names_other, value.split())):
            return True
    return False


def _names_other(name: str) -> bool:
    """Whether one class, id or role names something beside the article: by its last part (``post-comments``, but
    ``entry-header`` holds the title), or by its first part (``ad-slot``) unless it ends as an article does."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if not parts or parts[0] in STATES:
        return False
    if parts[-1] in DECLARED:
        return not (parts[-1] == "header" and parts[0] in ARTICLE_PARTS)
    return parts[0] in DECLARED and parts[-1] not in ARTICLE_PARTS


def lines_of(page: str | None) -> list[Line]:
    """The non-empty lines of a page in order: one per block, character references decoded, white space made single spaces."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside main, inside a declared element
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Line(text, *(stack[-1][1:] if stack else (False, False))))

    at, page = 0, page or ""
    while m := TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] not in CONTAINERS:
                stack.pop()  # a declared inline element or paragraph ends where a block begins or ends
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    break
            continue
        declared = _is_declared(tag, m[3])
        if (tag in CONTAINERS or declared) and not m[3].rstrip().endswith("/") and tag not in ("br", "img", "input", "hr", "meta", "link"):
            flush()
            up = stack[-1] if stack else ("", False, False)
            stack.append((tag, up[1] or tag in MAIN, up[2] or declared))
    held.append(page[at:])
    flush()
    return out


def candidates(lines: list[Line]) -> list[int]:
    """Numbers of the lines that may be main text: those not declared to be anything else."""
    return [i for i, x in enumerate(lines) if not x.declared]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of two lists of line hashes (Hunt and Szymanski)."""
    lo, m = 0, min(len(a), len(b))
    while lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < m - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where = defaultdict(list)
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where[b[j]].append(j)  # descending
    ends: list[int] = []       # smallest end in b of a subsequence of each length
    links: list[tuple] = []    # (position in a, what came before) of that subsequence
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            if k < len(ends) and ends[k] == j:
                continue
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(lo), *reversed(middle), *range(len(a) - hi, len(a))]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; a URL without a host is all path."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower().removeprefix("www."), m[2].rstrip("/")) if m else ("", url or "")


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _line_table(pages: DataFrame, key: str) -> DataFrame:
    """key, host, path, the hashes of a page's candidate lines, their lengths and flags, and ``page``: the hash of host and lines."""

    def make():
        import xxhash

        def run(b):
            cols = [[], [], [], [], []]
            url, page = (b.column(b.schema.get_field_index(c)) for c in ("url", "html"))
            for u, h in zip(url.to_pylist(), page):
                lines = lines_of(h.as_py())
                mine = [lines[i] for i in candidates(lines)]
                row = (*split_url(u), [xxhash.xxh64_intdigest(x.text) - (1 << 63) for x in mine], [len(x.text) for x in mine],
                       [IN_ARTICLE * x.main + SENTENCE * x.sentence for x in mine])
                for c, v in zip(cols, row):
                    c.append(v)
            return cols
        return run

    return with_python_columns(pages, "_host string, _path string, _lines array<long>, _sizes array<int>, _flags array<int>", make).select(
        F.col(key).alias("key"), F.xxhash64("_host", "_lines", "_flags").alias("page"), "_host", "_path", "_lines", "_sizes", "_flags")


def _has_own(page: dict, shared: list[int]) -> bool:
    """Whether a page has a sentence or an article line beside those whose hashes are ``shared``."""
    left = Counter(shared)
    for line, flags in zip(page["_lines"], page["_flags"]):
        if left[line]:
            left[line] -= 1
        elif flags:
            return True
    return False


def shared_lines(page: dict, near: list[dict]) -> list[int]:
    """Numbers of the lines of ``page`` that its neighbours, nearest first, show to be the site's."""
    sizes, flags = page["_sizes"], page["_flags"]
    article = sum(x for x, f in zip(sizes, flags) if f & IN_ARTICLE)
    found = []
    for n in near:
        same = common_lines(page["_lines"], n["_lines"])
        hashes = [page["_lines"][j] for j in same]
        if _has_own(page, hashes) and _has_own(n, hashes):  # else a copy, or a page of nothing but shared lines
            found.append(same)
    guarded = {j for j, f in enumerate(flags) if f == IN_ARTICLE | SENTENCE}
    gone = set()
    for same in found:
        if sum(sizes[j] for j in same) < COPY_SHARE * sum(sizes):
            gone.update(set(same) - guarded)
            break
    if len(found) > 1:
        copied = any(sum(sizes[j] for j in same if flags[j] & IN_ARTICLE) >= ARTICLE_SHARE * article for same in found)
        gone.update(set.intersection(*map(set, found)) - (guarded if copied else set()))
    return sorted(gone)


def _deletions(numbered: DataFrame) -> DataFrame:
    """(page, gone): the numbers of the candidate lines that go, where there are any."""
    block = F.expr(f"row div {BLOCK_ROWS}")
    spot = F.col("row") % BLOCK_ROWS
    # a block also sees the two rows before its first and the two after its last
    seen = numbered.withColumn("block", F.explode(F.array_compact(F.array(
        block, F.when(spot < 2, block - 1), F.when(spot >= BLOCK_ROWS - 2, block + 1)))))

    def pair(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["row"])
        pages, gone = [], []
        for i, r in enumerate(rows):
            if r["row"] // BLOCK_ROWS != r["block"]:
                continue
            # the row on either side, and at the end of a host the second one
            near = [rows[j] for j in (i - 1, i + 1, i - 2, i + 2) if 0 <= j < len(rows) and rows[j]["_host"] == r["_host"]][:2]
            near.sort(key=lambda n: (-_prefix(r["_path"], n["_path"]), abs(n["row"] - r["row"]), n["row"]))
            if drop := shared_lines(r, near):
                pages.append(r["page"])
                gone.append(drop)
        return pa.table({"page": pa.array(pages, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})

    return seen.groupBy("block").applyInArrow(pair, "page long, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and any other columns) with ``text``, the main text; a column of that name is replaced.

    A null or empty html gives the empty text. A null URL belongs to the host of no name. Pages of a host
    with equal lines are one page to the pairing, placed at the first of their paths, and all get its
    result; pages without lines are no neighbours. Clashing column names are avoided, other columns pass
    through.
    """
    key, gone = fresh(pages, "key"), fresh(pages, "gone")
    keyed = pages.drop("text").withColumn(key, F.xxhash64("url", "html"))
    thin = frozen(_line_table(keyed.select(key, "url", "html"), key), "lines")
    once = (thin.filter(F.size("_lines") > 0).groupBy("page").agg(F.min(F.struct("_path", "_host", "_lines", "_sizes", "_flags")).alias("x"))
            .select("page", "x.*"))
    numbered, _ = global_rows(once, ["_host", "_path", "page"])
    # copies of one page are spread over tasks
    delete = salted_join(thin.select("key", "page").distinct(), _deletions(numbered), ["page"], F.col("key"))
    delete = frozen(delete.select(F.col("key").alias(key), F.col("gone").alias(gone)), "shared-lines")
    joined = keyed.join(delete, key, "left")  # broadcast only if the written table is below Spark's bound

    def make():
        def run(b):
            page, drop = (b.column(b.schema.get_field_index(c)) for c in ("html", gone))
            out = []
            for h, g in zip(page, drop.to_pylist()):
                lines = lines_of(h.as_py())
                skip = set(g or ())
                out.append(" ".join(lines[i].text for j, i in enumerate(candidates(lines)) if j not in skip))
            return [out]
        return run

    return with_python_columns(joined, "text string", make).drop(key, gone)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
