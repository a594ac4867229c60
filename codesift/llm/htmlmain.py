"""Main text of web pages: markup roles and a suffix array over the pages of a host.

A page is read into blocks: the texts between block-level tags, in page order, each with the role of its element
(chrome: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments; article: inside an
`article` or `main` element; body: anything else). End tags that HTML lets out are put in: `head` ends at the first
element that cannot stand in it, `p`, `li`, `dt`, `dd`, `tr`, `td` and `th` where the next one or their list begins or
ends. An element is chrome by its tag, its role, or a class or id that names chrome (`sidebar`, `site-footer`). Where a
name only holds such a word among others (`header-fixed`), and for `form`, the words decide: if the element holds more
than half of the words of the page's article (or of its body), it is a wrapper and stays, and an `article` or `main`
inside of it begins anew. On elements of running text only a whole name counts (`ad`, not `share-price`). Words of
`button` and `label` stay if other text stands in their block. Of a page that has an article with text, only the article is kept.
The suffix array finds what the host's template put into it (a notice without a name, a signature): blocks whose runs
stand in more than half of the host's different articles, and in `PAGES` or more. Less repetition takes nothing from
an article, nor does one of half of its words or more: copies of an article repeat too, and their text is main text on every
one of them. On the other pages repetition on the host decides, and only whole blocks go: the words of a group of
pages outside of articles are concatenated to one token stream, each page ended by a mark of its own, and its suffix
array, by prefix doubling, gives the distinct runs of `LONG` words and the distinct pages of the group that each
stands on. Shorter blocks are compared whole: a run is a block of `RUN` words or more, or the fewest neighbouring
blocks with that many. The counts are added up over the host's groups by a 64-bit hash of the run. A block goes if it
belongs to a run of whole blocks, or is covered by runs of `LONG` words, that stand on `PAGES` pages of the host or
more. Pages with the same visible text are one page.

A run in more than half of a host's articles is in more than half of those of one group at least, so each group's
suffix array names its runs of that kind, and these few are counted over the host.

The pages of a large host are dealt into groups of about `GROUP` pages, so no task holds a host; how they are dealt
does not change the result. Pages without article that are
alike but not equal (a copy with another date) count as several, so what they share goes.

Defined cases: null and empty html give an empty text; a null url is a host of its own; html without tags is one block;
unclosed and stray tags are taken as they come; unknown character references stay as written; repeated rows and
copies of a page are one page when repetitions are counted, and each gives a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from codesift.llm.common import _BASE, _powers, mix64, stored, word_hashes

GROUP = 128
RUN = 4
PAGES = 3
#: Words of a run that counts across the borders of blocks.
LONG = 16
#: Hosts with pages to compare that are broadcast at most; beyond, the joins are shuffled.
BROADCAST_HOSTS = 50_000

#: Elements whose contents are no text.
SILENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "select", "textarea", "annotation", "annotation-xml"}
#: Elements and roles around the article.
CHROME = {"nav", "header", "footer", "aside", "menu", "dialog", "fieldset"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Words of class and id names that mark chrome and reader comments.
CHROME_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "reply", "replies",
    "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that a name of chrome may hold beside it, and words that make it tell of a layout instead.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "form", "global", "group", "icons", "inner", "item",
    "items", "links", "list", "main", "message", "outer", "page", "panel", "post", "posts", "primary", "secondary", "section", "site", "thread",
    "top", "wrap", "wrapper",
}
LAYOUT = {"has", "with", "without", "no", "not", "is", "hide", "hides", "show", "shows"}
#: Elements that stay within a line of text (formulas too), and those of them that are controls.
CONTROLS = {"button", "label"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "math", "mfenced", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt",
    "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics", *CONTROLS,
}
#: Elements of running text, whose classes tell of their text more often than of chrome.
TEXTUAL = INLINE | {"p", "li", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "caption"}
#: Elements that may stand in `head`; where an open `p` ends; and what else a start tag ends, up to which element.
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dt", "dd", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "table", "tr", "td", "th", "ul",
}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
NAME = re.compile(r"(?:\bclass|\bid|\brole)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HEADERS_INSIDE = {"header"}
BODY, IN_ARTICLE, OUT = 0, 1, 2


#: How sure it is that an element is chrome.
NO, PERHAPS, SURE = 0, 1, 2


def chrome_name(name: str) -> int:
    """What a class, an id or a role says."""
    if name in CHROME_ROLES or name in CHROME_NAMES:
        return SURE
    parts = re.split(r"[-_]+", name)
    if CHROME_NAMES.isdisjoint(parts) or not LAYOUT.isdisjoint(parts):
        return NO
    return SURE if all(x in CHROME_NAMES or x in NEUTRAL or not x or x.isdigit() for x in parts) else PERHAPS


def is_chrome(tag: str, attributes: str, in_article: bool) -> int:
    if tag in CHROME:
        return NO if in_article and tag in HEADERS_INSIDE else SURE  # an article's own header holds its title
    found = PERHAPS if tag == "form" else NO
    if "=" in attributes and tag not in ARTICLE and tag not in ("html", "body"):
        for m in NAME.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                found = max(found, chrome_name(name))
    return NO if found == PERHAPS and tag in TEXTUAL else found


def _read(page: str) -> Iterator[tuple[int, str, tuple[int, ...]]]:
    """(role, text, elements that are perhaps chrome around it) of the blocks in order, without those surely chrome."""
    stack: list[tuple[str, int, tuple[int, ...]]] = []  # open elements, with what held before them
    role, around, at, n_around = BODY, (), 0, 0
    parts: list[str] = []
    controls, alone = 0, True  # open controls; whether the block has no text outside of controls

    def flush():
        nonlocal alone
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        kept, alone = not alone, True
        return [(role, text, around)] if text and kept and role != OUT else []

    def pop():
        nonlocal role, around
        tag, role, around = stack.pop()
        return tag

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not text.isspace():
            if stack and stack[-1][0] == "head":
                yield from flush()
                pop()
            alone = alone and controls > 0
        parts.append(text)
        if m is None:
            yield from flush()
            return
        at, tag, ending = m.end(), (m[2] or "").lower(), bool(m[1])
        if not tag:
            continue
        if not ending and tag not in IN_HEAD and any(t == "head" for t, *_ in stack):
            yield from flush()
            while pop() != "head":
                pass
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            elif tag in CONTROLS and not m[3].endswith("/"):
                controls = max(0, controls + (-1 if ending else 1))
            elif not ending and is_chrome(tag, m[3], role == IN_ARTICLE):
                yield from flush()
                stack.append((tag, role, around))
                role = OUT
            elif ending and stack and stack[-1][0] == tag:
                yield from flush()
                pop()
            continue
        yield from flush()
        controls = 0
        if ending:
            if any(t == tag for t, *_ in stack):
                while pop() != tag:
                    pass
            continue
        if tag in SILENT:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph, with the inline chrome in it
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in ENDS:
            own, border = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in own:
                    while len(stack) > i:
                        pop()
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        stack.append((tag, role, around))
        if tag in ("head", "title"):
            role = OUT
        if role != OUT:
            sure = is_chrome(tag, m[3], role == IN_ARTICLE)
            if sure == SURE:
                role = OUT
            elif tag in ARTICLE:
                role, around = IN_ARTICLE, around if role == IN_ARTICLE else ()
            elif sure == PERHAPS:
                around, n_around = (*around, n_around), n_around + 1


def blocks(page: str | None) -> Iterator[tuple[int, str]]:
    """(role, text) of the page's blocks in order; white space inside a block is one space; empty ones are left out."""
    found = list(_read(page)) if page else []
    words, held = {BODY: 0, IN_ARTICLE: 0}, {}
    for role, text, around in found:
        n = text.count(" ") + 1
        words[role] += n
        for e in around:
            held[e, role] = held.get((e, role), 0) + n
    for role, text, around in found:
        if all(2 * held[e, role] > words[role] for e in around):
            yield role, text


def ranks(words: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every suffix by its first `run` words, and how many words are left to its page's end.

    `words` are the hashes of all pages' words, `page` the page of each (ascending). Prefix doubling ranks all
    suffixes by their first 1, 2, 4, .. words; a page's end is a mark of its own, so no run crosses it.
    """
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    ends = np.append(np.flatnonzero(np.diff(page)) + 1, n)  # where the next page starts
    left = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n)
    rank, width = rank.astype(np.int64), 1
    while width < run:
        step = min(width, run - width)
        after = np.full(n, -1, dtype=np.int64)
        after[: n - step] = rank[step:]
        # A suffix that ends before `width + step` words gets its own rank.
        after = np.where(left >= width + step, after, n + np.arange(n))
        _, rank = np.unique(rank * (2 * n + 2) + after, return_inverse=True)
        rank, width = rank.astype(np.int64), width + step
    return rank, left


def page_counts(words: np.ndarray, page: np.ndarray, run: int, owner: np.ndarray | None = None):
    """(order, starts, distinct, left): the suffix array to `run` words, where its classes of equal runs start, and
    the distinct pages of each class. `owner` is the page that a stretch in `page` belongs to, if not itself."""
    rank, left = ranks(words, page, run)
    owner = page if owner is None else owner
    order = np.argsort(rank, kind="stable")  # the suffix array, to `run` words
    new_rank = np.append(True, np.diff(rank[order]) != 0)
    starts = np.flatnonzero(new_rank)
    new_page = np.append(True, np.diff(owner[order]) != 0) | new_rank
    return order, starts, np.add.reduceat(new_page.astype(np.int64), starts), left


def spread(first: np.ndarray, run: int, n: int) -> np.ndarray:
    """Which of `n` words the runs of `run` words that start at `first` cover."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, np.minimum(first + run, n), -1)
    return np.cumsum(mark[:-1]) > 0


def page_parts(page: str | None) -> tuple[int, str | None, list[str]]:
    """Signature of a page's visible text; the main text if roles decide it, else null; its blocks outside articles.

    An empty string in place of a block marks an article between two blocks.
    """
    found = list(blocks(page))
    article = [text for role, text in found if role == IN_ARTICLE]
    body = [text if role == BODY else "" for role, text in found]
    body = [t for i, t in enumerate(body) if t or (i and body[i - 1])]
    text = "\n".join(article) if article or not found else None
    return digest("\n".join(f"{role} {text}" for role, text in found)), text, body


class Stream:
    """The words of some pages' blocks; `stretch` counts the parts between articles, `page` the pages."""

    def __init__(self, bodies: list[list[str]]):
        where = [(i, text) for i, body in enumerate(bodies) for text in body]
        self.hashes, self.offsets = word_hashes([text for _, text in where])
        n = np.diff(self.offsets)
        pages = np.array([i for i, _ in where], dtype=np.int64)
        gaps = np.array([not text for _, text in where], dtype=np.int64)
        self.page = np.repeat(pages, n)
        self.stretch = np.repeat(pages + np.cumsum(gaps), n)

    def runs(self, run: int) -> np.ndarray:
        """A hash of the `run` words from each word on; what stands behind the last words is not told apart."""
        n = len(self.hashes)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(run):
                out[: max(n - k, 0)] += self.hashes[k:] * _powers(_BASE, run)[k]
        return mix64(out).view(np.int64)


def digest(text: str) -> int:
    seen = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(seen.digest(), "little", signed=True)


def block_runs(body: list[str]) -> Iterator[tuple[int, int, int]]:
    """(hash, first, last): from each block on, and back from it, the fewest whole blocks of `RUN` words or more."""
    size = [len(text.split(" ")) if text else 0 for text in body]
    found = set()
    for i, n in enumerate(size):
        for step in (1, -1):
            j, total = i, n
            while size[j] and total < RUN and 0 <= j + step < len(body):
                j += step
                total += size[j]
            if size[j] and total >= RUN:  # no article and no page's end in between
                found.add((min(i, j), max(i, j)))
    for i, j in sorted(found):
        yield digest("\n".join(body[i : j + 1]).lower()), i, j


def count_runs(bodies: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of the pages of a group, by hash, and on how many of the pages each stands."""
    each = [np.unique(np.array([h for h, _, _ in block_runs(body)], dtype=np.int64)) for body in bodies]
    run, n = np.unique(np.concatenate([np.empty(0, np.int64), *each]), return_counts=True)
    stream = Stream(bodies)
    if len(stream.hashes) < LONG:
        return run, n
    order, starts, distinct, left = page_counts(stream.hashes, stream.stretch, LONG, stream.page)
    first = order[starts]
    whole = left[first] >= LONG
    return np.concatenate([run, stream.runs(LONG)[first[whole]]]), np.concatenate([n, distinct[whole]])


def cut(body: list[str], wide: np.ndarray) -> str:
    """The text of a page without article, less the blocks that the host's runs `wide` cover whole."""
    stream, same = Stream([body]), list(block_runs(body))
    n = len(stream.hashes)
    first = np.flatnonzero(np.isin(stream.runs(LONG)[: max(n - LONG + 1, 0)], wide))
    cover = spread(first, LONG, n)
    gone = {j for j in range(len(body)) if cover[stream.offsets[j] : stream.offsets[j + 1]].all()}
    for (_, i, j), hit in zip(same, np.isin(np.array([h for h, _, _ in same], dtype=np.int64), wide)):
        if hit:
            gone.update(range(i, j + 1))
    return "\n".join(text for j, text in enumerate(body) if j not in gone)


def usual_runs(articles: list[str]) -> np.ndarray:
    """The runs that stand in more than half of these different articles."""
    runs, n = count_runs([text.split("\n") for text in articles])
    return runs[2 * n > len(articles)]


def held_runs(article: str, runs: np.ndarray) -> np.ndarray:
    """Which of `runs` an article has."""
    body = article.split("\n")
    stream = Stream([body])
    own = [np.array([h for h, _, _ in block_runs(body)], np.int64), stream.runs(LONG)[: max(len(stream.hashes) - LONG + 1, 0)]]
    return np.intersect1d(np.concatenate(own), runs)


def trim(article: str, template: np.ndarray) -> str:
    """An article less the blocks that runs of the host's template cover, if they are less than half of its words."""
    left = cut(article.split("\n"), template)
    return left if 2 * len(left.split()) > len(article.split()) else article


def main_texts(pages: list[str | None]) -> list[str]:
    """The main texts of all pages of one host."""
    parts = [page_parts(p) for p in pages]
    articles = list({text for _, text, _ in parts if text})
    if len(articles) >= PAGES:
        runs, n = count_runs([text.split("\n") for text in articles])
        template = runs[(n >= PAGES) & (2 * n > len(articles))]
        parts = [(sig, text and trim(text, template), body) for sig, text, body in parts]
    if all(text is not None for _, text, _ in parts):
        return [text for _, text, _ in parts]
    runs, n = count_runs(list({sig: body for sig, _, body in parts}.values()))
    wide = runs[n >= PAGES]
    return [cut(body, wide) if text is None else text for _, text, body in parts]


def host(url: Column) -> Column:
    """Host of a url, lower-cased, without user and port; an unreadable url is its own host."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found == "", F.coalesce(url, F.lit(""))).otherwise(F.lower(found))


def _parse(batches):
    for batch in batches:
        parts = [page_parts(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
        sig, text, body = zip(*parts) if parts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sig, pa.int64()), pa.array(text, pa.string()), pa.array(body, pa.list_(pa.string()))],
            [*batch.schema.names[:-1], "sig", "text", "body"],
        )


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    run, n = count_runs([list(b) for b in pdf["body"]])
    return pd.DataFrame({"host": pdf["host"].iloc[0], "part": pdf["part"].iloc[0], "run": run, "n": n})


def _cut(pdf: pd.DataFrame, wide: pd.DataFrame) -> pd.DataFrame:
    runs, pdf = wide["run"].to_numpy(np.int64), pdf[pdf["open"]]
    return pd.DataFrame({"host": pdf["host"], "sig": pdf["sig"], "cut": [cut(list(b), runs) for b in pdf["body"]]})


def _once(batches):
    """Of equal articles of a host one a task, packed for the shuffle."""
    seen = set()
    for batch in batches:
        host, part, art, text = (c.to_pylist() for c in batch.columns)
        new = [i for i, key in enumerate(zip(host, art)) if key not in seen and not seen.add(key)]
        packed = [zlib.compress(text[i].encode("utf-8", "surrogatepass"), 6) for i in new]
        kept = [pa.array([c[i] for i in new], t) for c, t in ((host, pa.string()), (part, pa.int32()), (art, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], ["host", "part", "art", "packed"])


def _usual(pdf: pd.DataFrame) -> pd.DataFrame:
    articles = [zlib.decompress(t).decode("utf-8", "surrogatepass") for t in pdf.drop_duplicates("art")["packed"]]
    return pd.DataFrame({"host": pdf["host"].iloc[0], "run": usual_runs(articles)})


def _held(batches):
    seen = set()
    for batch in batches:
        host, art, text = (c.to_pylist() for c in batch.columns[:3])
        out = []
        for i, key in enumerate(zip(host, art)):
            if key not in seen:
                seen.add(key)
                out += [(*key, r) for r in held_runs(text[i], batch.column(3)[i].values.to_numpy()).tolist()]
        h, a, r = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(a, pa.int64()), pa.array(r, pa.int64())], ["host", "art", "run"])


def _trim(batches):
    for batch in batches:
        runs = batch.column(batch.num_columns - 1)
        texts = [trim(t, runs[i].values.to_numpy()) for i, t in enumerate(batch.column(batch.num_columns - 2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], batch.schema.names[:-1])


def trimmed(articles: DataFrame) -> DataFrame:
    """(id, url, text) of `articles` (id, url, host, text), less what the hosts' templates put into them."""
    told = articles.where("text != ''").withColumn("art", F.xxhash64("text"))
    sizes = told.select("host", "art").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    sizes = stored(sizes.withColumn("groups", F.ceil(F.col("n") / GROUP).cast("int")))
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_HOSTS else sizes
    dealt = told.join(few, "host").select("host", F.pmod("art", "groups").cast("int").alias("part"), "art", "text")
    dealt = dealt.mapInArrow(_once, "host string, part int, art long, packed binary")
    usual = dealt.groupBy("host", "part").applyInPandas(_usual, "host string, run long")
    usual = stored(usual.groupBy("host").agg(F.collect_set("run").alias("runs")))
    plain = articles.select("id", "url", "text")
    if usual.isEmpty():
        return plain
    held = told.join(usual, "host").select("host", "art", "text", "runs").mapInArrow(_held, "host string, art long, run long")
    counts = held.distinct().groupBy("host", "run").agg(F.count("*").alias("has")).join(few, "host")
    counts = counts.where((F.col("has") >= PAGES) & (2 * F.col("has") > F.col("n")))
    template = stored(counts.groupBy("host").agg(F.collect_list("run").alias("runs")))
    if template.isEmpty():
        return plain
    hosts = template.select("host")
    cut_texts = articles.join(template, "host").select("id", "url", "text", "runs").mapInArrow(_trim, plain.schema)
    return articles.join(hosts, "host", "left_anti").select("id", "url", "text").union(cut_texts)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of `pages`."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(page).alias("page"))
    fields = [f for f in rows.schema.fields if f.name != "page"]
    added = [StructField("sig", LongType()), StructField("text", StringType()), StructField("body", ArrayType(StringType()))]
    parsed = stored(rows.mapInArrow(_parse, StructType([*fields, *added])), "zstd")  # every page is parsed once
    decided = trimmed(parsed.where("text is not null").select("id", "url", "host", "text"))
    open_hosts = stored(parsed.where("text is null").groupBy("host").agg(F.lit(1).alias("one")).select("host"))
    n_open = open_hosts.count()
    if n_open == 0:
        return decided
    if n_open <= BROADCAST_HOSTS:
        open_hosts = F.broadcast(open_hosts)
    # All pages of these hosts count, those with an article by their blocks outside of it; equal pages are one page.
    told = parsed.join(open_hosts, "host", "left_semi").groupBy("host", "sig")
    told = stored(told.agg(F.first("body").alias("body"), F.bool_or(F.col("text").isNull()).alias("open")))
    sizes = stored(told.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")))
    if n_open <= BROADCAST_HOSTS:
        sizes = F.broadcast(sizes)
    dealt = stored(told.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("sig"), "groups").cast("int")).drop("groups"))
    # A page is in one group, so a run's pages on the host are the sum over the groups.
    runs = stored(dealt.groupBy("host", "part").applyInPandas(_count, "host string, part int, run long, n long"))
    wide = stored(runs.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("host", "run"))
    back = runs.join(wide, ["host", "run"]).select("host", "part", "run")
    texts = dealt.groupBy("host", "part").cogroup(back.groupBy("host", "part"))
    texts = stored(texts.applyInPandas(_cut, "host string, sig long, cut string"))
    undecided = stored(parsed.where("text is null").select("id", "url", "host", "sig")).join(texts, ["host", "sig"])
    return decided.union(undecided.select("id", "url", F.col("cut").alias("text")))


def op8(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
