"""Operator 7: main text of web pages by the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, text_or_empty

#: Markup. A tag ends before the next < outside quotes, so what is not closed is not searched again and again;
#: where quotes do not pair up, it ends at the first >.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']*+(?:"[^"]*"[^<>"']*+|'[^']*'[^<>"']*+)*+)(?=>)|[^<>]*+)>""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*["']?([\w-]+)""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HOLDERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "dl", "figure", "details", "dialog"}
LISTS = {"ul", "ol", "dl", "table"}
BLOCKS = HOLDERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "blockquote", "figcaption", "caption", "address", "center", "fieldset", "summary", "hr"}
#: Prior knowledge for what the labelled pages do not show: signs of what is not the article, by element and by name.
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "head"}
ASIDE_NAME = re.compile(r"(^|[-_])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|menu|modal|nav\w*|newsletter|notice|popup|promo|related|share|sidebar|social|sponsor\w*|subscribe)($|[-_])", re.I)
#: Elements that mark the article. What is aside within one costs nothing, so that it does not cut the region in two, and is
#: left out; a header there has the title.
ARTICLE, TITLED = {"article", "main"}, {"header"}
#: Weights: a word where nothing is known, a word in an aside, a tag, the tag of an aside or of a holder; bounds of learned ones,
#: and the least of a tag that is no holder, as links and list items stand in articles too.
WORD, ASIDE_WORD, TAG_WEIGHT, ASIDE_TAG, MOST, LEAST, LEAST_INNER = 1.0, -1.0, -0.2, -6.0, 2.0, -8.0, -1.5
OUTSIDE, WITHIN = "outside", "within"
#: Pages that weights are learned from, at most.
LABELLED = 2_000


class Region:
    """Where the walk through a page stands: the open holders and the block inside them."""

    def __init__(self):
        self.holders: list[tuple[str, str, str]] = []  # element, key, what it is aside of
        self.open: Counter = Counter()  # elements of the holders
        self.block = ""

    def aside(self, name: str, named: str) -> str:
        """Whether an element that opens here is aside: not (""), of the page, or within an article."""
        inside = bool(self.open.keys() & ARTICLE)
        if self.holders and self.holders[-1][2]:
            return self.holders[-1][2]
        own = (name in ASIDE and not (inside and name in TITLED)) or bool(named and ASIDE_NAME.search(named))
        return (WITHIN if inside else OUTSIDE) if own else ""

    def enter(self, name: str, key: str, aside: str) -> None:
        self.holders.append((name, key, aside))
        self.open[name] += 1

    def leave(self, name: str) -> str:
        """Closes the innermost holder of that element and all inside it; its key, or the name if there is none."""
        if not self.open[name]:
            return name
        while True:
            last, key, _ = self.holders.pop()
            self.open[last] -= 1
            if not self.open[last]:
                del self.open[last]
            if last == name:
                return key

    def context(self) -> tuple[str, str]:
        name, key, aside = self.holders[-1] if self.holders else ("", "", "")
        return f"{key}>{self.block}", aside


def walk(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(what, key, text, aside) of a page in order: 'word' for text between tags with the key of its context, 'tag' for
    tags; 'break' marks where a block starts or ends; aside is OUTSIDE or WITHIN an article, or empty. Contents of scripts, styles and the like are left out."""
    at, region, n = 0, Region(), len(page)
    unclosed: set[str] = set()  # elements of RAW that no later tag closes
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            key, aside = region.context()
            yield "word", key, text, aside
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        close, name = m[1], m[2].lower()
        if name in RAW:
            if not close and not m[3].endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if not end:
                    unclosed.add(name)
                at = end.end() if end else n if name in ("script", "style") else at
            continue
        named = NAMED.search(m[3])
        key = f"{name}.{named[1].lower()}" if named else name
        if name in LISTS and not close and region.holders:
            key = f"{region.holders[-1][1].split(' ')[-1]} {key}"  # a list or table is what its place makes it
        if name in HOLDERS:
            yield "break", "", "", ""
            if close:
                aside = region.context()[1] if region.open[name] else ""
                yield "tag", f"/{region.leave(name)}", "", aside
            else:
                aside = region.aside(name, named[1] if named else "")
                yield "tag", key, "", aside
                region.enter(name, key, aside)
            region.block = ""
        elif name in BLOCKS:
            yield "break", "", "", ""
            yield "tag", ("/" if close else "") + name, "", region.context()[1]
            region.block = "" if close else name
        elif name == "br":
            yield "word", region.context()[0], " ", region.context()[1]
        elif name not in VOID:
            yield "tag", ("/" if close else "") + name, "", region.context()[1]


def weight_of(what: str, key: str, aside: str, learned: dict[str, float]) -> float:
    """Learned, or prior where nothing was learned; what is aside is never above zero, whatever was learned."""
    known = learned.get(f"{what} {key}")
    if aside == WITHIN:
        return 0.0
    if what == "word":
        return min(ASIDE_WORD if known is None else known, 0.0) if aside else WORD if known is None else known
    return known if known is not None else ASIDE_TAG if aside and key.removeprefix("/").split(".")[0] in HOLDERS else TAG_WEIGHT


def extract(page: str, learned: dict[str, float]) -> str:
    """The blocks of the contiguous region whose words and tags score highest, the first of equal ones; of its words,
    those in contexts that score negative are left out. Empty if nothing scores above zero."""
    events = list(walk(page))
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, (what, key, text, aside) in enumerate(events):
        if what == "break":
            continue
        weight = weight_of(what, key, aside, learned)
        run += weight * len(text.split()) if what == "word" else weight
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, best_at = run, (start, i + 1)
    blocks, parts = [], []
    for what, key, text, aside in events[slice(*best_at)]:
        if what == "word":
            if weight_of(what, key, aside, learned) > 0:
                parts.append(text)
        elif what == "break":
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def label_counts(page: str) -> Counter:
    """Words and tags of a labelled page, by key, inside and outside its one article. What is aside within it is outside."""
    counts: Counter = Counter()
    inside = False
    for what, key, text, aside in walk(page):
        if what == "tag" and key.split(".")[0] in ("article", "/article"):
            counts[f"tag {key}", False] += 1
            inside = not key.startswith("/")
        elif what != "break":
            counts[f"{what} {key}", inside and not aside] += len(text.split()) if what == "word" else 1
    return counts


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", labelled: int = LABELLED) -> dict[str, float]:
    """Weights from labelled pages: pages that mark their text as exactly one article element, of which the `labelled` with
    the least hash of id are read. A key's weight is the logarithm of the odds that it lies inside the article, bounded
    by LEAST and MOST; tags stay negative. Spark counts; the driver gets one row per key of these pages. The chosen ids are
    broadcast, `labelled` numbers at most (16 KB)."""
    marked = F.regexp_count(F.lower(F.col(html_col)), F.lit("<article[ >]")) == 1
    chosen = pages.where(F.col(id_col).isNotNull() & marked).select(F.col(id_col).alias("_i")).distinct().orderBy(F.xxhash64("_i"), "_i").limit(labelled)
    sample = pages.select(F.col(id_col).alias("_i"), F.col(html_col).alias("html")).where(marked).join(F.broadcast(chosen), "_i", "left_semi")

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0).to_pylist():
                counts.update(label_counts(page))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["key", "inside", "n"])

    found = sample.select("html").mapInArrow(run, "key string, inside boolean, n long").groupBy("key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b")).where("a + b >= 5")
    odds = lambda a, b: max(LEAST, min(MOST, math.log((a + 0.5) / (b + 0.5))))
    holder = lambda key: re.split(r"[ .]", key.removeprefix("tag ").removeprefix("/"))[0] in HOLDERS
    least = lambda key: LEAST if key.startswith("word") or holder(key) else LEAST_INNER
    most = lambda key: MOST if key.startswith("word") else TAG_WEIGHT
    return {r["key"]: min(most(r["key"]), max(least(r["key"]), odds(r["a"], r["b"]))) for r in found.collect()}


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None, labelled: int = LABELLED) -> DataFrame:
    """One row per row of pages: id, url, text (blocks joined by two line feeds, empty if there is none), n_chars.

    weights: learned ones (see learn); by default they are learned from at most `labelled` of these pages. Keys that
    those do not show fall back to fixed weights, so pages without labels work too. A null page counts as empty;
    repeated rows stay repeated; null ids and urls are kept; an empty table gives no rows. Other columns are not read.
    Pages are read whole; the extraction is narrow.
    """
    learned = learn(pages, id_col=id_col, html_col=html_col, labelled=labelled) if weights is None else weights
    out = T.StructType([field(pages, id_col), field(pages, url_col), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(x, learned) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=out.names)

    return pages.select(F.col(id_col), F.col(url_col), text_or_empty(html_col).alias("html")).mapInArrow(run, out)
