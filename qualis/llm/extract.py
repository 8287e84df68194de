"""Main-text extraction by the maximum-scoring subsequence of a page's tokens.

A page is cut into words and tags. Words score positive and tags negative, and the
contiguous run of tokens with the greatest sum is the content region; one linear scan
finds it. The weights are learned from labelled pages: pages that mark their article
with an <article> element. A word scores 1; a tag scores minus the price learned for its
kind, log-odds of standing outside the article, between MIN_PRICE and MAX_PRICE.

Elements that never hold article text (scripts, styles, menus, forms, ...; see SKIPPED) are
one cheap token without words, so the run may span one inside the article without taking
its text. Elements with such a class, id or role are too, unless they are wrappers: they hold
most of the page's words and an <h1> (or the page has none, and they are no list of comments
or related texts). In the region, block tags end a block; character references
are decoded, white space is collapsed, and blocks are joined by a line feed.

The fit reads a bounded sample: the SAMPLE labelled pages with the smallest hash of the id
(ties of the last hash all count). Prices are a small table of tag kinds, see KINDS.

Defined cases: null or empty html, or html without words, has the empty text; a page cut
off inside a tag, comment or element ends there; repeated rows get equal rows; an empty
table gives no rows; without labelled pages the prior counts alone set the prices; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import in_slices, ref, texts

SAMPLE = 2000
MAX_PRICE = 12.0
MIN_PRICE = 0.1
SCHEMA = "page_id long, url string, text string, n_chars long"

# --- Fixed values: HTML element names and common class names. ---
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title nav menu "
                    "header footer aside form button select option textarea input label fieldset dialog".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption "
                    "figure figcaption hr section".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie "
                        "cookies consent disclaimer footer header menu modal nav navbar navigation newsletter notice "
                        "pagination popup promo related respond share sharing sidebar social sponsor sponsored "
                        "subscribe toolbar widget".split())
ARTICLE = frozenset("article body content entry main post story".split())
# --- End of fixed values. ---
LISTS = frozenset("comment comments related respond".split())  # their entries may be <article> elements
REGIONS = frozenset(("article", "main"))
KINDS = ("inline", "content", "div", "other", "region", "skipped")
# (inside, outside) counts added to the sample's: what the kinds are without labelled pages
PRIOR = {"inline": (20, 10), "content": (20, 10), "div": (2, 10), "other": (2, 10), "region": (0, 20), "skipped": (1, 20)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(>|\Z)"
                    r"|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")


def _boilerplate(attributes: str) -> set[str]:
    parts = {p for m in _NAMES.finditer(attributes) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())}
    return set() if parts & ARTICLE else parts & BOILERPLATE


def kind_of(name: str) -> str:
    if name in REGIONS:
        return "region"
    if name in SKIPPED:
        return "skipped"
    if name in INLINE:
        return "inline"
    if name in CONTENT:
        return "content"
    return "div" if name == "div" else "other"


class _Named:
    """An element with a boilerplate name: its tokens, words and <h1> tags (from, to)."""

    def __init__(self, is_list: bool, depth: int, regions: int, at: tuple[int, int, int]):
        self.is_list, self.depth, self.regions, self.start, self.end = is_list, depth, regions, at, at


def tokens(page: str) -> list[tuple]:
    """(name, is_end, text) in page order: tags have a name, texts have none; a skipped element
    is one tag. Names are lower case."""
    out, named, open_, by_name, depths = [], [], [], {}, {}
    at, skip, depth, level, words, heads = 0, None, 0, 0, 0, 0

    def close() -> None:
        element, name = open_.pop()
        by_name[name].pop()
        element.end = (len(out), words, heads)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not skip and (text := page[at:m.start() if m else len(page)]):
            if m or text.strip():
                out.append((None, False, text))
                words += len(text.split())
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        is_end, attributes = bool(m[1]), m[3] or ""
        closes = attributes.endswith("/") or name in VOID
        ended = False
        if not closes:
            depths[name] = depths.get(name, 0) + (-1 if is_end else 1)
        regions = depths.get("article", 0) + depths.get("main", 0)
        # an unclosed element ends where the article starts or the body ends; a list of comments
        # or related texts where the article around it ends
        while open_ and (name == "body" or name in REGIONS and (not open_[-1][0].is_list
                                                                or regions < open_[-1][0].regions)):
            close()
            ended = True
        if is_end and by_name.get(name) and depths[name] < by_name[name][-1].depth:
            last = by_name[name][-1]
            while open_[-1][0] is not last:
                close()
            out.append((name, True, None))
            close()
            if skip and len(open_) < level:
                skip = None
            continue
        if skip and len(open_) < level:
            skip = None
        if skip:
            if name == skip and not closes:
                depth += -1 if is_end else 1
            if depth == 0 or name == "body" or name in REGIONS and skip not in ("aside", "footer"):
                skip = None
                if name not in REGIONS:
                    continue
            else:
                continue
        elif ended and name == "body":
            continue
        if not is_end and name in SKIPPED:
            out.append((name, False, None))
            if closes:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                depths[name] -= 1
            else:
                skip, depth, level = name, 1, len(open_)
            continue
        if not is_end and not closes and name not in REGIONS and name not in ("body", "html") \
                and (found := _boilerplate(attributes)):
            element = _Named(bool(found & LISTS), depths[name], regions, (len(out), words, heads))
            named.append(element)
            open_.append((element, name))
            by_name.setdefault(name, []).append(element)
        heads += name == "h1" and not is_end
        out.append((name, is_end, None))
    while open_:
        close()
    kept, done = [], 0
    for element in named:
        (first, a, b), (last, c, d) = element.start, element.end
        is_wrapper = 2 * (c - a) > words and (d > b or not heads and not element.is_list)
        if first >= done and not is_wrapper:
            kept += [*out[done:first], ("nav", False, None)]
            done = last
    return kept + out[done:]


def region(parts: list[tuple], prices: dict[str, float]) -> tuple[int, int]:
    """The range of tokens with the greatest score, the first such; empty if none is positive."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    for i, (name, _, text) in enumerate(parts):
        total += len(text.split()) if name is None else -prices[kind_of(name)]
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str, prices: dict[str, float]) -> str:
    parts = tokens(page)
    low, high = region(parts, prices)
    blocks, block = [], []
    for name, _, text in [*parts[low:high], ("p", True, None)]:
        if name is None:
            block.append(text)
        elif name == "br":
            block.append(" ")
        elif kind_of(name) != "inline":
            line = " ".join(entities.unescape("".join(block)).split())
            if line:
                blocks.append(line)
            block = []
    return "\n".join(blocks)


def _tag_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Tags of each kind inside and outside the marked article; its own tags are outside."""
    n = {(k, inside): 0 for k in KINDS for inside in (True, False)}
    for page in texts(batch.column("html")):
        depth = 0
        for name, is_end, text in tokens(page.decode("utf-8")):
            if name == "article":
                depth = max(0, depth + (-1 if is_end else 1))
                n["region", False] += 1
            elif name is not None:
                n[kind_of(name), depth > 0] += 1
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([i for _, i in n]),
                                       pa.array(list(n.values()), pa.int64())], ["kind", "inside", "n"])


def fit_prices(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
               sample: int = SAMPLE) -> dict[str, float]:
    """The price of each kind of tag, from a bounded sample of the pages with an <article>."""
    rows = pages.select(F.xxhash64(ref(id_col)).alias("h"), ref(html_col).alias("html")) \
        .where(F.col("html").rlike("(?i)<article[\\s>]"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    n = {k: list(PRIOR[k]) for k in KINDS}
    if last is not None:
        counted = rows.where(F.col("h") <= last).mapInArrow(in_slices(_tag_counts, "html"), "kind string, inside boolean, n long")
        for r in counted.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():  # 12 rows
            n[r.kind][0 if r.inside else 1] += r.n
    totals = [sum(v[i] for v in n.values()) for i in (0, 1)]
    prices = {k: min(MAX_PRICE, max(MIN_PRICE, 4 * math.log((out + 0.5) / totals[1] * totals[0] / (inside + 0.5))))
              for k, (inside, out) in n.items()}
    return {**prices, "skipped": MIN_PRICE}


def main_texts(pages: DataFrame, prices: dict[str, float], id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """SCHEMA, one row per page."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(t.decode("utf-8"), prices) for t in texts(batch.column("html"))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                                           pa.array([len(t) for t in found], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])
    rows = pages.select(ref(id_col).cast("long").alias("page_id"), ref(url_col).alias("url"), ref(html_col).alias("html"))
    return rows.mapInArrow(in_slices(run, "html"), SCHEMA)
