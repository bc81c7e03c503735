"""Main text of web pages.

A page is read once into blocks of three zones: content (inside article, else main), furniture
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by element, role
or class) and open (none of these). Plain elements whose class or id says content count as main. The tokens of
furniture, open blocks and what else the content leaves out form streams, and so do the blocks of content,
each for itself. The streams' suffixes of all pages of a host are brought together by their first ``RUN`` tokens.
A run that the outside streams of at least ``PAGES`` distinct pages hold is boilerplate. These runs decide what no article does:

* a page that marks no content loses the covered tokens of its open blocks and keeps their unique runs;
* a page that marks its content, by main or by name, loses the blocks of it outside of articles that boilerplate
  runs cover from the first token to the last, such as a notice that other pages hold in their footer.

A common extension of three pages' suffixes that is longer than ``RUN`` covers what the runs inside it
cover, and nothing covers less than a run: to sort the suffixes beyond their first ``RUN`` tokens would not cover
another token, so they are grouped by these (by a 64-bit hash) and not sorted further.

Article elements are protected: copies of an article, a sentence that several articles of a
host share, and one that stands in the host's adverts as well, are content, so none of their blocks goes. Runs
inside content make no boilerplate, blocks that are covered in part stay whole, and where covered blocks
would be more than half of a page's content (the page is a copy of others that do not mark theirs) all stay.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small, word_hashes, word_spans, written

#: Tokens of a repeated run, and distinct pages of the host from which it is boilerplate.
RUN, PAGES = 8, 3

_TAG = re.compile(r"<[!?][^>]*+>"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_END = re.compile(r"</([a-zA-Z][^\s/><]*+)")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object"}
_OFF = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "thead", "tbody",
          "tfoot", "tr", "td", "th", "caption", "section", "article", "main", "blockquote", "pre",
          "figure", "figcaption", "dl", "dt", "dd", "hr", "header", "footer", "nav", "aside", "form",
          "address", "body", "html", "head", "details", "summary", "fieldset", "center", "button",
          "select", "option", "dialog", "menu", "title"}
_HINTS = set("ad ads advert advertisement adsense sponsored sponsor promo promotion banner cookie cookies "
             "consent gdpr notice popup modal newsletter subscribe signup sidebar widget menu nav navbar "
             "navigation breadcrumb breadcrumbs masthead header footer comment comments disqus replies "
             "related recommended share sharing social pagination pager toolbar".split())
_CONTENT = {"content", "main-content", "maincontent", "article", "article-body", "article-content", "post",
            "post-body", "post-content", "entry", "entry-content", "story", "story-body"}
_ARTICLE_HINTS = {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "sponsored",
                  "promo", "related", "teaser"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu",
          "menubar", "form", "alertdialog"}


def _marked_content(name: str, attributes: str) -> bool:
    """A plain element that a whole class name, id or role calls the page's content."""
    if name not in ("div", "section", "td") or not attributes:
        return False
    values = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTR.findall(attributes)}
    names = {*values.get("class", "").split(), values.get("id", ""), values.get("itemprop", "")}
    return bool(names & _CONTENT) or values.get("role") == "main" or values.get("itemprop") == "articlebody"


def _furniture(name: str, attributes: str, content: bool) -> bool:
    if name in _OFF or name == "header":
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    values = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
    words = set(re.split(r"[^a-z0-9]+", f"{values.get('class', '')} {values.get('id', '')}".lower()))
    if name == "article":
        return bool(words & _ARTICLE_HINTS)
    if values.get("role", "").lower() in _ROLES or "comment" in values.get("itemprop", ""):
        return True
    if "display:none" in values.get("style", "").replace(" ", "") or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
        return True
    return bool(words & _HINTS)


def _tags(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Start and end of each comment and tag, in order. Whoever reads them may send the place to go
    on from. Every step ends at a ``>`` or at the next ``<``, so long tails without ``>`` cost
    their length once."""
    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end, tag = (len(page) if end < 0 else end + 3), None
        else:
            tag = _TAG.match(page, at, last + 1) if at < last else None
            if tag is None:
                at = page.find("<", at + 1)
                continue
            end = tag.end()
        moved = yield at, end, tag
        at = page.find("<", max(end, moved or 0))


def _ends(page: str) -> dict[str, list[int]]:
    """Places of the end tags of each element name."""
    out: dict[str, list[int]] = {}
    for tag in _END.finditer(page):
        out.setdefault(tag[1].lower(), []).append(tag.start())
    return out


def page_blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; zones: article, main, open, furniture."""
    blocks: list[tuple[str, str]] = []
    parts: list[str] = []
    off, depth = None, 0           # the furniture element that is open, and how many of its name
    headed = False                 # it is a header, whose headings an article keeps
    articles = mains = heading = 0
    inside, inner = None, 0        # the plain element that is marked as content, likewise
    ends = _ends(page)

    def next_end(name: str, at: int) -> int:
        places = ends.get(name, ())
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            zone = "article" if articles else "main" if mains or inside else "open"
            blocks.append((zone if off is None or heading else "furniture", text))

    at, tags, moved = 0, _tags(page), None
    while True:
        try:
            start, stop, tag = tags.send(moved)
        except StopIteration:
            parts.append(page[at:])
            break
        parts.append(page[at:start])
        at, moved = stop, None
        if tag is None:
            continue
        end, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name in _RAW and not end and not rest.endswith("/"):
            stop = next_end(name, at)
            if name == "title" or stop >= 0:
                moved = at = len(page) if stop < 0 else (page.find(">", stop) + 1 or len(page))
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            close()
        elif not end and off is None and rest and _furniture(name, rest, articles + mains > 0):
            close()
        if name in _VOID or rest.endswith("/"):
            continue
        if off is not None:
            if name == off:
                depth += -1 if end else 1
                if depth == 0:
                    off = None
                    heading = 0
            elif headed and (articles or mains or inside) and re.fullmatch("h[1-6]", name):
                heading = 0 if end else 1  # an article's own heading
            continue
        if not end and _furniture(name, rest, articles + mains > 0):
            if next_end(name, at) >= 0:  # one that never ends hides nothing
                off, depth = name, 1
                headed = name == "header" or "header" in rest.lower()
        elif inside is None and not end and _marked_content(name, rest):
            inside, inner = name, 1
        elif name == inside:
            inner += -1 if end else 1
            if inner == 0:
                inside = None
        elif name == "article":
            articles = max(0, articles + (-1 if end else 1))
        elif name == "main":
            mains = max(0, mains + (-1 if end else 1))
    close()
    return blocks


def content_zones(blocks: list[tuple[str, str]]) -> set[str]:
    """The zones that are a page's content: articles, with what else main holds where that is
    more text than the articles have; none where the page marks neither."""
    size = {z: sum(len(t) for of, t in blocks if of == z) for z in ("article", "main")}
    if size["article"] and size["article"] >= size["main"]:
        return {"article"}
    return {"article", "main"} if size["main"] else set()


def run_hashes(texts: list[str], run: int = RUN) -> np.ndarray:
    """Hash of each run of ``run`` tokens of the texts' joint stream, the whole stream if shorter."""
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    words = word_hashes(raw, starts, ends, lower=False)
    run = min(run, len(words))
    out = np.zeros(len(words) - run + 1, np.uint64)
    for j in range(run):
        out = mix(out + words[j:len(words) - run + 1 + j] + np.uint64(j + 1))
    return out.view(np.int64)


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, host, marked, blocks, free, runs, asks): the blocks of the content of pages that
    mark it, else the open ones; which of them are of no article; the runs outside of content; and the
    runs that may clean the blocks: all of an open page's stream, the first of each free block of content."""
    schema = ("page_id long, url string, key long, host string, marked boolean, blocks array<string>, "
              "free array<boolean>, runs array<long>, asks array<long>")
    page_html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")),
                                    r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.xxhash64("page_id", "url", page_html).alias("key"),
                        host.alias("host"), page_html.alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, kept, free, runs, asks = [], [], [], [], []
            for i in range(batch.num_rows):
                blocks = page_blocks(batch.column(4)[i].as_py())
                zone = content_zones(blocks)
                own = [(z != "article", t) for z, t in blocks if z in (zone or {"open"})]
                rest = run_hashes([t for z, t in blocks if z != "furniture" and z not in zone])
                marked.append(bool(zone))
                kept.append([t for _, t in own])
                free.append([f for f, _ in own])
                runs.append(np.unique(np.concatenate([run_hashes([t for z, t in blocks if z == "furniture"]), rest])))
                heads = block_heads([t for f, t in own if f]) if zone else []
                asks.append(np.array(sorted({h for h in heads if h is not None}), np.int64) if zone else np.unique(rest))
            lists = [pa.array(kept, pa.list_(pa.string())), pa.array(free, pa.list_(pa.bool_())),
                     *(pa.array(x, pa.list_(pa.int64())) for x in (runs, asks))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(marked, pa.bool_()), *lists],
                                             names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(parse, schema)


def block_heads(blocks: list[str], run: int = RUN) -> list[int | None]:
    """The hash of each block's first run; None for a block of fewer tokens."""
    heads = [b.split(" ", run)[:run] for b in blocks]
    return [int(run_hashes([" ".join(h)], run)[0]) if len(h) == run else None for h in heads]


def without_covered(blocks: list[str], free: list[bool], repeated: set[int], run: int = RUN) -> list[str]:
    """Blocks of content without those ``free`` ones that repeated runs cover wholly, unless these are
    more than half of its tokens."""
    kept = [b for b, f, h in zip(blocks, free, block_heads(blocks, run), strict=True)
            if not f or h not in repeated or not repeated.issuperset(run_hashes([b], run).tolist())]
    tokens = [sum(b.count(" ") + 1 for b in x) for x in (kept, blocks)]
    return kept if 2 * tokens[0] >= tokens[1] else blocks


def unique_runs(blocks: list[str], repeated: set[int], run: int = RUN) -> str:
    """The blocks without the tokens that repeated runs cover; what is left keeps its blocks."""
    tokens = [t.split() for t in blocks]
    sizes = [len(t) for t in tokens]
    hashes = run_hashes(blocks, run)
    hit = np.isin(hashes, np.fromiter(repeated, np.int64, len(repeated)))
    n = sum(sizes)
    edge = np.zeros(n + 1, np.int64)
    width = min(run, n)
    edge[np.flatnonzero(hit)] += 1
    np.subtract.at(edge, np.flatnonzero(hit) + width, 1)
    covered = np.cumsum(edge)[:n] > 0
    out, at = [], 0
    for words, size in zip(tokens, sizes, strict=True):
        kept = [w for w, c in zip(words, covered[at:at + size], strict=True) if not c]
        at += size
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def main_text(pages: DataFrame, least_pages: int = PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Runs are counted over all pages of a host, summed before the shuffle, so a host with most
    of the pages is no hot task. Defined cases: a null or empty html has an empty text; a null
    url belongs to the empty host; repeated rows give the same text each, and count as one
    page; no pages give no rows; other columns are not read; pages of any length are read whole.
    """
    parsed = written(parse_pages(pages), "parsed")
    repeated = (parsed.select("host", "key", F.explode("runs").alias("run")).distinct()
                .groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= least_pages).select("host", "run"))
    repeated = written(repeated, "repeated")

    def found(asked: DataFrame) -> DataFrame:
        """(key, found): those runs of a page that are repeated ones of its host."""
        hits = asked.distinct().join(repeated, ["host", "run"], "left_semi")
        return written(hits.groupBy("key").agg(F.collect_set("run").alias("found")), "found")

    def hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
        """The rows with what was found for them; others are left out before texts move."""
        return rows.join(small(hits.select("key")), "key", "left_semi").join(hits, "key")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, host, blocks, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = [run_hashes([b]) for b, h in zip(blocks, block_heads(blocks), strict=True) if h in hits]
                runs = np.unique(np.concatenate(runs))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.int64()), pa.array([host] * len(runs), pa.string()),
                                                  pa.array(runs, pa.int64())], names=["key", "host", "run"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(without_covered(b, free, set(f))) if m else unique_runs(b, set(f or ()))
                     for m, b, free, f in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    asks = lambda rows: rows.select("key", "host", F.explode("asks").alias("run"))
    marked, unmarked = parsed.where("marked"), parsed.where("NOT marked")
    # content whose blocks begin with a repeated run is asked about all runs of these blocks
    begun = found(asks(marked))
    covered = found(hit(marked, begun).select("key", "host", "blocks", "found")
                    .mapInArrow(rest, "key long, host string, run long"))
    columns = ["page_id", "url", "marked", "blocks", "free", "found"]
    rows = (unmarked.join(found(asks(unmarked)), "key", "left").select(*columns)
            .unionByName(hit(marked, covered).select(*columns)))
    cleaned = rows.mapInArrow(clean, "page_id long, url string, text string")
    whole = marked.join(small(covered.select("key")), "key", "left_anti").select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    return whole.unionByName(cleaned).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
