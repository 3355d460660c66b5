"""Main text of web pages: page structure, and repeats over the pages of a host where structure says nothing.

A page is cut into blocks. Structure decides the clear ones: blocks of an article or main element stay, blocks of menus,
headers, footers, sidebars, notices, adverts, forms and reader comments go. What lies outside any article without such
a mark is open. For open blocks the token streams outside articles of all pages of a host are taken together; their
suffixes are grouped by their first tokens, and a suffix found on distinct pages with distinct html marks its tokens as
boilerplate; no suffix array is built (the README says why). Longer repeats are chains of such suffixes. Covered tokens are removed
and unique runs stay.

The groups are formed by a shuffle on (host, leading tokens) that combines before it, so a large host is no large task.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import store
from .fast_bpe import small_batches
from .url_filter import split_url
from .wordstream import gram_hashes, text_chunks, words_of

DEPTH = 8  # tokens that a repeated run has at least

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "select", "button", "audio", "video", "xmp"}
_CONTAINERS = {"article", "main", "nav", "header", "footer", "aside", "form", "div", "section", "ul", "ol", "dl", "table", "figure", "blockquote",
               "dialog", "details", "fieldset", "menu", "body", "head", "search"}
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "address",
                         "figcaption", "hr", "html", "summary", "center", "option", "legend", "label"}
_GONE = {"nav", "footer", "aside", "form", "dialog", "head", "menu", "search", "fieldset"}
_SURE = {  # class names that tell what an element is for even inside an article
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "gdpr", "popup",
    "newsletter", "subscribe", "signup", "login", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing",
    "comment", "comments", "commentlist", "disqus",
}
_MARKS = _SURE | {  # names that tell it outside articles only: inside they also name sections of the text
    "banner", "consent", "notice", "notices", "notification", "alert", "modal", "overlay", "menu", "sidebar", "complementary", "contentinfo", "footer",
    "masthead", "toolbar", "social", "reply", "replies", "respond", "discussion", "related", "recommended", "widget", "search", "skip", "copyright",
    "disclaimer", "hidden",
}
_NEUTRAL = {"site", "page", "global", "primary", "secondary", "top", "bottom", "left", "right", "area", "block", "box", "container", "wrapper", "wrap", "list",
            "bar", "link", "links", "buttons", "form", "inner", "outer", "slot", "unit", "section", "post", "posts", "articles", "media"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
_HEADING = re.compile(r"h[1-6]\Z")


def _names(value: str, marks: set[str]) -> bool:
    """Whether a name (of a class, an id) is a mark as a whole: beside marks it has neutral words and numbers only."""
    for name in value.split():
        words = [w for w in re.split(r"[-_0-9]+", name) if w]
        if not marks.isdisjoint(words) and all(w in marks or w in _NEUTRAL for w in words):
            return True
    return False


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """``inside`` an article or main, ids and labels name parts of the text and don't count, nor do loose class names."""
    for attribute, value in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), value.strip("\"'").lower()
        if attribute == "hidden" or (attribute == "aria-hidden" and value == "true") or (attribute == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if _HEADING.match(name):
            continue
        if attribute == "role" and not _ROLES.isdisjoint(value.split()):
            return True
        if attribute == "class" and _names(value, _SURE if inside else _MARKS):
            return True
        if not inside and (attribute == "id" and _names(value, _MARKS) or attribute == "aria-label" and value.strip() in _MARKS):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order. Zones: c (article), o (open), b (boilerplate by structure)."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that matter: (name, zone inside)
    opened: Counter[str] = Counter()  # how many of each name are on the stack: closing tags of others are passed over at once
    zone, at, end = "o", 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((zone, text))

    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            parts.append(page[at:])
            break
        parts.append(page[at:tag.start()])
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:  # comment or declaration: separates nothing
            continue
        name = name.lower()
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end if name in ("script", "style") else at
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in _BLOCKS
        if block:
            flush()
        if closing:
            if opened[name]:
                if not block:
                    flush()
                gone = ""
                while gone != name:
                    gone, _ = stack.pop()
                    opened[gone] -= 1
                zone = stack[-1][1] if stack else "o"
            continue
        if block and stack and stack[-1][0] in ("p", "li") and (name == stack[-1][0] or stack[-1][0] == "p"):
            opened[stack.pop()[0]] -= 1  # an open paragraph ends where the next block starts
            zone = stack[-1][1] if stack else "o"
        if attributes.endswith("/"):
            continue
        marked = bool(attributes.strip()) and _marked(name, attributes, zone == "c")
        if name == "body":
            stack.clear()
            opened.clear()
            zone = "o"
        elif name == "main" or (name == "article" and not marked and not any(z == "b" and n not in ("nav", "header", "div", "ul") for n, z in stack)):
            zone = "c"
        elif name in _GONE or marked or (name == "header" and zone != "c"):
            if not block:
                flush()
            zone = "b"
        elif name not in _CONTAINERS:
            continue
        if name != "body":
            stack.append((name, zone))
            opened[name] += 1
    flush()
    return out


def _parse(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts, zones, kept, streams = [], [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page or "")
            outside = [(z, t) for z, t in found if z != "c"]
            streams.append(" ".join(t for _, t in outside))
            if any(z == "o" for z, _ in outside):
                texts.append(None)
                zones.append([z for z, _ in found])
                kept.append([t for _, t in found])
            else:
                texts.append("\n".join(t for z, t in found if z == "c"))
                zones.append(None)
                kept.append(None)
        grams: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            for _, data, bounds in text_chunks(pa.array(streams, pa.string())):
                words = words_of(data, bounds, lower=False)
                h, ok = gram_hashes(words, depth)
                for row in range(len(bounds) - 1):
                    a, b = words.first[row], max(words.first[row], words.first[row + 1] - depth + 1)
                    grams.append(h[a:b].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), batch.column("page"), batch.column("digest"), pa.array(texts, pa.string()),
             pa.array(zones, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.string())), pa.array(grams, pa.list_(pa.int64()))],
            ["page_id", "url", "host", "page", "digest", "text", "zones", "texts", "grams"])


def _cut(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for zones, texts, starts in zip(*(batch.column(c).to_pylist() for c in ("zones", "texts", "covered"))):
            count = sum(len(t.split()) for z, t in zip(zones, texts) if z != "c")
            gone = np.zeros(count + 1, bool)
            for s in starts or []:
                gone[s:s + depth] = True
            lines, at = [], 0
            for z, t in zip(zones, texts):
                if z == "c":
                    lines.append(t)
                    continue
                words = t.split()
                if z == "o":
                    line = " ".join(w for k, w in enumerate(words) if not gone[at + k])
                    if line:
                        lines.append(line)
                at += len(words)
            out.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html); other columns are ignored.

    Null and empty html give an empty text. Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one line feed in page order. Markup cut off at the end counts as markup. Rows stay as
    they are, repeats included; rows of equal id and URL are one page and rows of equal html are copies, so neither make
    each other boilerplate, and of crawls of one page with unlike html each loses only its own repeats. Pages without a host share the empty one. A host with one page has no repeats, its open blocks stay. An empty table gives
    no rows.
    """
    host, _ = split_url(F.col("url"))
    id_type = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", host.alias("host"), F.xxhash64("page_id", "url").alias("page"), F.xxhash64("html").alias("digest"), "html")
    shape = f"page_id {id_type}, url string, host string, page long, digest long, text string, zones array<string>, texts array<string>, grams array<long>"
    parsed = store(rows.mapInArrow(lambda batches: _parse(batches, depth), shape))
    spots = parsed.select("host", "page", "digest", F.posexplode("grams").alias("pos", "gram"))
    repeated = spots.groupBy("host", "gram").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.min("digest").alias("d_lo"), F.max("digest").alias("d_hi"))
    repeated = repeated.where("lo <> hi and d_lo <> d_hi").select("host", "gram")
    open_ = parsed.where(F.col("text").isNull())
    open_spots = open_.select("host", "page", "digest", F.posexplode("grams").alias("pos", "gram")).distinct()
    # at most the row's own tokens: rows of one page with unlike html have places of their own
    covered = open_spots.join(store(repeated), ["host", "gram"]).groupBy("page", "digest").agg(F.collect_list("pos").alias("covered"))
    cut = open_.join(covered, ["page", "digest"], "left").select("page_id", "url", "zones", "texts", "covered")
    cut = cut.mapInArrow(lambda batches: _cut(batches, depth), f"page_id {id_type}, url string, text string")
    return parsed.where(F.col("text").isNotNull()).select("page_id", "url", "text").unionByName(cut)
