"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of inline content between block-level tags, each with its
root-to-leaf path of block-level tags.  Per path, text length (linked text counts little) and
punctuation are averaged over its blocks; the two ratios are fused into a score, smoothed over
neighbouring blocks in page order to at most twice itself, and paths whose blocks reach a share of the page's best score are content.  Paths through
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, known by tag, role,
class or id, score zero; within an article a class or id must name such a thing (``cookie-notice``, ``ad-slot``), not
only mention it (``notice-of-meeting``).  Content blocks name the region: their article or main elements, or
without such the smallest element around them with the headings that lead up to it.  All of the region but
zero-score paths is the text; nothing else of it is dropped.  Memory is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import table

SHARE = 0.1         # of the best smoothed score that a content path reaches
LINKS = 0.5         # share of linked text above which a low-scoring block outside articles is a menu
ARTICLE_PRIOR = 4.0
_LINK_REACH = 3     # a link and two elements within it

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(script|style|template|textarea|iframe|noscript|title|svg|object|select|xmp|annotation|annotation-xml)\b(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")

_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp "
                    "small span strike strong sub sup time tt u var wbr "
                    # formulas
                    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
                    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                      "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
_HOLDERS = frozenset("ul ol dl table body html article main div section".split())
_REGION = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROP_TAGS = frozenset("nav footer aside form menu button head dialog fieldset".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer comment comments disqus replies reply respond cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "widget toolbar pagination pager copyright disclaimer banner".split())
#: Words that tell where or in what form a thing is, not what it is.
_FORM_WORDS = frozenset(
    "area bar block body bottom box button buttons card center col column container content form group header icon icons inner item items "
    "label left link links list main outer panel posts right row section slot text thread title top unit wrap wrapper".split())
_HEADERS = frozenset("header masthead topbar".split())


class _Element:
    """An open element; ``block``, ``path`` and ``held`` (dropped) are of the innermost block-level one."""

    __slots__ = ("block", "dropped", "held", "linked", "name", "path", "region")

    def __init__(self, name: str, block: int = 0, path: int = 0, region: int = 0, dropped: bool = False, held: bool = False, linked: int = 0) -> None:
        self.name, self.block, self.path, self.region, self.dropped, self.held, self.linked = name, block, path, region, dropped, held, linked


class Block(NamedTuple):
    text: str
    path: int           # number of its root-to-leaf path of block-level tags
    element: int        # the innermost block-level element
    region: int         # the outermost article or main element, 0 without
    dropped: bool
    linked: float       # share of linked text
    heading: bool


def _names(words: list[str]) -> bool:
    """Whether the words of a class name something to drop: the last one does, or all but words of form do."""
    said = [w for w in words if w not in _FORM_WORDS and not w.isdigit()]
    return bool(said) and (words[-1] in _DROP_WORDS or all(w in _DROP_WORDS for w in said))


def _is_dropped(name: str, attributes: str, in_region: bool) -> bool:
    if name in _DROP_TAGS or name == "header" and not in_region:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value.lower() in _DROP_ROLES:
            return True
        if key in ("class", "id"):
            for one in value.split():
                ways = [[w.lower() for w in _SPLIT.split(x) if w] for x in (one, one.lower())]
                words = {w for way in ways for w in way}
                if any(map(_names, ways)) if in_region else words & (_DROP_WORDS | _HEADERS):
                    return True
    return False


def blocks_of(html: str) -> tuple[list[Block], list[int]]:
    """The blocks in page order, and for each block-level element the number of the one around it."""
    stack, blocks, at = [_Element("")], [], 0
    around, opened = [0], Counter()
    paths: dict[tuple[int, str], int] = {}
    headings = [False]
    parts: list[str] = []
    linked = [0]

    def flush() -> None:
        if parts:
            text = _WHITE.sub(" ", unescape("".join(parts))).strip(" ")
            parts.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.path, top.block, top.region, top.held, min(1.0, linked[0] / len(text)), headings[top.path]))
        linked[0] = 0

    def add(raw: str) -> None:
        if not stack[-1].dropped:
            parts.append(raw)
            if stack[-1].linked:
                linked[0] += len(raw)

    def close(names: tuple[str, ...] | str, until: frozenset = _HOLDERS) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                if any(e.name not in _INLINE for e in stack[k:]):
                    flush()
                opened.subtract(e.name for e in stack[k:])
                del stack[k:]
                return
            if stack[k].name in until:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name == "br":
                add(" ")
            elif opened[name] > 0:
                close((name,), frozenset() if name not in _INLINE else _HOLDERS)
            continue
        if name not in _INLINE:
            if name in _CLOSES_P:
                close(("p",))
            if name in _SIBLINGS:
                close(_SIBLINGS[name])
            flush()
        elif name == "br":
            add(" ")
        if name in _VOID:
            continue
        top = stack[-1]
        attributes = m[4]
        if attributes.rstrip().endswith("/") and name not in _CLOSES_P:
            continue
        dropped = top.dropped or _is_dropped(name, attributes, top.region > 0)
        links = _LINK_REACH if name == "a" else max(0, top.linked - 1)
        opened[name] += 1
        if name in _INLINE:
            if dropped and not top.dropped:
                add(" ")
            stack.append(_Element(name, top.block, top.path, top.region, dropped, top.held, links))
            continue
        around.append(top.block)
        path = paths.setdefault((top.path, name), len(headings))
        if path == len(headings):
            headings.append(name in _HEADINGS)
        region = len(around) - 1 if name in _REGION and not dropped and not top.region else top.region
        stack.append(_Element(name, len(around) - 1, path, region, dropped, dropped, links))
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!]", rest)     # a tag the page ends in
        add(rest[:cut.start()] if cut else rest)
    flush()
    return blocks, around


def path_scores(blocks: list[Block]) -> list[float]:
    """The smoothed, fused score of each block's path."""
    totals: dict[tuple, list[float]] = {}
    for text, path, _, region, dropped, linked, _ in blocks:
        sums = totals.setdefault((path, region > 0, dropped), [0, 0.0, 0])
        sums[0] += 1
        sums[1] += len(text) * (1.05 - linked)
        sums[2] += len(_PUNCTUATION.findall(text))
    fused = {}
    for key, (n, chars, marks) in totals.items():
        fused[key] = 0.0 if key[2] else (chars / n) * (1 + marks / n) * (ARTICLE_PRIOR if key[1] else 1.0)
    raw = [fused[path, region > 0, dropped] for _, path, _, region, dropped, *_ in blocks]
    padded = [raw[0], *raw, raw[-1]] if raw else []
    smooth = [(padded[k] + 2 * padded[k + 1] + padded[k + 2]) / 4 for k in range(len(raw))]
    return [min(s, 2 * r) for s, r in zip(smooth, raw, strict=True)]


def _region_around(blocks: list[Block], core: list[int], around: list[int]) -> list[bool]:
    """Of each block whether it lies in the smallest element around the core, or in headings that lead up to that."""
    holder = blocks[core[0]].element
    for k in core[1:]:
        other = blocks[k].element
        while holder != other:      # an element has a larger number than the one around it
            holder, other = (around[holder], other) if holder > other else (holder, around[other])
    inside = [False] * len(around)
    for element, parent in enumerate(around):
        inside[element] = element == holder or element > holder and inside[parent]
    chosen = [inside[b.element] for b in blocks]
    above, up = {0}, holder
    while up:
        above.add(up)
        up = around[up]
    first, led = chosen.index(True), -1
    for k in range(first - 1, -1, -1):
        b = blocks[k]
        if b.dropped or b.linked > LINKS or led >= 0 and not b.heading:
            break
        if b.heading:
            if around[b.element] not in above:
                break
            led = k
    if led >= 0:
        chosen[led:first] = [True] * (first - led)
    return chosen


def main_text(html: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    blocks, around = blocks_of(html)
    scores = path_scores(blocks)
    best = max(scores, default=0.0)
    if best == 0.0:
        return []
    core = [k for k, s in enumerate(scores) if s >= SHARE * best]
    regions = {blocks[k].region for k in core if blocks[k].region}
    if regions:
        return [b.text for b in blocks if b.region in regions and not b.dropped]
    chosen = _region_around(blocks, core, around)
    return [b.text for b, s, c in zip(blocks, scores, chosen, strict=True) if c and not b.dropped and (s >= SHARE * best or b.linked <= LINKS)]


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id, url, text, n_chars, n_blocks``.

    The whole html is read.  Character references are decoded, white space (``\\x20``, ``\\x09``-``\\x0D``) inside a block becomes
    one space, blocks are trimmed and joined by newlines.  Null or empty html, and pages without
    main text, give an empty text.  Very long and deeply nested pages take memory linear in their length.  Unclosed, misnested and cut-off tags close as in browsers.
    Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) if x else [] for x in batch.column("html").to_pylist()]
            texts = ["\n".join(x) for x in found]
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in found], pa.int64())],
                                  names=["id", "url", "text", "n_chars", "n_blocks"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, "id long, url string, text string, n_chars long, n_blocks long")
    return out.toDF(id_col, url_col, "text", "n_chars", "n_blocks")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
