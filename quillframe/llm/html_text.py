"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text at block-level tags. A block has its number of words and share of words inside links, the same of the
block before and after it, and how it is marked up: whether it is a paragraph or a heading, inside an article, inside an element that is
boilerplate by its kind (a menu, a form, a footer), and inside one whose class or id says so. A decision tree, grown on the blocks of the
labelled pages in html_labels.py, says which blocks are main text.

References are decoded, runs of white space become one space, blocks are trimmed and joined by \\n in page order. Tags need not be closed or
nested rightly: a closing tag closes up to its own opening tag if that is open, else nothing; what is open at the end is closed. Scripts
and styles end at their own closing tag, comments at `-->`, or with the page. Work is linear in the page's length.

Defined cases: null and empty pages have an empty text. Rows may repeat. Null ids and urls stay null. Nothing is assumed of further columns,
which `extract` keeps; its own column is named `main_text`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from . import html_labels

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that begin and end a block of text.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never shown as part of a page's prose.
SILENT = set("script style noscript template svg math iframe object select textarea button option datalist canvas audio video head title".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BOILER = set("nav header footer aside form menu dialog".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of class names and ids of boilerplate. A name counts if it has such a part and all others are neutral: `comment-list`, not `share-of-market`.
BOILER_WORDS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
NEUTRAL_WORDS = set("area bar block body bottom box buttons center content col column container footer global group head inner item items left line links list main medium nav outer overlay page panel post posts primary right section site slot small sticky text top unit wp wrap wrapper".split())
#: Elements that another block of the same kind closes.
SELF_CLOSED = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "blockquote", "pre", "figcaption", "dd"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "paragraph", "heading", "article", "boiler", "marked")


@dataclass
class Node:
    feature: int
    value: float
    low: Node | bool
    high: Node | bool


def grow(rows: np.ndarray, depth: int = 12) -> Node | bool:
    """A tree by Gini impurity over the columns before the last; ties go to the first feature and lowest threshold."""
    y = rows[:, -1] > 0
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, cut, low = best
    return Node(f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))


def decide(tree: Node | bool, features: tuple) -> bool:
    while isinstance(tree, Node):
        tree = tree.low if features[tree.feature] <= tree.value else tree.high
    return tree


@dataclass
class Block:
    text: str
    words: int
    links: float
    kind: str
    article: bool
    boiler: bool
    marked: bool


NOTHING = Block("", 0, 0.0, "", False, False, False)


def _named_boiler(value: str) -> bool:
    for name in value.split():
        parts = [p for p in re.split("[^a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        if not BOILER_WORDS.isdisjoint(parts) and all(p in BOILER_WORDS or p in NEUTRAL_WORDS or len(p) == 1 for p in parts):
            return True
    return False


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its kind, and by its class or id."""
    boiler, marked = name in BOILER, False
    if not attributes or attributes.isspace() or name in ("html", "body", "main", "article"):
        return boiler, marked
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            marked = marked or _named_boiler(value)
        elif key == "role":
            boiler = boiler or value.strip().lower() in BOILER_ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value.lower()):
            boiler = True
    return boiler, marked


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # element, its kind of block, and article, boiler, marked and silent, with what its parents are
    stack: list[tuple[str, str, bool, bool, bool, bool]] = []
    opened: dict[str, list[int]] = {}  # places in the stack of each element's open tags
    root = ("", "", False, False, False, False)
    links = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            _, kind, article, boiler, marked, silent = stack[-1] if stack else root
            if text and not silent:
                linked = len(html.unescape("".join(t if x else " " for t, x in parts)).split())
                n = text.count(" ") + 1
                out.append(Block(text, n, min(1.0, linked / n), kind, article, boiler, marked))
            parts.clear()

    def close(depth: int) -> None:
        for name, *_ in stack[depth:]:
            opened[name].pop()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        silent = stack[-1][5] if stack else False
        if lt > at and not silent:
            parts.append((page[at:lt], links > 0))
        if lt == end:
            break
        m = TAG.match(page, lt)
        if not m:
            if not silent:
                parts.append(("&lt;", links > 0))
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "a":
            links = max(0, links - 1) if m[1] else 1
            continue
        if name == "br":
            parts.append((" ", links > 0))
            continue
        kept = name in BLOCKS or name in SILENT
        if name in BLOCKS:
            flush()
        if m[1]:
            if opened.get(name):
                if not kept:
                    flush()
                close(opened[name][-1])
            continue
        if name in VOID:
            continue
        for open_name, closers in SELF_CLOSED.items():
            if name in closers and stack and stack[-1][0] == open_name:
                close(len(stack) - 1)
        boiler, marked = _marks(name, m[3])
        if kept or boiler or marked:
            if not kept:
                flush()
            _, kind, in_article, in_boiler, in_marked, in_silent = stack[-1] if stack else root
            kind = "heading" if name in HEADINGS else "paragraph" if name in PARAGRAPHS else kind if name not in BLOCKS else ""
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, kind, in_article or name in ("article", "main"), in_boiler or boiler, in_marked or marked, in_silent or name in SILENT))
        if name in RAW:
            stop = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else end
    flush()
    return out


def featured(blocks: list[Block]) -> list[tuple]:
    """FEATURES of each block."""
    return [
        (b.words, b.links, before.words, before.links, after.words, after.links, b.kind == "paragraph", b.kind == "heading", b.article, b.boiler, b.marked)
        for before, b, after in zip([NOTHING, *blocks], blocks, [*blocks[1:], NOTHING], strict=False)
    ]


def labelled_blocks() -> np.ndarray:
    """FEATURES of all blocks of the labelled pages, then 1 for main text."""
    rows = []
    for page in html_labels.PAGES:
        blocks = blocks_of(html_labels.spelled(page))
        rows += [(*f, html_labels.is_main(b.text)) for f, b in zip(featured(blocks), blocks, strict=True)]
    return np.array(rows, float)


def main_text(page: str | None, tree: Node | bool) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, f in zip(blocks, featured(blocks), strict=True) if decide(tree, f))


def extract(pages: DataFrame, html_col: str = "html", labelled: np.ndarray | None = None) -> DataFrame:
    """pages with main_text, a new last column."""
    tree = grow(labelled_blocks() if labelled is None else labelled)
    place = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py(), tree) for x in b.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "main_text"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("main_text", StringType())]))
