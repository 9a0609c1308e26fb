"""Main text of web pages by tag-path ratios.

A page is a tree of tag paths. The text on a path, less that of links, for each of its
blocks is its ratio, fused with punctuation and smoothed with the paths of the same
container. Names and classes that speak of menus, adverts and the like, and article
elements, are features beside the ratios: where most of a page's mass lies under such a
class, the ratios overrule it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big center cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom merror menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements outside of articles that may lack their end tag; only up to that tag, and not over one of _BREAKS, are they left out as one.
_APART = frozenset("noscript template svg object select option button".split())
_BREAKS = re.compile(r"<(?:/?(?:article|main|section|body)|p|h[1-6])(?=[\s>/])", re.I)
#: Start tags that end an open element of the kinds that hold no paragraphs, or one that is never closed.
_ENDS = frozenset("article main section p h1 h2 h3 h4 h5 h6".split())
_NO_BLOCKS = frozenset("svg select option button".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements whose paragraphs are their own, whatever they are in.
_HOLDS = _CLOSES_P | frozenset("html body li dd dt tr td th foreignobject template".split())
_CONTAINERS = frozenset("html body article main section div td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What surrounds an article, by element or role; reader comments, by words in class or id, unless the page's own article lies below.
_OUTSIDE = frozenset("nav footer aside menu dialog head noscript template svg object select option button".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_COMMENT_WORDS = frozenset("comment comments disqus respond".split())
#: Elements, and words in class or id, that say the same unless the ratios overrule them; words before which they say nothing.
_DOUBTFUL = frozenset("header form".split())
_DOUBTFUL_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
_NEGATING = frozenset("has no not with without".split())
#: Elements whose classes say nothing of where their text belongs.
_ROOTS = frozenset("html body main article".split())

_OPEN = re.compile(r"<(?:(!--)|[!?]|/[^a-zA-Z]|(/?)([a-zA-Z][^\s/>]*))")
_REST_OF_TAG = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: One attribute after the other, each with its value, so that no value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPACE = re.compile(r"\s+")
_END_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_END_APART = re.compile(rf"</({'|'.join(sorted(_APART))})\s*>", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: Weight of a path's own ratio against its container's, and the share of the page's mean that content must reach.
SMOOTH, THRESHOLD = 0.5, 0.5
#: What lying in the page's article adds to a path's ratio, and lying outside of it takes off, in shares of the mean.
ARTICLE, BESIDE = 0.5, 1.5
#: Share of the page's mass that overrules a doubtful element, makes an article the page's, and of text in links that makes a path a menu.
OVERRULE, DOMINANT, LINKS = 0.5, 0.3, 0.5
#: Share of the mass of a page without articles and headings that overrules a word for comments, and with which an article that has the first heading is the page's.
ALONE, HEADED = 0.8, 0.1

_INSIDE, _MAYBE, _OUT, _COMMENTS = range(4)


@dataclass
class Tree:
    """Tag paths as nodes, each after its parent, and the blocks of text in page order: (node, text, characters in links)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    says: list[int] = field(default_factory=lambda: [_INSIDE])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    known: dict[tuple[int, str, int], int] = field(default_factory=dict)

    def child(self, node: int, name: str, step: str, says: int) -> int:
        key = (node, step, says)
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(node)
            self.name.append(name)
            self.says.append(says)
        return self.known[key]


def _marks(attributes: str) -> dict[str, str]:
    """The attributes that count, by name; of several of one name the first."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "hidden"):
            found.setdefault(name, "".join(values).lower())
    return found


def _says(name: str, marks: dict[str, str], in_article: bool = False) -> int:
    """What an element's name, role and classes say of its text. In an article a header is the article's own."""
    if name in _OUTSIDE or "hidden" in marks or marks.get("role") in _OUTSIDE_ROLES:
        return _OUT
    words = [[p for p in re.split(r"[-_]+", word) if p] for word in f"{marks.get('class', '')} {marks.get('id', '')}".split()]
    words = [parts for parts in words if not _NEGATING.intersection(parts)]
    if name in _ROOTS:
        return _COMMENTS if name == "article" and any("comment" in parts for parts in words) else _INSIDE
    said = _MAYBE if name in _DOUBTFUL and not (in_article and name == "header") else _INSIDE
    for parts in words:
        if _COMMENT_WORDS.intersection(parts):
            return _COMMENTS
        if _DOUBTFUL_WORDS.intersection(parts).difference(("header",) if in_article else ()):
            said = _MAYBE
    return said


def tree_of(page: str) -> Tree:
    """The tag paths and blocks of a page, in one pass over it."""
    tree = Tree()
    stack: list[tuple[str, int]] = []  # element, node
    count: Counter[str] = Counter()  # of open elements
    words: list[str] = []
    links, in_link = 0, False
    at, size = 0, len(page)
    ends: dict[str, list[int]] = {}
    for m in _END_APART.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.start())
    breaks = [m.start() for m in _BREAKS.finditer(page)] if ends else []

    def flush():
        nonlocal links
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                tree.blocks.append((stack[-1][1] if stack else 0, text, min(links, len(text))))
        links = 0

    def cut(k: int):
        for name, _ in stack[k:]:
            count[name] -= 1
        del stack[k:]

    while at < size:
        m = _OPEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            words.append(page[at:stop])
            links += stop - at if in_link else 0
        if not m:
            break
        at = m.end()
        if m[1] or not m[3]:  # a comment, or what counts as one
            end = page.find("-->" if m[1] else ">", at if m[1] else stop)
            at = size if end < 0 else end + (3 if m[1] else 1)
            continue
        rest = _REST_OF_TAG.match(page, at)
        if not rest:
            break
        at, name, closing, attributes = rest.end(), m[3].lower(), bool(m[2]), rest[1]
        if name == "a":
            in_link = not closing
        if name in _INLINE:
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                end = _END_RAW[name].search(page, at)
                at = end.end() if end else size
            continue
        if name in _APART and not closing:
            if name == "svg" and attributes.endswith("/"):
                continue
            k = bisect_left(ends.get(name, ()), at)
            if k < len(ends.get(name, ())):
                end, b = ends[name][k], bisect_left(breaks, at)
                if b == len(breaks) or breaks[b] >= end:
                    at = page.index(">", end) + 1
                    continue
        flush()
        if closing:
            if count[name]:
                cut(max(k for k in range(len(stack)) if stack[k][0] == name) if stack[-1][0] != name else len(stack) - 1)
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if name in _ENDS and any(count[x] for x in _APART):
            for k in range(len(stack) - 1, -1, -1):
                holder = stack[k][0]
                if holder in _APART and (holder in _NO_BLOCKS or ends.get(holder, [-1])[-1] < at):
                    cut(k)
                elif holder in _HOLDS:
                    break
        for other in _SAME.get(name, ()):
            if stack and stack[-1][0] == other:
                cut(len(stack) - 1)
        marks = _marks(attributes) if attributes.strip() else {}
        step = ".".join([name, *marks.get("class", "").split()])
        stack.append((name, tree.child(stack[-1][1] if stack else 0, name, step, _says(name, marks, count["article"] > 0))))
        count[name] += 1
    flush()
    return tree


def _sums(tree: Tree, of_node: np.ndarray) -> np.ndarray:
    """The sum over each node and all below it."""
    total = of_node.tolist()
    for node in range(len(total) - 1, 0, -1):
        total[tree.parent[node]] += total[node]
    return np.array(total)


def _inherited(tree: Tree, own: np.ndarray) -> np.ndarray:
    """Whether a node or one above it is marked."""
    marked = own.tolist()
    for node in range(1, len(marked)):
        marked[node] = marked[node] or marked[tree.parent[node]]
    return np.array(marked)


def _comments(tree: Tree, says: np.ndarray, mass: np.ndarray, articles: np.ndarray, headings: np.ndarray) -> np.ndarray:
    """Which nodes hold reader comments: those with words for them, but for those around the page's own article.

    An article or a first heading belongs to the nearest such node above it, or to none. A node of that kind
    is the article's if it holds one, and no heading and no article of as much mass is free of them.
    """
    worded = says == _COMMENTS
    if not worded.any():
        return worded
    n = len(says)
    nearest, doubtful = np.zeros(n, int), _inherited(tree, (says == _OUT) | (says == _MAYBE))
    for node in range(1, n):
        nearest[node] = node if worded[node] else nearest[tree.parent[node]]
    articles, headings = articles & ~worded & ~_inherited(tree, says == _OUT), headings & ~_inherited(tree, says == _OUT)
    free = (nearest == 0) & ~doubtful
    free_mass, free_heading = mass[free & articles].max(initial=0.0), (free & headings).any()
    anything = articles.any() or headings.any()
    overruled = np.zeros(n, bool)
    for node in np.flatnonzero(worded):
        own = nearest == node
        if not anything:
            holds, most = mass[node] > ALONE * mass[0], mass[node]
        else:
            holds, most = (own & (articles | headings)).any(), mass[own & articles].max(initial=0.0) or mass[node]
        if holds and not free_heading and most > free_mass:
            while node > 0:
                overruled[node] = True
                node = tree.parent[node]
    return worded & ~overruled


def content_blocks(tree: Tree) -> np.ndarray:
    """Which blocks are content."""
    n = len(tree.parent)
    of = np.array([b[0] for b in tree.blocks])
    size = np.array([len(b[1]) for b in tree.blocks], float)
    links = np.bincount(of, [b[2] for b in tree.blocks], n)
    marks = np.bincount(of, [len(_PUNCTUATION.findall(b[1])) for b in tree.blocks], n)
    times, chars = np.bincount(of, minlength=n), np.bincount(of, size, n)
    each = np.maximum(times, 1)
    ratio = (chars - links) / each * np.log1p(1 + marks / each)
    says = np.array(tree.says)
    out = _inherited(tree, says == _OUT)
    named = np.array([name in ("article", "main") for name in tree.name])
    first_heading = np.array([name == "h1" for name in tree.name]) & (times > 0)
    comments = _comments(tree, says, _sums(tree, np.where(out, 0, ratio * times)), named, first_heading)
    apart = (says == _OUT) | comments
    out = _inherited(tree, apart)
    mass = _sums(tree, np.where(out, 0, ratio * times))
    articles = _sums(tree, (named & (_sums(tree, np.where(out, 0, times)) > 0)).astype(int))
    overruled = (mass > OVERRULE * mass[0]) & ((articles > 0) | (articles[0] == 0) | _inherited(tree, named))
    out = _inherited(tree, apart | ((says == _MAYBE) & ~overruled))
    inside = (times > 0) & ~out
    if not inside.any():
        return np.zeros(len(of), bool)
    mean = float((ratio * chars)[inside].sum() / max(chars[inside].sum(), 1))

    # the nodes' containers, and the mean ratio on the paths of each
    holder = np.zeros(n, int)
    for node in range(1, n):
        holder[node] = node if tree.name[node] in _CONTAINERS else holder[tree.parent[node]]
    weight = np.where(inside, times, 0)
    level = (np.bincount(holder, ratio * weight, n) / np.maximum(np.bincount(holder, weight, n), 1))[holder]
    smooth = SMOOTH * ratio + (1 - SMOOTH) * level

    menu = links > LINKS * chars
    mass = _sums(tree, np.where(inside, ratio * times, 0))
    headed = _sums(tree, (first_heading & inside).astype(int)) > 0
    chosen = named & (mass > 0) & ((mass >= DOMINANT * mass[0]) | (headed & (mass >= HEADED * mass[0])))
    narrow = chosen & np.array([name == "article" for name in tree.name])
    article = _inherited(tree, narrow if narrow.any() else chosen)
    bonus = np.where(article, ARTICLE, -BESIDE) if article.any() else np.zeros(n)
    good = inside & ~menu & (smooth + bonus * mean >= THRESHOLD * mean)
    # what lies in a container that holds content goes with it
    own = np.zeros(n, bool)
    own[holder[good]] = True
    own &= np.array([name not in ("", "html", "body") for name in tree.name])
    good |= inside & ~menu & (_inherited(tree, own) | own[holder])
    in_body = np.zeros(n, bool)
    in_body[holder[good]] = True
    good |= inside & ~menu & in_body[holder]
    keep = good[of]
    heading = np.array([tree.name[node] in _HEADINGS for node in of]) & inside[of]
    for k in range(len(keep) - 2, -1, -1):  # a heading goes with what follows it
        keep[k] |= heading[k] and keep[k + 1]
    return keep


def main_text(page: str | None) -> str:
    """Text of a page's content blocks, joined by empty lines."""
    tree = tree_of(page or "")
    if not tree.blocks:
        return ""
    return "\n\n".join(b[1] for b, k in zip(tree.blocks, content_blocks(tree)) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    pages: page_id, url, html; further columns, whatever their names, are left out. A
    null or empty html, or one without content, has an empty text; an empty table gives
    no rows. Each page is read whole and by itself in time that grows with its length,
    so nothing is shuffled and repeated pages give repeated rows; null ids and urls stay
    null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
