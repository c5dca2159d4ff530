"""Main text of web pages by tag-path ratios.

A page is read once into a tree of its elements and blocks of text, each with its root-to-leaf tag path. Per path the
extractor aggregates text length, punctuation, link text and block count; the ratios of length and of punctuation to
blocks are smoothed over the blocks in page order and fused to a score. The scores choose one subtree on every page: the
deepest container that holds ``SHARE`` of the score, weighted by text, then outer ones as long as what they add passes the
threshold on the whole. Inside it only link lists face the threshold block by block, so that short items and headings of
the story stay.

Structure goes in beside the ratios. Elements that cannot be article text (``DROP_TAGS``, ``DROP_ROLES``, hidden ones) are
left out before counting, a ``header`` only outside the article. Class and id words are evidence: ``OFF_WORDS`` (adverts,
reader comments, consent and sign-up boxes) leave a subtree out; ``SIDE_WORDS`` (sidebar, menu, related, notice, ...) do so
unless the subtree has the article in it or more than half of the page's text outside links, which no side matter has.
``has-``, ``with-`` and the like make a word a state of the element, not its kind. A mark (``article``, ``main`` or
role=main, without such words) counts scores inside it ``MARK`` times in the choice of the subtree.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by two newlines. ``br`` is white space. Attributes follow the HTML tokenizer's rules; a tag that the page's end cuts
off is ignored. Time and memory are linear in the page, however deep or broken its nesting. Null or empty html, or a page
without content, gives an empty text. Repeated pages come out repeated; other columns are ignored; an empty table gives an
empty result. One page is held in memory at a time.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VALUE = r"(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)"
_TAG = re.compile(rf"<!--(?:>|->|.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?)*+)(>|$)|<[!?/][^>]*>?", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?)?")
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp template".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
DROP_TAGS = frozenset("head nav header footer aside form button select option menu dialog svg canvas object audio video map label input fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments commentlist disqus replies reply respond newsletter subscribe signup login breadcrumb breadcrumbs pagination pager copyright".split()
)
SIDE_WORDS = frozenset(
    "banner notice notices alert sidebar aside menu nav navbar navigation toolbar footer header masthead search share sharing social related recommended popup modal overlay widget legal disclaimer".split()
)
STATES = frozenset("has with no without is not js can".split())
PUNCTUATION = re.compile(r"[.,;:!?¡¿…、。，？！]")
#: A tag ends open ones of the first kind, unless one of the second kind was opened since.
_IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: What a content subtree can be; text-level elements, lists and tables are parts of one.
CONTAINERS = frozenset("html body main article section div center details".split())
THRESHOLD = 0.35
SHARE = 0.8
MARK = 2.0
_OFF, _SIDE, _OWN_HEADER = 1, 2, 3


def _kind(tag: str, attrs: str) -> tuple[int, bool]:
    """What speaks against a subtree (0, ``_OFF``, ``_SIDE``, ``_OWN_HEADER``: a header where no article is around); whether it is the article."""
    if tag in DROP_TAGS:
        return (_OWN_HEADER if tag == "header" else _OFF), False
    marked, against = tag in ("article", "main"), 0
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id") and tag not in ("html", "body"):
                for token in value.lower().split():
                    words = re.split(r"[_-]+", token)
                    if words[0] in STATES:
                        continue
                    if not OFF_WORDS.isdisjoint(words) and (tag not in ("article", "main") or words[0] in ("comment", "comments")):
                        return _OFF, False
                    if not SIDE_WORDS.isdisjoint(words) or not OFF_WORDS.isdisjoint(words) or token == "side-bar":
                        against = max(against, _OWN_HEADER if words[-1] == "header" else _SIDE)
            elif name == "role":
                if value.lower() in DROP_ROLES:
                    return _OFF, False
                marked = marked or value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return _OFF, False
    if tag in ("article", "main"):
        return 0, not against
    return against, marked and not against


class _Page:
    """Elements in the order they open (0 is the page), and blocks of text as parts ``(element, text, in a link)``."""

    def __init__(self, html: str):
        self.parent, self.against, self.marked, self.container = [0], [0], [False], [True]
        self.path = [0]
        self.blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)

    def _element(self, above: int, tag: str, against: int, marked: bool) -> int:
        self.parent.append(above), self.against.append(against), self.marked.append(marked), self.container.append(tag in CONTAINERS)
        at = self.path[above]
        self.path.append(self._paths.setdefault((at, tag), len(self._paths) + 1) if tag in BLOCK else at)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, element, in a link
        where: dict[str, list[int]] = defaultdict(list)  # places of each open tag in the stack
        solid: list[int] = []  # of open block-level tags
        block: list | None = None

        def last(tags: str) -> int:
            return max(where[t][-1] if where[t] else -1 for t in tags.split())

        def text(piece: str) -> None:
            nonlocal block
            _, element, link = stack[-1] if stack else ("", 0, False)
            if not piece or block is None and piece.isspace():
                return
            if block is None:
                block = []
                self.blocks.append((self.path[element], block))
            block.append((element, unescape(piece) if "&" in piece else piece, link))

        def close(i: int) -> None:
            nonlocal block
            if solid and solid[-1] >= i:
                block = None
            while solid and solid[-1] >= i:
                solid.pop()
            for tag, _, _ in stack[i:]:
                where[tag].pop()
            del stack[i:]

        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                text(html[at:])
                return
            text(html[at : m.start()])
            at = m.end()
            if m[2] is None or not m[4]:
                continue
            tag = m[2].lower()
            if m[1]:
                i = last(tag)
                if i >= 0 and (tag in ("html", "body", "article", "main", "section", "div", "table") or i >= last("article main table")):
                    close(i)
                continue
            if tag in RAW_TAGS:
                e = _RAW_END[tag].search(html, at)
                at = e.end() if e else n
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in BLOCK:
                block = None
            if tag in VOID:
                continue
            if tag in ENDS_P and solid and stack[solid[-1]][0] == "p":
                close(solid[-1])
            if tag in _IMPLIED:
                ended, within = _IMPLIED[tag]
                if (i := last(ended)) > last(within):
                    close(i)
            if m[3].rstrip().endswith("/") and tag not in BLOCK:
                continue
            above, link = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            against, marked = _kind(tag, m[3])
            element = self._element(above, tag, against, marked) if tag in BLOCK or against or marked else above
            where[tag].append(len(stack))
            if tag in BLOCK:
                solid.append(len(stack))
            stack.append((tag, element, link or tag == "a"))


def _up(parent: list[int], values: list) -> None:
    """Adds what each element has to its parent, from the leaves on."""
    for e in range(len(parent) - 1, 0, -1):
        values[parent[e]] += values[e]


def _dropped(page: _Page) -> tuple[list[bool], list[bool]]:
    """Whether each element is left out; whether it is inside the article's mark."""
    n = len(page.parent)
    said, marks = [0] * n, [int(x) for x in page.marked]
    off = [False] * n
    for e in range(1, n):
        off[e] = off[page.parent[e]] or page.against[e] == _OFF
        if off[e]:
            marks[e] = 0
    for _, parts in page.blocks:
        for e, piece, link in parts:
            if not link and not off[e]:
                said[e] += len(piece.strip())
    _up(page.parent, said)
    _up(page.parent, marks)
    drop, inside = off, [False] * n
    for e in range(1, n):
        p = page.parent[e]
        inside[e] = inside[p] or page.marked[e]
        side = page.against[e] == _SIDE and not marks[e] and 2 * said[e] <= said[0]
        drop[e] = drop[e] or drop[p] or side or page.against[e] == _OWN_HEADER and not inside[e] and not marks[e]
    return drop, inside


def _smooth(values: list[float]) -> list[float]:
    """Gaussian weights over two blocks on each side."""
    kernel, out = (math.exp(-2.0), math.exp(-0.5), 1.0, math.exp(-0.5), math.exp(-2.0)), []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - 2):
            if 0 <= k < len(values):
                total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def _subtree(page: _Page, at: list[int], mass: list[float], over: list[float]) -> int:
    """The container that holds the content, 0 for the page: by ``mass`` the deepest with its share, then outer ones while
    ``over`` of what they add is positive. ``at``: the element of each block."""
    held, margin = [0.0] * len(page.parent), [0.0] * len(page.parent)
    for e, m, o in zip(at, mass, over, strict=True):
        held[e] += m
        margin[e] += o
    _up(page.parent, held)
    _up(page.parent, margin)
    least, line = SHARE * sum(mass), [0]
    if least > 0:  # more than half of the mass, so they lie in one another and come in the order they open
        line += [e for e in range(1, len(held)) if page.container[e] and held[e] >= least * (1 - 1e-12)]
    best = line[-1]
    for e in reversed(line[:-1]):
        if margin[e] > margin[best]:
            best = e
    return best


def scores(paths: list[int], texts: list[str], linked: list[int]) -> tuple[list[float], list[float]]:
    """For each block the fused, smoothed score of its path, and the share of its path's text that is in links."""
    stats: dict[int, list[float]] = {}
    for p, t, k in zip(paths, texts, linked, strict=True):
        s = stats.setdefault(p, [0, 0, 0, 0])
        s[0] += len(t)
        s[1] += len(PUNCTUATION.findall(t))
        s[2] += min(k, len(t))
        s[3] += 1
    length = _smooth([stats[p][0] / stats[p][3] for p in paths])
    points = _smooth([stats[p][1] / stats[p][3] for p in paths])
    share = [stats[p][2] / stats[p][0] for p in paths]
    return [math.sqrt(x * (0.1 + q)) * (1 - s) for x, q, s in zip(length, points, share, strict=True)], share


def content(page: _Page, threshold: float = THRESHOLD) -> list[str]:
    """Texts of the blocks in the subtree that the scores of the paths choose, without its link lists."""
    drop, inside = _dropped(page)
    paths, texts, linked, at = [], [], [], []
    for path, parts in page.blocks:
        parts = [x for x in parts if not drop[x[0]]]
        if text := " ".join("".join(piece for _, piece, _ in parts).split()):
            paths.append(path), texts.append(text), at.append(parts[0][0])
            linked.append(sum(len(piece.strip()) for _, piece, link in parts if link))
    if not texts:
        return []
    fused, share = scores(paths, texts, linked)
    # the mean weighted by text, so that a long menu does not lower it
    bar = threshold * sum(f * len(t) for f, t in zip(fused, texts, strict=True)) / sum(map(len, texts))
    told = [f * (MARK if inside[e] else 1.0) for f, e in zip(fused, at, strict=True)]
    root = _subtree(page, at, [x * len(t) for x, t in zip(told, texts, strict=True)], [(x - bar) * len(t) for x, t in zip(told, texts, strict=True)])
    within = [False] * len(page.parent)
    within[root] = True
    for e in range(root + 1, len(within)):
        within[e] = within[page.parent[e]]
    return [t for t, e, f, s in zip(texts, at, fused, share, strict=True) if (not root or within[e]) and (f >= bar or s <= 0.5)]


def main_text(html: str | None) -> str:
    return "\n\n".join(content(_Page(html or "")))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
