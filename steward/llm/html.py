"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each paragraph gives points for its length and its commas
to its ancestors, fewer to the farther ones; a container's points are discounted by the share
of its text that stands in links. The best container and those siblings that come close
make up the article. What is no prose by its tag, role or name is left out.

A null or empty page has an empty text. A page none of whose containers scores gives the
text of its body. Tags that are never closed end with their parent, and a page cut off in a
tag ends there. Pages are read one by one: repeated rows stay, null ids stay null, and
columns other than the named ones pass through untouched or are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.shared import Batches, batches_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|noscript|template|iframe|svg|title)\b"
    r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<\Z",
    re.S | re.I,
)
_SKIPPED = re.compile(
    r"(?<![\w-])(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I
)
_ROLE = re.compile(r"role\s*=\s*[\"']?(\w+)", re.I)
_HIDDEN = re.compile(
    r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I
)
_PART = re.compile(r"[^a-z0-9]+")
_WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select option "
    "textarea iframe svg canvas object audio video menu dialog title".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar form".split()
)
# A class or id names page furniture if all its words are of these two sets and one is of the first.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adbox banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disclaimer disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain pager pagination "
    "popup promo promotion related recommended replies reply respond responses share sharing shoutbox "
    "sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola "
    "toolbar topbar widget widgets".split()
)
PLAIN = frozenset(
    "area articles bar block body bottom box btn button buttons card cards container content cta feed fixed "
    "form global group holder icons inner inline item items js left link links list lists main more news page "
    "pages panel post posts primary reader readers right row secondary section site slot stack sticky story stories "
    "strip thread threads title top unit user users wrap wrapper zone".split()
)
# As a class, not as an id: an article may have a part of that name.
SECTIONS = frozenset("discussion discussions".split())
# An open element of the left ends where one of the right begins.
_ENDED_BY = {
    "p": BLOCK,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
}
_HOLDS = frozenset("ul ol dl table div section article td th body html".split())
LEVELS = 5  # of ancestors that get points
SHARE = 0.2  # of the best container's points that a sibling needs
LINKED = 0.5  # from this share of link text on, a list or box within the article is a menu


def _dropped(tag: str, attrs: str, within: bool) -> bool:
    """Whether an element is page furniture; ``within`` an article its header belongs to it."""
    if tag in DROPPED_TAGS and not (tag == "header" and within):
        return True
    if not attrs or tag in ("html", "body", "main") or tag in HEADINGS:
        return False
    if tag == "article":
        return _named(attrs)
    if (m := _ROLE.search(attrs)) and m[1].lower() in DROPPED_ROLES:
        return True
    return _named(attrs) and not (tag == "header" and within) or bool(_HIDDEN.search(attrs))


def _named(attrs: str) -> bool:
    for kind, a, b, c in _SKIPPED.findall(attrs):
        for name in (a or b or c).lower().split():
            words = {w for w in _PART.split(name) if w and not w.isdigit()}
            if words & FURNITURE and words <= FURNITURE | PLAIN:
                return True
            if kind.lower() == "class" and words & SECTIONS and words <= FURNITURE | PLAIN | SECTIONS:
                return True
    return False


class _Tree:
    """Elements in page order, with their parents, and the texts between tags."""

    def __init__(self, page: str):
        self.tags, self.parents, self.dropped, self.linked = ["html"], [-1], [False], [False]
        self.chunks: list[tuple[int, int, str]] = []  # element, block, text
        self._block = 0
        stack, opened = [0], {"html": 1}
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(stack[-1], page[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self._block += 1
            elif tag == "br":
                self._text(stack[-1], " ")
            if m["end"] or m["end2"]:
                if opened.get(tag) and not (tag == "html" or tag == "body"):
                    while True:
                        gone = self.tags[stack.pop()]
                        opened[gone] -= 1
                        if gone == tag:
                            break
                    if not stack:
                        stack, opened["html"] = [0], 1
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag != "a":
                continue
            if tag in BLOCK or tag in _ENDED_BY:
                self._close(stack, opened, tag)
            if tag == "html" or tag == "body" and opened.get("body"):
                continue
            parent = stack[-1]
            self.tags.append(tag)
            self.parents.append(parent)
            within = bool(opened.get("article") or opened.get("main"))
            self.dropped.append(self.dropped[parent] or _dropped(tag, attrs, within))
            self.linked.append(self.linked[parent] or tag == "a")
            stack.append(len(self.tags) - 1)
            opened[tag] = opened.get(tag, 0) + 1
        if at < len(page):
            self._text(stack[-1], page[at:])

    def _close(self, stack: list[int], opened: dict[str, int], tag: str) -> None:
        """End what cannot hold ``tag``, up to the nearest element that holds anything."""
        for old, enders in _ENDED_BY.items():
            if tag not in enders or not opened.get(old):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                name = self.tags[stack[depth]]
                if name == old:
                    for gone in stack[depth:]:
                        opened[self.tags[gone]] -= 1
                    del stack[depth:]
                    break
                if name in _HOLDS:
                    break

    def _text(self, element: int, text: str) -> None:
        if not self.dropped[element]:
            if "&" in text:
                text = unescape(text)
            self.chunks.append((element, self._block, text))


def _sizes(tree: _Tree) -> tuple[list[int], list[int], list[int], list[int]]:
    """Per element: characters, commas and link characters in all it holds, and its blocks."""
    n = len(tree.tags)
    chars, commas, links, own = [0] * n, [0] * n, [0] * n, [0] * n
    for element, _, text in tree.chunks:
        size = len(_WHITE.sub(" ", text).strip())
        chars[element] += size
        own[element] += size
        commas[element] += text.count(",") + text.count("，") + text.count("、")
        if tree.linked[element]:
            links[element] += size
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        chars[p] += chars[i]
        commas[p] += commas[i]
        links[p] += links[i]
    return chars, commas, links, own


def _roots(tree: _Tree) -> tuple[list[int], list[bool]]:
    """The elements that make up the article, and those inside it that are menus."""
    chars, commas, links, own = _sizes(tree)
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    points = [0.0] * n
    for i in range(1, n):
        prose = tags[i] in PARAGRAPH or tags[i] in BLOCK and own[i] >= 25
        if not prose or tree.dropped[i] or not chars[i]:
            continue
        held = chars[i] if tags[i] in PARAGRAPH else own[i]
        gain = 1 + commas[i] * held / chars[i] + min(held / 100, 3)
        gain *= 1 - links[i] / chars[i]
        at = i if tags[i] not in PARAGRAPH else parents[i]
        for level in range(LEVELS):
            if at < 0:
                break
            points[at] += gain / (1, 2, 6, 9, 12)[level]
            at = parents[at]
    for i in range(n):
        points[i] *= 1 - links[i] / chars[i] if chars[i] else 0
    menus = [
        not tree.dropped[i]
        and tags[i] in ("ul", "ol", "dl", "div", "section", "table")
        and chars[i] > 0
        and links[i] > LINKED * chars[i]
        for i in range(n)
    ]
    holders = [i for i in range(n) if tags[i] in BLOCK and points[i] > 0 and not menus[i]]
    if not holders:
        return [0], menus
    best = max(holders, key=lambda i: (points[i], -i))
    at, whole = best, -1
    while at > 0:
        if tags[at] == "article":
            whole = at
        at = parents[at]
    if whole >= 0:
        best = whole
    if best == 0 or tags[best] == "body":
        return [best], menus
    kept = [best]
    for i in range(1, n):
        if i == best or parents[i] != parents[best] or tree.dropped[i] or menus[i]:
            continue
        lone = tags[i] == "p" and chars[i] > 0 and links[i] < 0.25 * chars[i]
        title = tags[i] in ("h1", "h2", "h3") and chars[i] > 0
        if lone or title or points[i] >= max(3.0, SHARE * points[best]):
            kept.append(i)
    return kept, menus


def main_text(page: str | None) -> str:
    """The article of one page: its blocks, white space made plain, two line ends between."""
    if not page:
        return ""
    tree = _Tree(page)
    roots, menus = _roots(tree)
    keep = [False] * len(tree.tags)
    for i in roots:
        keep[i] = True
    for i in range(1, len(keep)):
        if menus[i] or tree.dropped[i]:
            keep[i] = False
        elif keep[tree.parents[i]]:
            keep[i] = True
    blocks: list[str] = []
    parts: list[str] = []
    current = -1
    for element, block, text in tree.chunks:
        if block != current:
            blocks.append("".join(parts))
            parts, current = [], block
        if keep[element]:
            parts.append(text)
    blocks.append("".join(parts))
    clean = (_WHITE.sub(" ", b).strip() for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(
    pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per page: its id, url, ``text``, and ``n_chars``, the code points of the text."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def step(batches: Batches) -> Batches:
        for whole in batches:
            for batch in batches_of(whole, 512):
                texts = pa.array([main_text(t) for t in batch.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), texts], [id_, url, "text"]
                )

    narrow = pages.select(id_, url, F.col(html).alias("_html"))
    found = narrow.mapInArrow(step, f"`{id_}` {kinds[id_]}, `{url}` {kinds[url]}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
