"""Main text of HTML pages by tree scoring.

A page becomes a tree of block elements. Each block of text passes points for its length and
commas to its ancestors, halved at every step up; a container's points are discounted by its
link density. The best container and those of its siblings that hold text of the same kind are
kept, without what is not the article: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. Elements, roles and hidden styles say so for sure, but
a form, and what is only invisible, counts as a doubtful name does (a page may be wrapped in it); its controls go.
A class or id says so too, but is not believed of an element that holds an article or main
element (an article named so itself only goes if there is another), nor of the largest one where next to nothing would be left; and one that only has a doubtful word among others
(post-header, text-search) is not believed either if it holds a heading of the first level, more
than half of the text, or the best container.

Reading and scoring take time in proportion to the page, however deep its elements are nested
and whatever quotes or tags it leaves open.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
# The rest of a tag; quotes only count behind an equals sign.
_REST = re.compile(r"(?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements that make blocks, elements whose text is never read as markup, elements
# that are never part of an article, and the words in class, id and role that say the same.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul noscript head iframe object svg canvas template".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset("nav header footer aside head script style noscript template iframe object svg canvas dialog menu button select option search fieldset".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended sidebar sidenav aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager paging footer footers header masthead topbar comment comments disqus replies respond login search toolbar skip copyright disclaimer alert outbrain taboola".split())
# Those that mean the same among other words.
ALWAYS = frozenset("comment comments disqus replies respond sidebar sidenav nav navbar navigation breadcrumb breadcrumbs pagination cookie cookies consent gdpr newsletter advert adverts advertisement advertising sponsored footer footers masthead outbrain taboola".split())
HIDDEN = frozenset("hidden is-hidden visually-hidden sr-only screen-reader-text d-none".split())
BEFORE = frozenset("no has with without below above after before".split())
AFTER = frozenset("free less off none".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WHOLE = frozenset("html body main".split())
VOID = frozenset("hr".split())
#: An open element of the set is closed by a start tag of the key.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
STOPS = frozenset("ul ol dl table body html".split())


#: Elements whose own text gives its points to what contains them.
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td".split())
LISTS = frozenset("ul ol div section table".split())
#: Containers that can't hold their own heading.
LISTED = frozenset("ul ol dl table tbody".split())
#: Share of the text above which an element isn't dropped for a doubtful name; and share below which too little is left without the largest named one.
MOST, LITTLE = 0.5, 0.05


class Node:
    __slots__ = ("tag", "parent", "depth", "never", "named", "points", "chars", "link_chars", "article", "heading")

    def __init__(self, tag: str, parent: Node | None, never: bool, named: int = 0):
        self.tag, self.parent, self.never, self.named = tag, parent, never, named
        self.depth = parent.depth + 1 if parent else 0
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        self.article, self.heading = tag in ("article", "main"), tag == "h1"

    @property
    def score(self) -> float:
        return self.points * (1 - self.link_chars / self.chars) if self.chars else 0.0


def _named(tag: str, attrs: str) -> int:
    """What the attributes say: 3, surely no part of an article; 2, by a plain name; 1, by a word among others; 0, nothing."""
    said = 1 if tag == "form" else 0
    if not attrs or tag in WHOLE:
        return said
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for whole in value.split():
                if whole.lower() in HIDDEN:
                    return 3
                words = [w.lower() for w in _PART.findall(whole)]
                for i, w in enumerate(words):
                    # "has-sidebar" or "ads-free" is said of what holds, or lacks, the thing.
                    if w in NAMES and (i == 0 or words[i - 1] not in BEFORE) and (i + 1 == len(words) or words[i + 1] not in AFTER):
                        said = max(said, 2 if len(words) == 1 or w in ALWAYS else 1)
        elif name == "hidden" or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return 3
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 3
        elif name == "style" and re.search(r"visibility\s*:\s*hidden", value, re.I):
            said = max(said, 1)
    return said


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """(elements, each after its parent; blocks of text in page order: element, text, characters in links)."""
    root = Node("html", None, False)
    stack, nodes, out = [root], [root], []
    unclosed: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    in_link, quotes, at, size, low = False, True, 0, len(page), None

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((stack[-1], text, len(" ".join(html.unescape("".join(linked)).split()))))
            pieces, linked = [], []

    def add(text: str) -> None:
        pieces.append(text)
        if in_link:
            linked.append(text)

    def close(i: int) -> None:
        for n in stack[i:]:
            unclosed[n.tag] -= 1
        del stack[i:]

    while at < size:
        here = page.find("<", at)
        if here < 0:
            add(page[at:])
            break
        if here > at:
            add(page[at:here])
        if page.startswith("<!--", here):
            to = page.find("-->", here + 4)
            at = to + 3 if to >= 0 else size
            continue
        m = _OPEN.match(page, here)
        if not m and page[here + 1 : here + 2] not in ("!", "?", "/"):
            add("<")
            at = here + 1
            continue
        rest = _REST.match(page, m.end()) if m and quotes else None
        if rest:
            at = rest.end()
        else:
            # No end outside of quotes: from here on quotes don't count.
            quotes = quotes and not m
            to = page.find(">", here)
            if to < 0:
                add(page[here:])
                break
            at = to + 1
        if not m:
            continue
        tag, end = m[1].lower(), page[here + 1] == "/"
        if tag in RAW and not end:
            if low is None:
                low = page.lower()
                if len(low) != size:
                    low = re.sub(r"[A-Z]", lambda x: x[0].lower(), page)
            to = low.find(f"</{tag}", at)
            at = size if to < 0 else (page.find(">", to) + 1 or size)
            if tag in BLOCKS:
                flush()
            continue
        if tag == "a":
            in_link = not end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link = in_link and tag not in ("p", "li", "div", "td", "ul")
        if end:
            if unclosed[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag == "html" or tag == "body" and unclosed["body"]:
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in CLOSES and any(unclosed[x] for x in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in STOPS:
                    break
        if tag not in VOID:
            named = _named(tag, page[m.end() : at - 1])
            named = min(named, 2) if tag == "article" else named
            node = Node(tag, stack[-1], stack[-1].never or tag in NEVER or named == 3, named)
            stack.append(node)
            nodes.append(node)
            unclosed[tag] += 1
    flush()
    return nodes, out


def _scored(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> Node:
    """The best container of the blocks, after points and characters were passed up."""
    for n in nodes:
        n.points, n.chars, n.link_chars = 0.0, 0, 0
    for node, text, link in blocks:
        up = node.parent if node.tag in TEXTUAL and node.parent else node
        up.points += (1 + text.count(",") + len(text) / 100) * (1 - min(1.0, link / len(text)))
        up.chars += len(text)
        up.link_chars += link
    for n in reversed(nodes):
        if n.parent:
            n.parent.points += n.points / 2
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
            n.parent.article |= n.article
            n.parent.heading |= n.heading
    return max(nodes, key=lambda n: (n.score * (1.5 if n.tag in ("article", "main") else 1.0), -n.depth))


def _without_named(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that no element's believed name takes out."""
    best, around = _scored(nodes, blocks), set()
    while best:
        around.add(id(best))
        best = best.parent
    # A block's own characters count for its element too.
    whole, own = max(1, nodes[0].chars), Counter()
    for node, text, _ in blocks:
        if node.tag in TEXTUAL:
            own[id(node)] += len(text)
    share = lambda n: (n.chars + own[id(n)]) / whole
    plain = any(n.tag == "article" and not n.named for n in nodes)
    gone: set[int] = set()
    tops: list[Node] = []

    def drop(spared: Node | None) -> list[tuple[Node, str, int]]:
        gone.clear()
        tops.clear()
        for n in nodes:
            if n.parent and id(n.parent) in gone:
                gone.add(id(n))
            elif n.named and n is not spared and (not n.article or n.tag == "article" and n.named == 2 and plain):
                if not (n.named == 1 and (n.heading or share(n) > MOST or id(n) in around)):
                    gone.add(id(n))
                    tops.append(n)
        return [b for b in blocks if id(b[0]) not in gone]

    kept = drop(None)
    if tops and sum(len(t) for _, t, _ in kept) < LITTLE * whole:
        kept = drop(max(tops, key=share))
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty for null, for an empty page and where nothing is left."""
    nodes, blocks = parse(page or "")
    blocks = [b for b in blocks if not b[0].never]
    if any(n.named for n in nodes):
        blocks = _without_named(nodes, blocks)
    if not blocks:
        return ""
    best = _scored(nodes, blocks)
    # Up to the article or main element around it, if that is what the best container is part of.
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    floor, chosen = 0.2 * best.score, {id(best)}
    if best.tag not in ("main", "body"):
        for n in nodes:
            # Beside an article only other articles count, not those whose name says that they are something else.
            kind = n.tag == "article" and not n.named if best.tag == "article" else n.tag not in ("html", "body")
            if n.parent is best.parent and n is not best and kind and n.score >= max(floor, 3) and n.link_chars < 0.3 * n.chars:
                chosen.add(id(n))
    # What is within a chosen element, with no list of links between.
    within: set[int] = set()
    for n in nodes:
        links = n.tag in LISTS and n.chars and n.link_chars > 0.8 * n.chars
        if id(n) in chosen or not links and n.parent and id(n.parent) in within:
            within.add(id(n))
    beside = best.tag not in ("html", "body", "article", "main")
    out = []
    for node, text, link in blocks:
        lone = beside and node.parent is best.parent and link < 0.25 * len(text) and (node.tag == "p" and len(text) > 80 or node.tag == "h1" and best.tag in LISTED)
        if id(node) in chosen or node.parent and id(node.parent) in within or lone:
            out.append(text)
    return "\n".join(out)


def extracted(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """pages (without the html) with ``text`` and n_chars (its code points).

    Null and empty pages, and pages without an article, have the empty text. Each row stands
    alone. Columns with the new names are replaced.
    """
    names = [c for c in pages.columns if c not in (source, text, "n_chars")]
    base = pages.select(*[F.col(f"`{c}`") for c in names], F.col(source).alias("__html"))
    schema = base.drop("__html").withColumns({text: F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(len(names))]
            cols = [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            fields = [batch.schema.field(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *cols], schema=pa.schema([*fields, (text, pa.string()), ("n_chars", pa.int64())]))

    return base.mapInArrow(run, schema)
