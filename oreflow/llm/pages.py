"""Main text of pages by differencing each page with its neighbour by URL."""

from __future__ import annotations

import html
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.llm.common import slices

# Element names of the HTML standard by their role, and usual names of page parts.
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form head title menu dialog button label select fieldset".split())
ENDS_ITSELF = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog menu".split())
_PART = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|sidebar|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|comments?|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login)"
)
_WITH = (
    r"(?:site|page|main|top|bottom|left|right|primary|secondary|global|mobile|desktop|post|article|links?|lists?|items?|bar|box|block|"
    r"buttons?|icons?|media|widgets?|area|section|form|reply|posts|articles|stories|content|slot|unit|policy|\d+)"
)
PARTS = re.compile(rf"(?:^|\s)(?:{_WITH}[_-]+)*{_PART}(?:[_-]+(?:{_PART}|{_WITH}))*(?:$|\s)", re.I)
TOP_PARTS = re.compile(rf"(?:^|\s)(?:{_WITH}[_-]+)*(?:header|masthead|topbar)(?:[_-]+{_WITH})*(?:$|\s)", re.I)
COMMENTS = re.compile(r"(?:^|\s)(?:comments?|respond)(?:$|[\s_-])", re.I)
CONTAINERS = frozenset("div section aside ul ol dl table details figure header footer nav form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)",
    re.I | re.S,
)
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

COPY_SHARE = 0.8
LINK_SHARE = 0.5
TEXT_SHARE = 0.5


@dataclass(frozen=True)
class Line:
    """One block of text: whether it stands in an article, the share of its characters in links, and whether
    it is a paragraph or heading."""

    text: str
    inside: bool
    linked: float
    prose: bool = False


@dataclass
class Part:
    """An element that looks like a page part: the part around it, whether it may turn out to hold the page's
    text, whether it is in an article, and what it holds: a main element, characters of articles, characters."""

    outer: Part | None
    loose: bool
    inside: bool
    main: bool = False
    article: int = 0
    size: int = 0


def _is_part(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the element is a menu, header, footer, sidebar, notice, advert, form or comment list, and
    whether that rests on a name or a form, so that it may be the wrapper of the whole page.

    Names are whole class tokens, made of part names and words that go with them; in an article they count
    on containers only.
    """
    if tag in CHROME or (tag == "header" and not inside):
        return True, tag in ("form", "fieldset")
    if "=" not in attributes or tag in ("html", "body", "main", "article"):
        return False, False
    for name, value in NAMES.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role":
            if value.lower() in ROLES:
                return True, False
        elif inside and tag not in CONTAINERS:
            continue
        elif PARTS.search(value) or (not inside and TOP_PARTS.search(value)):
            return True, not COMMENTS.search(value)
    return False, False


def lines_of(page: str | None) -> list[Line]:
    """Blocks of the page in order, without hidden elements and without page parts. An element that holds
    main, most of the text of articles, or by its name alone most of the page's text, is no page part.

    White space in a block becomes one space, character references are decoded, a line break is white
    space. Elements that are not closed end with the element around them, a paragraph or list item with the next one.
    """
    page = HIDDEN.sub(" ", page or "")
    found: list[tuple[list, bool, bool]] = []  # pieces of a block (text, innermost page part, in a link), inside an article, prose
    words: list[tuple[str, Part | None, bool]] = []
    stack: list[tuple[str, Part | None, bool, bool]] = []  # tag, innermost page part, inside an article, in a link

    def flush() -> None:
        if words:
            tag, _, inside, _ = stack[-1] if stack else ("", None, False, False)
            prose = next((t for t, *_ in reversed(stack) if t in BLOCKS), tag) in PROSE
            found.append((words.copy(), inside, prose))
        words.clear()

    def add(text: str) -> None:
        if text:
            _, part, _, linked = stack[-1] if stack else ("", None, False, False)
            words.append((text, part, linked))

    at = 0
    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "wbr"):
            add(" " if tag == "br" else "")
            continue
        if tag in VOID:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("article", "body") and tag not in BLOCKS:
                    break
            continue
        if tag == "body":
            stack.clear()
        for other in ENDS_ITSELF.get(tag, ()):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == other:
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS:
                    break
        _, part, inside, linked = stack[-1] if stack else ("", None, False, False)
        named, loose = _is_part(tag, attributes, inside)
        if named:
            part = Part(part, loose, inside)
        if tag == "main":
            for outer in _around(part):
                outer.main = True
        stack.append((tag, part, inside or tag in ("article", "main"), linked or tag == "a"))
    add(page[at:])
    flush()
    size = article = 0
    for pieces, inside, _ in found:
        for text, part, _ in pieces:
            n = len(text.strip())
            size += n
            article += n * inside
            for outer in _around(part):
                outer.size += n
                outer.article += n * (inside and not outer.inside)

    def dropped(part: Part) -> bool:
        if part.main or (article and part.article > TEXT_SHARE * article):
            return False
        return not (part.loose and part.size > TEXT_SHARE * size)

    out: list[Line] = []
    for pieces, inside, prose in found:
        left = [(text, linked) for text, part, linked in pieces if not any(map(dropped, _around(part)))]
        text = " ".join(html.unescape("".join(t for t, _ in left)).split())
        if text:
            links = sum(len(t.strip()) for t, linked in left if linked)
            out.append(Line(text, inside, links / len(text), prose))
    return out


def _around(part: Part | None) -> Iterator[Part]:
    """The part and those around it."""
    while part:
        yield part
        part = part.outer


def common(one: list, two: list) -> set[int]:
    """Places in ``one`` of a longest common subsequence with ``two``.

    Equal ends are paired first; between them, each item meets its places in the other list from
    the last to the first, and the longest increasing run of places is the alignment.
    """
    low = 0
    while low < min(len(one), len(two)) and one[low] == two[low]:
        low += 1
    high = 0
    while high < min(len(one), len(two)) - low and one[-1 - high] == two[-1 - high]:
        high += 1
    places: dict = {}
    for j in range(len(two) - high - 1, low - 1, -1):
        places.setdefault(two[j], []).append(j)
    ends: list[int] = []
    nodes: list = []
    for i in range(low, len(one) - high):
        for j in places.get(one[i], ()):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k] = j
                nodes[k] = node
    found = {*range(low), *range(len(one) - high, len(one))}
    node = nodes[-1] if nodes else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def main_text(lines: list[Line], neighbour: list[Line] | None) -> str:
    """The page's blocks without what it shares with its neighbour.

    Where a page names its article, blocks outside go and blocks inside stay, though a neighbour may
    have them too (articles quote and copy each other); only shared lines that are mostly links go
    there. On other pages shared lines go and lists of links go, unless the pages are copies of each other.
    """
    shared = common([x.text for x in lines], [x.text for x in neighbour]) if neighbour else set()
    inside = any(line.inside for line in lines)
    if not inside and sum(len(lines[i].text) for i in shared) > COPY_SHARE * sum(len(x.text) for x in lines):
        shared = set()
    kept = []
    for i, line in enumerate(lines):
        links = line.linked > LINK_SHARE
        if inside and (not line.inside or (links and i in shared)):
            continue
        if not inside and ((links and not line.prose) or i in shared):
            continue
        kept.append(line.text)
    return "\n\n".join(kept)


def _nearest(pages: Iterator[tuple]) -> Iterator[tuple]:
    """Each page of a sorted run with the neighbour whose path shares the longest start."""

    def near(page, other):
        if other is None or other[2] != page[2]:
            return -1
        return len(os.path.commonprefix([page[3], other[3]]))

    before = this = None
    for after in pages:
        if this is not None:
            yield this, max(((near(this, o), -k, o) for k, o in enumerate((before, after))), key=lambda x: x[:2])
        before, this = this, after
    if this is not None:
        yield this, (near(this, before), 0, before)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Pages are range-partitioned and sorted by host and path, so a host of any size is many partitions; a
    page's neighbour is the one before or after it in its partition with the longest common path. Every page
    is parsed once and held with one neighbour at a time.

    Null or empty html: empty text. Null url: such pages are neighbours of each other. Repeated rows get equal texts
    where they name their article. Extra columns are ignored. An empty table gives no rows.
    """
    rest = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.lower(F.substring_index(F.regexp_replace(rest, "[?#].*$", ""), "/", 1)).alias("host"),
        F.regexp_replace(rest, "^[^/?#]*", "").alias("path"),
        F.col("html").cast("string"),
    )
    ranged = rows.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        def parsed():
            for batch in batches:
                for part in slices(batch, "html"):
                    columns = [part.column(c).to_pylist() for c in ("page_id", "url", "host", "path", "html")]
                    for page_id, url, host, path, source in zip(*columns):
                        yield page_id, url, host, path, lines_of(source)

        ready: list[tuple] = []
        for (page_id, url, _, _, lines), (near, _, other) in _nearest(parsed()):
            text = main_text(lines, other[4] if near >= 0 else None)
            ready.append((page_id, url, text, len(text)))
            if len(ready) >= 256:
                yield _batch(ready, names)
                ready = []
        if ready:
            yield _batch(ready, names)

    return ranged.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
