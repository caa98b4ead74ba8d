"""Main text of web pages by tag-path ratios.

A page is cut into blocks; each block has a root-to-leaf path of block tags.
Text length and punctuation are summed per path and divided by the path's
blocks, the ratios are smoothed along the page and fused, and paths above a
threshold are content, on every page. Being in an article or main raises a path's
ratio, doubtful class and id names lower it.

The chosen blocks are then grown: those beneath one child of the body to the
smallest article or main that holds them all, else to the smallest division or
section. All of that subtree is the text, whatever its own ratio, but text that
stands in a bare division, has no punctuation and whose path isn't content (a
label or a button). Outside an article, blocks of nothing but links are left out
too. A heading that stands before the subtree in the same article, or in the element
around it, belongs to it.

Left out before the ratios are taken: scripts, styles, navigation, asides, page headers
and footers, forms, hidden elements, those whose role says so, and elements whose
class or id names a part of the frame (``comments``, ``ad``, ``cookie-notice``),
with all that is in them. A name doesn't count on the article itself, with ``no-``
or ``has-`` before it, or where the page's only article lies in the element.

Defined results: null or empty html, or a page without content, gives an empty
text; if frame names leave nothing of a page they don't count. Unclosed and stray
tags are read as browsers do for the common cases; an unclosed comment or script
runs to the end of the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docflow.llm.common import need, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
RAW = frozenset("script style template noscript svg iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul head select option button caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset("br hr img wbr td th".split()) - {"wbr"}
DROPPED = frozenset("nav aside footer form button select dialog head menu fieldset".split())
HINT = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|side|breadcrumb\w*|footer|foot|header"
    r"|masthead|cookie\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscribe|signup|share\w*|sharing|social|related"
    r"|recommend\w*|comments?|commentlist|respond|replies|reply|discussion|disqus|widget\w*|pagination|pager|toolbar"
    r"|search\w*|login|skip|alert|hidden|legal|copyright|tags?",
    re.I,
)
#: Hints that are as well words for what a text is about; as a class of its own each of the first kind still names a frame.
NAMES = frozenset("notice notices share shares sharing social related recommendation recommendations hidden copyright login banner navigation skip".split())
TOPICS = NAMES | frozenset("side foot header consent search searching discussion reply replies alert legal tag tags".split())
#: Lists of other pages are named by what they hold.
OTHERS = re.compile(r"(?:related|recommended|popular|similar|more)[_-](?:posts?|articles?|links|stories|content|items|reading)", re.I)
#: Before a hint these say how a page is laid out.
LAYOUT = frozenset("no not without with has is show hide".split())
#: Elements that hints are not read on: the text's own, and those around all of it.
UNHINTED = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
#: Weights of a path: of doubtful names, in an article or main.
DOUBTFUL, INSIDE = 0.5, 2.0
#: Elements whose bare text is a paragraph only if it reads like one.
BARE = frozenset("html body main article section div center td".split()) - {"td"}
#: Elements that hold a part of a page together.
PARTS = frozenset("html body main article section div center".split())
HINT_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, up to the nearest of the stops.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
PUNCTUATION = re.compile(r"[.,;:!?、。，…]")
#: Elements nested deeper than this are read as siblings, as browsers do.
DEPTH = 512
#: Smoothing over neighbouring blocks, and the share of the best fused ratio that content needs.
SIGMA = 1.0
SHARE = 0.2


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    dropped: bool
    path: str
    inside: Element | None  # nearest article or main
    depth: int = 0
    weight: float = 1.0
    frame: Element | None = None  # nearest element, itself included, that is named as a part of the frame
    holds: bool = False  # an article or main


@dataclass(eq=False)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _dropped(tag: str, attributes: str, inside: Element | None) -> bool:
    """An element that can't hold article text; header parts of an article are judged later."""
    if tag in DROPPED or (tag == "header" and inside is None):
        return True
    if not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role":
            if value.lower() in HINT_ROLE:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
    return False


def _named(tag: str, attributes: str, inside: Element | None) -> tuple[bool, float]:
    """(a part of the frame by its names, weight); an id counts only as a whole and if it isn't a topic."""
    frame, least = False, 1.0
    if (tag in UNHINTED and not (tag == "article" and inside is not None)) or not attributes:
        return frame, least
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        for token in "".join(values).lower().split() if name in ("class", "id") else ():
            parts = [x for x in re.split("[_-]+", token) if x]
            hints = [bool(HINT.fullmatch(x)) and (x != "header" or inside is None) for x in parts]
            if OTHERS.fullmatch(token):
                frame = True
            if not any(hints) or parts[0] in LAYOUT:
                continue
            telling = any(h and x not in TOPICS for h, x in zip(hints, parts))
            if name == "id":
                frame = frame or (telling and all(hints))
            elif (telling and hints[-1]) or token in NAMES:
                frame = True
            else:
                least = DOUBTFUL
    return frame, least


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order, those of dropped elements left out."""
    root = Element("", None, False, "", None)
    at, links = root, 0
    found: list[Block] = []
    now: Block | None = None
    opened: dict[str, int] = {}
    position, end = 0, len(page)
    while position < end:
        m = TOKEN.match(page, position)
        position = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if not at.dropped:
                if now is None:
                    now = Block(at)
                    found.append(now)
                now.parts.append(text)
                if links:
                    now.linked += len(text)
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, position)
                position = close.end()
            if now is not None:
                now.parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCK:
            if tag in SPACE_TAGS and now is not None:
                now.parts.append(" ")
            continue
        now, links = None, 0
        if closing:
            if opened.get(tag):
                while at.tag != tag:
                    opened[at.tag] -= 1
                    at = at.parent
                opened[tag] -= 1
                at = at.parent
            continue
        if opened.get("p") and tag not in ("td", "th", "tr", "option"):
            above = at
            while above.tag not in ("p", "table", "td", "th", "button", ""):
                above = above.parent
            if above.tag == "p":
                while at is not above:
                    opened[at.tag] -= 1
                    at = at.parent
                opened["p"] -= 1
                at = at.parent
        if tag in HEADINGS and at.tag in HEADINGS:
            opened[at.tag] -= 1
            at = at.parent
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            above = at
            last = None
            while above.tag and above.tag not in stops:
                if above.tag in closed:
                    last = above
                above = above.parent
            if last is not None:
                while at is not last:
                    opened[at.tag] -= 1
                    at = at.parent
                opened[at.tag] -= 1
                at = at.parent
        if tag in VOID:
            continue
        if at.depth >= DEPTH:
            opened[at.tag] -= 1
            at = at.parent
        inside = at.inside
        drop = at.dropped or _dropped(tag, attributes, inside)
        framed, weight = (False, 1.0) if drop else _named(tag, attributes, inside)
        step = tag if weight == 1 else f"{tag}*{weight}"  # a path of its own
        element = Element(tag, at, drop, f"{at.path}/{step}", inside, at.depth + 1, at.weight * weight, at.frame)
        if framed:
            element.frame = element
        if tag in ("article", "main"):
            element.inside = element
            above = element.frame
            while above is not None and not above.holds:
                above.holds = True
                above = above.parent.frame
        opened[tag] = opened.get(tag, 0) + 1
        at = element
    out = []
    for block in found:
        block.text = " ".join(entities.unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
    return out


def path_ratios(blocks: list[Block]) -> list[float]:
    """Per block its path's fused ratio: smoothed text and punctuation per block of the path."""
    length: dict[str, int] = {}
    marks: dict[str, int] = {}
    count: dict[str, int] = {}
    for b in blocks:
        path = b.element.path
        own = max(0, len(b.text) - b.linked)
        length[path] = length.get(path, 0) + own
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(b.text))
        count[path] = count.get(path, 0) + 1
    raw = [
        (length[p] / count[p], marks[p] / count[p]) for p in (b.element.path for b in blocks)
    ]
    reach = max(1, int(2 * SIGMA))
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    smooth: dict[str, list[float]] = {}
    for i, b in enumerate(blocks):
        total = text = mark = 0.0
        for d, w in zip(range(-reach, reach + 1), weights):
            if 0 <= i + d < len(blocks):
                total += w
                text += w * raw[i + d][0]
                mark += w * raw[i + d][1]
        sums = smooth.setdefault(b.element.path, [0.0, 0.0, 0.0])
        sums[0] += math.sqrt(raw[i][0] * text / total)
        sums[1] += math.sqrt(raw[i][1] * mark / total)
        sums[2] += 1
    fused = {p: (t / n) * (1 + m / n) for p, (t, m, n) in smooth.items()}
    return [fused[b.element.path] for b in blocks]


def _chain(element: Element) -> list[Element]:
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out[::-1]


def _without_frames(blocks: list[Block]) -> list[Block]:
    """The blocks outside elements named as frames; all of them if nothing else is there."""
    free = any(b.element.inside is not None and _outermost(b.element).frame is None for b in blocks)

    def lives(element: Element) -> bool:
        frame = element.frame
        while frame is not None:
            if frame.parent.inside is not None or free or not frame.holds:
                return False
            frame = frame.parent.frame
        return True

    known: dict[int, bool] = {}
    out = []
    for b in blocks:
        key = id(b.element)
        if key not in known:
            known[key] = lives(b.element)
        if known[key]:
            out.append(b)
    return out or blocks


def _outermost(element: Element) -> Element:
    """The outermost article or main around an element in one."""
    found = element.inside
    while found.parent is not None and found.parent.inside is not None:
        found = found.parent.inside
    return found


def _regions(content: list[Block]) -> list[Element]:
    """The subtrees that the chosen blocks grow to, one or none for each child of the body."""
    shared: dict[int, list[Element]] = {}
    for b in content:
        chain = _chain(b.element)
        top = next((e for e in chain if e.tag not in ("", "html", "body")), None)
        if top is None:
            continue
        before = shared.get(id(top))
        if before is None:
            shared[id(top)] = chain
        else:
            n = min(len(before), len(chain))
            while before[n - 1] is not chain[n - 1]:
                n -= 1
            shared[id(top)] = before[:n]
    out = []
    for chain in shared.values():
        meet = chain[-1]
        if meet.inside is not None:
            out.append(meet.inside)
        else:
            parts = [e for e in chain if e.tag in PARTS and e.tag not in ("html", "body")]
            out.append(parts[-1] if parts else meet)
    return out


def main_text(page: str | None) -> str:
    """The content's blocks, one per line."""
    blocks = _without_frames(blocks_of(page or ""))
    if not blocks:
        return ""
    scores = [
        s * b.element.weight * (INSIDE if b.element.inside is not None else 1.0)
        for b, s in zip(blocks, path_ratios(blocks), strict=True)
    ]
    best = max(scores)
    if best <= 0:  # nothing but links: only the prior is left
        content = [b for b in blocks if b.element.inside is not None and b.element.weight == 1]
    else:
        content = [b for b, s in zip(blocks, scores) if s >= SHARE * best]
    chosen = {id(b) for b in content}
    regions = _regions(content)
    inner = {id(e) for e in regions}
    # around a region its parent, and the articles that have content anywhere in them
    around = {id(e.parent) for e in regions if e.inside is None and e.parent.tag not in ("", "html", "body")}
    wide = {id(e) for b in content for e in _chain(b.element) if e.tag in ("article", "main")}
    kept, places = [], _places(blocks, inner, around)
    first = {}
    for i, (place, _) in enumerate(places):
        if place is not None:
            first.setdefault(place, i)
    start = min(first.values(), default=0)
    for i, (b, (place, near)) in enumerate(zip(blocks, places)):
        e = b.element
        heading = e.tag in HEADINGS
        if place is None:
            title = heading and e.weight == 1 and (id(e.inside) in wide or (near and i < start))
            if not title and id(b) not in chosen:
                continue
        elif id(b) not in chosen:
            if e.tag in BARE and not PUNCTUATION.search(b.text):
                continue
            if e.inside is None and len(b.text) <= b.linked:
                continue
        if not heading and any(x.tag == "header" for x in _chain(e)):
            continue
        kept.append(b.text)
    return "\n".join(kept)


def _places(blocks: list[Block], inner: set[int], around: set[int]) -> list[tuple[int | None, bool]]:
    """Per block the region that it stands in, and whether it stands in the element around one."""
    known: dict[int, tuple[int | None, bool]] = {}
    out = []
    for b in blocks:
        key = id(b.element)
        if key not in known:
            place, near, e = None, False, b.element
            while e is not None:
                if place is None and id(e) in inner:
                    place = id(e)
                near = near or id(e) in around
                e = e.parent
            known[key] = place, near
        out.append(known[key])
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return need(pages, page_id="long", url="string", html="string").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
