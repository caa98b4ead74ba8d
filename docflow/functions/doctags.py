"""Tagged page text to typed elements, tables and positioned diagnostics.

One Arrow UDF parses a page; everything after it works on its struct with
built-in expressions. Content problems are diagnostics in emission order,
exceeded budgets are a ``fatal_error``: one bad page never ends a job. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MAX_CHARACTERS, MAX_NODES, MAX_DEPTH = 2_000_000, 100_000, 64
MAX_CELLS, MAX_COLUMNS = 4096, 128
#: Bytes of pages that are parsed before their rows become columns.
PORTION = 1 << 20

# Fixed values of the format.
BLANK = " \t\n\r\f"
CELL_KINDS = {
    "fcel": "data",
    "ecel": "empty",
    "ched": "column-header",
    "rhed": "row-header",
    "srow": "section-header",
    "lcel": "span",
    "ucel": "span",
    "xcel": "span",
}
LEAF_KINDS = {
    "text": "text",
    "title": "title",
    "page_footer": "page-footer",
    "page_header": "page-header",
    "footnote": "footnote",
    "list_item": "list-item",
}
LIST_KINDS = {"ordered_list": "ordered-list", "unordered_list": "unordered-list"}
CLASSIFICATIONS = frozenset(
    "bar_chart box_plot flow_chart line_chart pie_chart scatter_plot table other_chart full_page_image page_thumbnail "
    "photograph chemistry_structure bar_code icon logo qr_code signature stamp engineering_drawing "
    "screenshot_from_computer screenshot_from_manual geographical_map topographical_map calendar crossword_puzzle music "
    "other cad_drawing electrical_diagram map heatmap chemistry_markush_structure chemistry_molecular_structure "
    "natural_image picture_group remote_sensing scatter_chart screenshot stacked_bar_chart stratigraphic_chart".split()
)
CODES = (
    "generation-truncated malformed-token mismatched-close unclosed-tag document-wrapper end-marker outside-content "
    "unsupported-structure unsupported-tag location ambiguous-entity control-character picture-content "
    "picture-classification picture-location table-content table-shape table-span table-header"
).split()

_TAG = re.compile(r"(<[^>]*>)")
_BAD_NAME = re.compile(r"[ \t\n\r\f<>/]|\A\Z")
_HEADING = re.compile(r"section_header_level_([1-5])")
_LOCATION = re.compile(r"loc_[0-4]?[0-9]{1,2}")
_ENTITY = re.compile(r"&(?:#|[^\W_])")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f]")
_SELF_CONTAINED = frozenset([*CELL_KINDS, "nl", "end_of_utterance", *CLASSIFICATIONS])
_MARKERS = frozenset([*CELL_KINDS, "nl"])
_HEADERS = frozenset(["column-header", "row-header", "section-header"])
#: Slot letters of a grid: an anchor, or a continuation to the left, above or both.
_SLOT = {"lcel": "l", "ucel": "u", "xcel": "x"}
_ALONG, _DOWN, _INNER = re.compile("al+"), re.compile("au+"), re.compile("ux+")

ELEMENT = ("ordinal", "parent", "kind", "tag", "level", "text", "location", "classification", "start", "end", "table", "below")
CELL = ("table", "r", "c", "rs", "cs", "tag", "kind", "text", "start", "end")
TABLE = ("rows", "columns", "renderable", "first")


class Fatal(Exception):
    """A budget or argument error: the page has no result."""


#: No children.
NONE: list[int] = []


class Nodes:
    """A page's token tree as parallel lists; a node is its number.

    The page is cut at its tags, and a cut's number is its time: ``since`` and
    ``until`` say when a node was open, ``troubles`` when the scanner met a
    problem. So whether a problem fell into a node is a search, no mark.
    Pieces at odd times are tags.
    """

    def __init__(self, raw: str, max_nodes: int, max_depth: int):
        self.raw = raw
        self.tag: list[str | None] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.kids: list[list[int]] = []  # of text and atomic tags: NONE
        self.life: dict[int, tuple[int, int, bool]] = {}  # of the others: since, until, has its closing tag
        self.top: list[int] = []
        self.notes: list[tuple[str, int]] = []
        self.troubles: list[int] = []
        self._cut(max_nodes, max_depth)

    def _trouble(self, code: str, place: int, time: int) -> None:
        self.notes.append((code, place))
        self.troubles.append(time)

    def _cut(self, max_nodes: int, max_depth: int) -> None:
        pieces = _TAG.split(self.raw)
        trail: list[int] = []
        since: list[int] = []
        heights: dict[str, list[int]] = {}  # tag: where it is open in the trail
        tags, starts, ends, kids = self.tag.append, self.start.append, self.end.append, self.kids.append
        among, place, node = self.top, 0, 0

        def leave(end: int, time: int, whole: bool) -> list[int]:
            gone = trail.pop()
            heights[self.tag[gone]].pop()
            self.end[gone], self.life[gone] = end, (since.pop(), time, whole)
            return self.kids[trail[-1]] if trail else self.top

        stray = pieces[-1].find("<")
        if stray >= 0:  # a tag that never ends: a piece of its own
            pieces[-1:] = [pieces[-1][:stray], None, pieces[-1][stray:]]
        for time, piece in enumerate(pieces):
            if not piece:
                if piece is None:
                    self._trouble("malformed-token", place, time)
                continue
            start = place
            place += len(piece)
            if not time & 1:  # between tags
                among.append(node)
                tags(None)
                starts(start)
                ends(place)
                kids(NONE)
                node += 1
            elif piece[1] != "/":
                name = piece[1:-1]
                if _BAD_NAME.search(name):
                    self._trouble("malformed-token", start, time)
                among.append(node)
                tags(name)
                starts(start)
                ends(place)
                if name in _SELF_CONTAINED or name.startswith("loc_"):
                    kids(NONE)
                else:
                    if len(trail) >= max_depth:
                        raise Fatal("depth budget" if node < max_nodes else "node budget")
                    heights.setdefault(name, []).append(len(trail))
                    trail.append(node)
                    since.append(time)
                    among = []
                    kids(among)
                node += 1
            else:
                open_at = heights.get(piece[2:-1])
                if not open_at or open_at[-1] != len(trail) - 1:
                    self._trouble("mismatched-close", start, time)
                if open_at:
                    height = open_at[-1]
                    while len(trail) - 1 > height:
                        self._trouble("unclosed-tag", self.start[trail[-1]], time)
                        leave(start, time, False)
                    among = leave(place, time, True)
            if node > max_nodes:
                raise Fatal("node budget")
        while trail:
            self._trouble("unclosed-tag", self.start[trail[-1]], len(pieces))
            leave(len(self.raw), len(pieces), False)

    def text(self, node: int) -> str:
        return self.raw[self.start[node] : self.end[node]]

    def blank(self, node: int) -> bool:
        return self.tag[node] is None and not self.text(node).strip(BLANK)

    def unharmed(self, node: int) -> bool:
        """Closed, and no problem while it was open."""
        since, until, whole = self.life[node]
        i = bisect_right(self.troubles, since)
        return whole and (i == len(self.troubles) or self.troubles[i] > until)


def location_of(tag: str) -> int | None:
    return int(tag[4:]) if _LOCATION.fullmatch(tag) else None


def _text_codes(text: str) -> list[str]:
    codes = []
    if "&" in text and _ENTITY.search(text):
        codes.append("ambiguous-entity")
    if _CONTROL.search(text):
        codes.append("control-character")
    return codes


def _box_fits(box: list, strict: bool) -> bool:
    """Four known numbers, each pair in order."""
    if len(box) != 4 or None in box:
        return False
    return box[0] + strict <= box[2] and box[1] + strict <= box[3]


def _picture_role(tag: str | None) -> str:
    if tag is None:
        return "content"
    return "class" if tag in CLASSIFICATIONS else "place" if tag.startswith("loc_") else "structure"


class Builder:
    """Elements, cells, tables and content diagnostics of one page, as rows."""

    def __init__(self, nodes: Nodes):
        self.nodes = nodes
        self.notes: list[tuple[str, int]] = []
        self.elements: list[list] = []
        self.cells: list[tuple] = []
        self.tables: list[tuple] = []

    def place(self, node: int, parent: int | None = None) -> None:
        """Rows of a node and of what it holds."""
        nodes, tag, ordinal = self.nodes, self.nodes.tag[node], len(self.elements)
        start, kids = nodes.start[node], nodes.kids[node]
        row = [ordinal, parent, "unknown", tag or "#text", None, "", None, None, start, nodes.end[node], None, 0]
        self.elements.append(row)
        heading = _HEADING.fullmatch(tag) if tag else None
        if heading or tag in LEAF_KINDS:
            row[2], row[4] = (LEAF_KINDS[tag], None) if not heading else ("heading", int(heading[1]))
            row[5], row[6], codes = self.leaf(kids, start)
            self.notes += codes
        elif tag in LIST_KINDS:
            row[2] = LIST_KINDS[tag]
            for kid in kids:
                if nodes.blank(kid):
                    continue
                if nodes.tag[kid] != "list_item":
                    self.notes.append(("unsupported-structure", nodes.start[kid]))
                self.place(kid, ordinal)
            row[11] = len(self.elements) - ordinal - 1
        elif tag == "otsl":
            row[2], row[10] = "table", len(self.tables)
            row[6] = self.table(node)
        elif tag == "picture":
            row[2] = "picture"
            row[6], row[7] = self.picture(kids, start)
        else:
            self.notes.append(("unsupported-tag", start))

    def leaf(self, kids: list[int], start: int) -> tuple[str, list | None, list]:
        """Direct text, location and diagnostics of an element of text."""
        tags, begins = self.nodes.tag, self.nodes.start
        if len(kids) == 1 and tags[kids[0]] is None:  # as most are
            text = self.nodes.text(kids[0])
            return text, None, [(code, start) for code in _text_codes(text)]
        texts = [k for k in kids if tags[k] is None]
        places = [k for k in kids if tags[k] is not None and tags[k].startswith("loc_")]
        notes = []
        if len(texts) + len(places) < len(kids):
            known = {*texts, *places}
            notes += [("unsupported-structure", begins[k]) for k in kids if k not in known]
        text = "".join(map(self.nodes.text, texts))
        box = [location_of(tags[k]) for k in places]
        if box:
            first_text = next((k for k in texts if not self.nodes.blank(k)), None)
            late = first_text is not None and first_text < places[-1]
            if late or not _box_fits(box, strict=False):
                notes.append(("location", start))
        notes += [(code, start) for code in _text_codes(text)]
        return text, box or None, notes

    def picture(self, kids: list[int], start: int) -> tuple[list | None, str | None]:
        """Location and class of a picture: what stands in it is dealt by role, and each role allows so many."""
        nodes, tags = self.nodes, self.nodes.tag
        dealt: dict[str, list[int]] = {"class": [], "place": [], "content": [], "structure": []}
        for kid in kids:
            if not nodes.blank(kid):
                dealt[_picture_role(tags[kid])].append(kid)
        faults = [
            (kid, code)
            for role, allowed, code in (("content", 0, "picture-content"), ("class", 1, "picture-classification"), ("structure", 0, "unsupported-structure"))
            for kid in dealt[role][allowed:]
        ]
        self.notes += [(code, nodes.start[kid]) for kid, code in sorted(faults)]
        box = [location_of(tags[kid]) for kid in dealt["place"]]
        self.notes += [("location", start)] * (not _box_fits(box, strict=True)) + [("picture-location", start)] * (len(box) != 4)
        return box or None, tags[dealt["class"][0]] if dealt["class"] else None

    def table(self, node: int) -> list | None:
        """Cells and record of a table; its location is returned.

        Children are cut into runs, each begun by a marker; a run of a cell marker
        is that cell, a run of ``nl`` ends a row. Checks follow rule by rule: runs,
        shape, location, spans, headers.
        """
        nodes = self.nodes
        tags, begins, kids = nodes.tag, nodes.start, nodes.kids[node]
        heads = [i for i, k in enumerate(kids) if tags[k] in _MARKERS]
        before = kids[: heads[0]] if heads else kids
        notes = [
            ("table-content", begins[k])
            for k in before
            if not nodes.blank(k) and not (tags[k] or "").startswith("loc_")
        ]
        close = nodes.end[node] - (len("</otsl>") if nodes.life[node][2] else 0)
        rows: list[list[tuple]] = [[]]
        n_cells = 0
        for i, stop in zip(heads, [*heads[1:], len(kids)]):
            marker, run = kids[i], kids[i + 1 : stop]
            tag, start = tags[marker], begins[marker]
            if tag == "nl":
                notes += self._shape(rows, start)
                rows.append([])
                notes += [("table-content", begins[k]) for k in run if not nodes.blank(k)]
                continue
            if len(run) == 1 and tags[run[0]] is None:  # as most are
                text = nodes.text(run[0]).strip(BLANK)
            else:
                notes += [("table-content", begins[k]) for k in run if tags[k] is not None]
                text = "".join(nodes.text(k) for k in run if tags[k] is None).strip(BLANK)
            n_cells += 1
            if n_cells > MAX_CELLS or len(rows[-1]) >= MAX_COLUMNS:
                raise Fatal("table budget")
            kind = CELL_KINDS[tag]
            if (text == "") != (kind in ("empty", "span")):
                notes.append(("table-content", start))
            if not text.isalnum():
                notes += [(code, start) for code in _text_codes(text)]
            rows[-1].append((tag, kind, text, start, begins[kids[stop]] if stop < len(kids) else close))
        start = begins[node]
        if rows[-1]:
            notes.append(("table-shape", start))
            notes += self._shape(rows, nodes.end[node])
        else:
            rows.pop()
        if not rows:
            notes.append(("table-shape", start))
        spots = [k for k in before if (tags[k] or "").startswith("loc_")]
        _, box, codes = self.leaf(spots, start)
        notes += codes
        width = len(rows[0]) if rows else 0
        extent: dict[int, tuple[int, int]] = {}
        if width and all(len(row) == width for row in rows):
            if any(cell[0] in _SLOT for row in rows for cell in row):
                extent, codes = _extents(rows, width)
                notes += codes
            else:
                extent = dict.fromkeys(range(len(rows) * width), (1, 1))
        number, first = len(self.tables), len(self.cells)
        for r, row in enumerate(rows):
            spans = [extent.get(r * width + c, (0, 0)) for c in range(len(row))]
            kinds = [x[1] for x in row]
            if not _HEADERS.isdisjoint(kinds) and not _header_fits(r, kinds, spans):
                notes.append(("table-header", start))
            self.cells += [(number, r, c, *spans[c], *cell) for c, cell in enumerate(row)]
        self.notes += notes
        self.tables.append((len(rows), width, nodes.unharmed(node) and not notes, first))
        return box

    @staticmethod
    def _shape(rows: list[list], at: int) -> list[tuple[str, int]]:
        """The last row is neither empty nor of another width than the first."""
        faults = (not rows[-1]) + (len(rows[-1]) != len(rows[0]))
        return [("table-shape", at)] * faults


def _header_fits(r: int, kinds: list[str], spans: list[tuple[int, int]]) -> bool:
    """Column headers only as a whole first row without vertical spans; other headers not at all."""
    own = [(kind, span) for kind, span in zip(kinds, spans) if kind != "span"]
    kinds_here = {kind for kind, _ in own}
    if kinds_here & {"row-header", "section-header"}:
        return False
    if "column-header" not in kinds_here:
        return True
    return r == 0 and len(kinds_here) == 1 and all(span[0] <= 1 for _, span in own)


def _extents(rows: list[list[tuple]], width: int) -> tuple[dict[int, tuple[int, int]], list[tuple[str, int]]]:
    """Rows and columns of each anchor, and the diagnostics of slots without one or of ragged areas.

    The grid is read as words of slot letters. An anchor with the ``l`` run
    behind it is a row part, with the ``u`` run below it a column part. An ``x``
    run continues the column part at its left as far as the row above agrees.
    """
    lines = ["".join(_SLOT.get(cell[0], "a") for cell in row) for row in rows]
    owner = [-1] * (len(rows) * width)
    for r, line in enumerate(lines):
        for c, letter in enumerate(line):
            if letter == "a":
                owner[r * width + c] = r * width + c
        for run in _ALONG.finditer(line):
            a, b = r * width + run.start(), r * width + run.end()
            owner[a:b] = [a] * (b - a)
    if any("u" in line for line in lines):
        for c, column in enumerate(map("".join, zip(*lines))):
            for run in _DOWN.finditer(column):
                slots = range(run.start() * width + c, run.end() * width + c, width)
                for slot in slots:
                    owner[slot] = slots[0]
        for r, line in enumerate(lines):
            for run in _INNER.finditer(line):
                first = r * width + run.start()
                for slot in range(first + 1, r * width + run.end()):
                    if owner[first] < 0 or owner[slot - width] != owner[first]:
                        break
                    owner[slot] = owner[first]
    notes = [("table-span", rows[s // width][s % width][3]) for s, own in enumerate(owner) if own < 0]
    slots: dict[int, list[int]] = {}
    for slot, own in enumerate(owner):
        if own >= 0:
            slots.setdefault(own, []).append(slot)
    extent = {}
    for own, area in slots.items():
        high = area[-1] // width - own // width + 1
        wide = max(s % width for s in area) - own % width + 1
        if high * wide != len(area):
            notes.append(("table-span", rows[own // width][own % width][3]))
        extent[own] = (high, wide)
    return extent, notes


def parsed(
    raw: str | None,
    stop: str | None = None,
    max_characters: int = MAX_CHARACTERS,
    max_nodes: int = MAX_NODES,
    max_depth: int = MAX_DEPTH,
) -> tuple[list, list, list, list, str | None]:
    """Rows of elements, cells, tables and diagnostics of one page, and its fatal error."""
    fatal = "no text" if raw is None else "character budget" if len(raw) > max_characters else None
    if fatal is None and (stop or "unknown") not in ("unknown", "eos", "length"):
        fatal = "stop reason"
    if fatal is None:
        try:
            return _page(Nodes(raw, max_nodes, max_depth), stop == "length")
        except Fatal as e:
            fatal = str(e)
    return [], [], [], [], fatal


def _page(nodes: Nodes, truncated: bool) -> tuple[list, list, list, list, None]:
    build = Builder(nodes)
    wrappers = [n for n in nodes.top if nodes.tag[n] == "doctag"]
    build.notes = [("generation-truncated", len(nodes.raw))] * truncated + nodes.notes
    build.notes += [("document-wrapper", 0)] * (len(wrappers) != 1)
    ends = [n for n in nodes.top if nodes.tag[n] == "end_of_utterance"]
    #: Only the first end marker counts, behind a first wrapper that is closed.
    good_end = ends[0] if ends and wrappers and nodes.life[wrappers[0]][2] and nodes.start[ends[0]] >= nodes.end[wrappers[0]] else None
    for node in nodes.top:
        tag = nodes.tag[node]
        if tag == "doctag":
            for kid in nodes.kids[node]:
                if not nodes.blank(kid):
                    build.place(kid)
        elif tag == "end_of_utterance":
            if node != good_end:
                build.notes.append(("end-marker", nodes.start[node]))
        elif not nodes.blank(node):
            build.notes.append(("outside-content", nodes.start[node]))
    return build.elements, build.cells, build.tables, build.notes, None


def parse_page(raw: str | None, stop: str | None = None, **budgets: int) -> dict:
    """elements, cells, tables, diagnostics and fatal_error of one page."""
    elements, cells, tables, notes, fatal = parsed(raw, stop, **budgets)
    return {
        "elements": [dict(zip(ELEMENT, x)) for x in elements],
        "cells": [dict(zip(CELL, x)) for x in cells],
        "tables": [dict(zip(TABLE, x)) for x in tables],
        "diagnostics": [{"code": code, "start": start} for code, start in notes],
        "fatal_error": fatal,
    }


PARSED_DDL = (
    "elements array<struct<ordinal:int,parent:int,kind:string,tag:string,level:int,text:string,location:array<int>,"
    "classification:string,start:int,end:int,table:int,below:int>>, "
    "cells array<struct<table:int,r:int,c:int,rs:int,cs:int,tag:string,kind:string,text:string,start:int,end:int>>, "
    "tables array<struct<rows:int,columns:int,renderable:boolean,first:int>>, "
    "diagnostics array<struct<code:string,start:int>>, fatal_error string"
)


def _listed(pages: list[list], kind: pa.ListType) -> pa.Array:
    """The rows of each page as a list of structs, built column by column."""
    fields = list(kind.value_type)
    columns = list(zip(*(row for rows in pages for row in rows))) or [()] * len(fields)
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    offsets = pa.array([0, *accumulate(map(len, pages))], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat, type=kind)


def _portions(raws: pa.Array) -> list[tuple[int, int]]:
    """(start, length) of runs of pages of about ``PORTION`` characters: only their objects are held at once."""
    sizes = pc.fill_null(pc.binary_length(raws), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return []
    which = np.cumsum(sizes, dtype=np.int64) // PORTION
    starts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist()]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(sizes)])]


def parse_doctags(raw: Column, stop: Column | None = None) -> Column:
    """The parsed page as a struct; nondeterministic, so that it's evaluated once per row."""
    result = T.StructType.fromDDL(PARSED_DDL)
    fields = list(to_arrow_type(result))

    def some(raws: pa.Array, stops: pa.Array) -> pa.Array:
        pages = [parsed(r, s) for r, s in zip(raws.to_pylist(), stops.to_pylist(), strict=True)]
        *parts, fatal = zip(*pages) if pages else ([], [], [], [], [])
        columns = [_listed(part, f.type) for part, f in zip(parts, fields)]
        return pa.StructArray.from_arrays([*columns, pa.array(fatal, pa.string())], fields=fields)

    @F.arrow_udf(result)
    def run(raws: pa.Array, stops: pa.Array) -> pa.Array:
        parts = [some(raws.slice(at, n), stops.slice(at, n)) for at, n in _portions(raws)]
        return pa.concat_arrays(parts) if parts else some(raws, stops)

    return run.asNondeterministic()(raw, stop if stop is not None else F.lit("unknown"))
