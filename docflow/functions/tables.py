"""Rendered tables back to grids: the round trip that proves a rendering.

Only this engine's own strict output is read, by two small grammars; anything
else raises ``ValueError``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_CELL = r'<(t[dh])((?: rowspan="[1-9][0-9]*")?(?: colspan="[1-9][0-9]*")?)>((?:[^<]|<br>)*)</\1>'
_CELLS = re.compile(_CELL)
_TABLE = re.compile(r"\s*<table>\s*((?:<tr>(?:{0})*</tr>\s*)*)</table>\s*".format(_CELL.replace(r"\1", "t[dh]")))
_ROW = re.compile(r"<tr>(.*?)</tr>", re.S)
_SPAN = re.compile(r'(row|col)span="([0-9]+)"')
_PIPE_LINE = re.compile(r"\|(?: (?:[^|\\\n]|\\.)* \||  \|)+")
_PIPE_CELL = re.compile(r" ((?:[^|\\\n]|\\.)*?) ?\|")
_ESCAPED = re.compile(r"\\(.)")


def _text(marked: str) -> str:
    return html.unescape(marked.replace("<br>", "\n"))


def read_html(table: str) -> list[tuple[int, int, int, int, str]]:
    """(row, column, row span, column span, text) of every cell; overlaps and holes raise.

    ``free`` holds, per column, the first row that no cell from above reaches. A
    cell takes the first columns that are free in its row.
    """
    whole = _TABLE.fullmatch(table)
    if not whole:
        raise ValueError("not a table")
    rows = _ROW.findall(whole[1])
    cells: list[tuple[int, int, int, int, str]] = []
    free: list[int] = []
    for r, row in enumerate(rows):
        for _, attributes, marked in _CELLS.findall(row):
            span = {"row": 1, "col": 1} | {k: int(n) for k, n in _SPAN.findall(attributes)}
            c = next((i for i, until in enumerate(free) if until <= r), len(free))
            reach = c + span["col"]
            if any(until > r for until in free[c:reach]):
                raise ValueError("overlapping cells")
            if reach > len(free) and r:
                raise ValueError("the grid has holes")  # the first row sets the width
            free[c:reach] = [r + span["row"]] * span["col"]
            cells.append((r, c, span["row"], span["col"], _text(marked)))
        if any(until <= r for until in free):
            raise ValueError("the grid has holes")
    if any(until > len(rows) for until in free):
        raise ValueError("the grid has holes")
    return cells


def read_markdown(table: str) -> list[list[str]]:
    """Cell texts of a pipe table with escapes undone; a blank header row is left out."""
    lines = table.strip("\n").split("\n")
    if len(lines) < 2 or not all(_PIPE_LINE.fullmatch(line) for line in lines):
        raise ValueError("not a table")
    rows = [[_text(_ESCAPED.sub(r"\1", cell)) for cell in _PIPE_CELL.findall(line[1:])] for line in lines]
    head, rule, *body = rows
    if any(cell != "---" for cell in rule) or any(len(row) != len(head) for row in rows):
        raise ValueError("not a table")
    return ([head] if any(head) else []) + body


def html_cells(rows: DataFrame, key: str, table: str) -> DataFrame:
    """(key, r, c, rs, cs, text, error): the cells of each row's table; one row with the error where it can't be read.

    A null table has no rows.
    """
    kind = rows.schema[key]
    schema = T.StructType([T.StructField("key", kind.dataType), *T.StructType.fromDDL("r int, c int, rs int, cs int, text string, error string").fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out += [(own, *cell, None) for cell in (read_html(text) if text is not None else ())]
                except ValueError as e:
                    out.append((own, None, None, None, None, None, str(e)))
            columns = list(zip(*out)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return rows.select(key, table).mapInArrow(run, schema).withColumnRenamed("key", key)


#: Pages of a composed document are set apart by a rule and begin with their number; neither can stand in a page's own text.
_PAGES = re.compile(r"\n---\n\n(?=# Page )")
_HEADING = re.compile(r"# Page ([1-9][0-9]*)\n\n")
PIECES = "page long, block int, kind string, r int, c int, rs int, cs int, text string"


def read_composed(markdown: str) -> Iterator[tuple]:
    """(page, block, kind, r, c, rs, cs, text) of a composed document, in order.

    Kinds: ``heading`` with a page's number, ``rule`` between pages, ``cell`` for
    each cell of a pipe or HTML table, ``text`` for any other block, ``error`` where
    a table or a page can't be read. A blank header row of a pipe table is no row.
    """
    for i, body in enumerate(_PAGES.split(markdown)):
        if i:
            yield None, None, "rule", None, None, None, None, "---"
        head = _HEADING.match(body)
        if head is None:
            yield None, None, "error", None, None, None, None, "page without a number"
            continue
        page = int(head[1])
        yield page, None, "heading", None, None, None, None, f"Page {page}"
        for block, text in enumerate(x for x in body[head.end() :].strip("\n").split("\n\n") if x):
            try:
                if text.strip("\n") == "---":
                    yield page, block, "rule", None, None, None, None, "---"
                elif text.startswith("|"):
                    for r, row in enumerate(read_markdown(text)):
                        for c, cell in enumerate(row):
                            yield page, block, "cell", r, c, 1, 1, cell
                elif text.startswith("<table>"):
                    for r, c, rs, cs, cell in read_html(text):
                        yield page, block, "cell", r, c, rs, cs, cell
                else:
                    yield page, block, "text", None, None, None, None, text
            except ValueError as e:
                yield page, block, "error", None, None, None, None, str(e)


#: Pieces of one batch, about.
MOST_PIECES = 10_000


def composed_pieces(documents: DataFrame, markdown: str = "markdown") -> DataFrame:
    """A row for each piece of each composed document (a null has none), with the other columns of its row."""
    others = [c for c in documents.columns if c != markdown]
    schema = T.StructType([*documents.select(*others).schema.fields, *T.StructType.fromDDL(PIECES).fields])
    target = to_arrow_schema(schema)
    fields = list(target)[len(others) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = batch.column(len(others)), batch.select(range(len(others)))
            rows: list[tuple] = []
            owners: list[int] = []

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows)) or [()] * len(fields)
                own = [c.take(pa.array(owners, pa.int64())).cast(f.type) for c, f in zip(kept.columns, target)]
                return pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(columns, fields))], schema=target)

            for i in range(len(texts)):
                markdown = texts[i].as_py()
                if markdown is None:
                    continue
                before = len(rows)
                rows += read_composed(markdown)
                owners += [i] * (len(rows) - before)
                if len(rows) >= MOST_PIECES:
                    yield out()
                    rows, owners = [], []
            yield out()

    return documents.select(*others, markdown).mapInArrow(run, schema)


def check_composed(pieces: DataFrame, doc: str) -> DataFrame:
    """doc, pages, tables, cells, problems: what is wrong with a document's structure, in order.

    Pages are numbered upwards, one rule stands between two pages, everything can be read.
    """
    kind = lambda name: F.col("kind") == name
    per_page = pieces.groupBy(doc, "page").agg(
        F.count_if(kind("heading")).alias("headings"), F.count_if(kind("cell") & (F.col("r") == 0) & (F.col("c") == 0)).alias("tables"),  # each has one such cell
        F.count_if(kind("cell")).alias("cells"), F.count_if(kind("error")).alias("errors"), F.count_if(kind("rule")).alias("rules"),
    )
    paged = F.col("page").isNotNull()
    inside = lambda name: F.coalesce(F.sum(F.when(paged, F.col(name))), F.lit(0)).alias(name)
    both = per_page.groupBy(doc).agg(  # pieces are read once, also those between pages
        F.count("page").alias("pages"), inside("tables"), inside("cells"), F.coalesce(F.max(F.when(paged, F.col("headings"))), F.lit(0)).alias("headings"),
        inside("errors"), F.sum("rules").alias("rules"), F.coalesce(F.sum(F.when(~paged, F.col("errors"))), F.lit(0)).alias("loose"),
    )
    rules = (("page", (F.col("headings") == 1) & (F.col("loose") == 0)), ("rules", F.col("rules") == F.col("pages") - 1), ("unreadable", F.col("errors") == 0))
    return both.select(doc, "pages", "tables", "cells", F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules])).alias("problems"))
