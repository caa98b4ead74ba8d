"""Parsed pages to Markdown and HTML, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.bound import bound

UNSUPPORTED = "[Unsupported content; see raw DocTags.]"
UNSUPPORTED_LIST = "[Unsupported list content; see raw DocTags.]"
UNSUPPORTED_TABLE = "[Unsupported table; see raw DocTags.]"


def escape(text: Column) -> Column:
    """Literal text as Markdown: signs with a meaning get a backslash, markup becomes entities."""
    marked = F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-!|~=])", r"\\$1")
    marked = F.regexp_replace(marked, r"(?<=[0-9])\.", r"\\.")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        marked = F.replace(marked, F.lit(sign), F.lit(entity))
    return marked


def table_cell(text: Column) -> Column:
    return F.regexp_replace(escape(text), r"\r\n?|\n", "<br>")


def html_cell(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.regexp_replace(text, r"\r\n?|\n", "<br>")


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _rows(cells: Column, record: Column, row: callable) -> Column:
    """``row`` of each table row's cells, in order; the cells are row-major and all there."""
    width = record["columns"]
    return F.transform(F.sequence(F.lit(0), record["rows"] - 1), lambda r: row(F.slice(cells, r * width + 1, width)))


def cells_of(record: Column, cells: Column) -> Column:
    """A renderable table's own cells out of its page's."""
    return F.slice(cells, record["first"] + 1, record["rows"] * record["columns"])


def table(record: Column, cells: Column) -> Column:
    """Markdown of one table; HTML if a cell spans; a placeholder if it isn't renderable."""

    def tagged(cell: Column) -> Column:
        name = F.when(cell["kind"] == "column-header", "th").otherwise("td")
        span = lambda field, label: F.when(cell[field] > 1, F.concat(F.lit(f' {label}="'), cell[field].cast("string"), F.lit('"'))).otherwise("")
        return F.concat(
            F.lit("<"), name, span("rs", "rowspan"), span("cs", "colspan"), F.lit(">"), html_cell(cell["text"]), F.lit("</"), name, F.lit(">")
        )

    html = F.concat(
        F.lit("<table>\n"),
        F.array_join(
            _rows(
                cells,
                record,
                lambda own: F.concat(
                    F.lit("<tr>"), F.array_join(F.transform(F.filter(own, lambda c: c["kind"] != "span"), tagged), ""), F.lit("</tr>\n")
                ),
            ),
            "",
        ),
        F.lit("</table>"),
    )
    lines = _rows(cells, record, lambda own: _line(F.transform(own, lambda c: table_cell(c["text"]))))
    rule = _line(F.array_repeat(F.lit("---"), record["columns"]))
    headed = F.forall(F.slice(cells, 1, record["columns"]), lambda c: c["kind"] == "column-header")
    blank = _line(F.array_repeat(F.lit(""), record["columns"]))
    plain = bound(
        lines,
        lambda own: F.when(
            headed, F.array_join(F.concat(F.slice(own, 1, 1), F.array(rule), F.slice(own, 2, record["rows"])), "\n")
        ).otherwise(F.array_join(F.concat(F.array(blank, rule), own), "\n")),
    )
    return (
        F.when(~F.coalesce(record["renderable"], F.lit(False)), UNSUPPORTED_TABLE)
        .when(F.exists(cells, lambda c: (c["rs"] > 1) | (c["cs"] > 1)), html)
        .otherwise(plain)
    )


def _items(element: Column, elements: Column) -> Column:
    below = F.slice(elements, element["ordinal"] + 2, element["below"])
    own = F.filter(below, lambda e: e["parent"] == element["ordinal"])
    ordered = element["kind"] == "ordered-list"

    def item(child: Column, i: Column) -> Column:
        prefix = F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- ")
        text = F.replace(escape(child["text"]), F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(prefix))))
        return F.when(child["kind"] == "list-item", F.concat(prefix, text)).otherwise(UNSUPPORTED_LIST)

    return F.array_join(F.transform(own, item), "\n")


def element(e: Column, parsed: Column, picture: Column) -> Column:
    """Markdown of one top-level element."""
    kind, text = e["kind"], escape(e["text"])
    flat = escape(F.regexp_replace(e["text"], r"[\r\n]", " "))

    def tabled(record: Column) -> Column:
        own = F.when(record["renderable"], cells_of(record, parsed["cells"])).otherwise(F.slice(parsed["cells"], 1, 0))
        return bound(own, lambda cells: table(record, cells))

    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), e["level"] + 1), F.lit(" "), flat))
        .when(kind == "title", F.concat(F.lit("# "), flat))
        .when(kind.isin("text", "page-footer", "page-header", "footnote"), text)
        .when(kind == "list-item", F.concat(F.lit("- "), text))
        .when(kind.isin("ordered-list", "unordered-list"), _items(e, parsed["elements"]))
        .when(kind == "table", bound(F.get(parsed["tables"], e["table"]), tabled))
        .when(kind == "picture", F.concat(F.lit("![Picture]("), picture, F.lit(")")))
        .otherwise(UNSUPPORTED)
    )


def safe_path(path: Column) -> Column:
    return path.rlike(r"\Aassets/[\p{L}\p{N}._-]+\z") & (F.length(path) < 256) & ~F.contains(path, F.lit(".."))


def to_markdown(parsed: Column, allow_partial: bool = False, pictures: Column | None = None) -> Column:
    """Markdown of a page, or null where it's blocked.

    Any diagnostic blocks, unless partial output is asked for, which begins with
    a warning. Every picture needs one safe path, in partial output too.
    """
    top = F.filter(parsed["elements"], lambda e: e["parent"].isNull())
    paths = pictures if pictures is not None else F.array().cast("array<string>")
    shown = F.filter(top, lambda e: e["kind"] == "picture")
    blocks = F.transform(
        top,
        lambda e: element(e, parsed, F.coalesce(F.get(paths, F.size(F.filter(shown, lambda p: p["ordinal"] < e["ordinal"]))), F.lit(""))),
    )
    body = F.when(F.size(top) == 0, "").otherwise(F.concat(F.array_join(blocks, "\n\n"), F.lit("\n")))
    n = F.size(parsed["diagnostics"])
    warning = F.concat(
        F.lit("> WARNING: Partial/unverified conversion ("), n.cast("string"), F.lit(" diagnostics). Retain and inspect raw DocTags.\n\n")
    )
    fine = parsed["fatal_error"].isNull() & (F.size(shown) == F.size(paths)) & F.forall(paths, safe_path)
    if allow_partial:
        return F.when(fine, F.when(n > 0, F.concat(warning, body)).otherwise(body))
    return F.when(fine & (n == 0), body)
