"""Recognition scores: edit rates, cell multisets, box overlap, selection, timings."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators.corpus import normalized
from docflow.sources.files import stored


#: First width of the band on either side of the diagonal; it doubles until the distance fits.
FIRST_BAND = 32


def edit_distance(a: str | list, b: str | list) -> int:
    """Unit-cost Levenshtein distance of two sequences.

    Equal ends are cut off. The table is then filled in a band around its
    diagonal only, which doubles until the distance fits into it (Ukkonen), so
    near texts of any length cost little more than their length. A column of the
    band is two rows of bits of differences (Myers), a few operations on integers.
    No distance is below the difference of the lengths, which it is exactly if one
    is a subsequence of the other, nor below the elements that have no like on the
    other side: no band begins below that.
    """
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    rest = iter(b)
    if all(x in rest for x in a):
        return len(b) - len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    others = Counter(b)
    band = max(FIRST_BAND, len(b) - sum(min(len(own), others[x]) for x, own in places.items()))
    while 2 * band < len(a):
        distance = _banded(places, len(a), b, band)
        if distance <= band:
            return distance
        band *= 2
    return _whole(places, len(a), b)


def _whole(places: dict, rows: int, b: str | list) -> int:
    """The distance from whole columns of the table."""
    at = {x: _bits(own, rows) for x, own in places.items()}
    mask, last = (1 << rows) - 1, 1 << (rows - 1)
    up, down, distance = mask, 0, rows
    for y in b:
        same = at.get(y, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (mask & ~(horizontal | up))
        minus = up & horizontal
        distance += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1) | 1, minus << 1
        up = (minus | ~(vertical | plus)) & mask
        down = plus & vertical & mask
    return distance


def _bits(places: list[int], size: int) -> int:
    row = bytearray(size // 8 + 1)
    for i in places:
        row[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(row, "little")


def _banded(places: dict, rows: int, b: str | list, band: int) -> int:
    """The distance, if it is at most ``band``, else some number above it.

    Bit t of a column's integers stands for row (column - band + t), counted
    from 0, so the window moves down a row with each column. The value is
    followed along the band's lowest diagonal to the last row, then along that.
    The places of an element are kept in overlapping blocks of two widths, so a
    window is one shift of one of them.
    """
    width = 2 * band + 1
    at: dict = {}
    for x, own in places.items():
        blocks = at[x] = {}
        for i in own:
            block, bit = divmod(i, width)
            blocks[block] = blocks.get(block, 0) | 1 << bit
            blocks[block - 1] = blocks.get(block - 1, 0) | 1 << (bit + width)
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down, distance = mask >> band << band, 0, band
    for column, y in enumerate(b):
        block, shift = divmod(column - band, width)
        same = (at[y].get(block, 0) >> shift) & mask if y in at else 0
        zero = ((((same & up) + up) ^ up) | same | down) & mask
        plus, minus = (down | ~(zero | up)) & mask, zero & up
        below = column + band + 1 - rows  # of how many rows the window lies below the table
        if below <= 0:
            distance += not zero & top
        else:
            last = top >> below
            distance += bool(plus & last) - bool(minus & last)
        zero >>= 1
        up, down = (minus | ~(zero | plus)) & mask, zero & plus
    return distance


@F.arrow_udf(T.LongType())
def character_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distance over characters; null where a side is null."""
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


@F.arrow_udf(T.LongType())
def word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distance over words; null where a side is null."""
    return pa.array(
        [
            None if x is None or y is None else edit_distance(x.split(), y.split())
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)
        ],
        pa.int64(),
    )


def score_cases(cases: DataFrame) -> DataFrame:
    """Adds strict, accepted, edits and lengths to (reference, markdown, stop_reason, n_diagnostics, error).

    A page that fails scores as empty output; without a reference everything stays null.
    """
    strict = F.coalesce(
        F.col("error").isNull() & (F.col("stop_reason") == "eos") & (F.col("n_diagnostics") == 0) & F.col("markdown").isNotNull(), F.lit(False)
    )
    rows = cases.withColumns({"strict": strict, "expected": normalized(F.col("reference"))})
    rows = rows.withColumn("actual", F.when(F.col("strict"), normalized(F.col("markdown"))).otherwise(""))
    words = lambda c: F.size(F.array_remove(F.split(c, " ", -1), ""))
    rows = rows.withColumns(
        {
            "character_edits": character_edits("expected", "actual"),
            "reference_characters": F.length("expected").cast("long"),
            "word_edits": word_edits("expected", "actual"),
            "reference_words": F.when(F.col("expected").isNotNull(), words(F.col("expected"))).cast("long"),
            "accepted": F.col("strict") & (F.col("expected") == F.col("actual")),
        }
    )
    return rows.withColumn("accepted", F.when(F.col("expected").isNotNull(), F.col("accepted"))).drop("actual")


def summarize(scored: DataFrame, split: str = "split") -> DataFrame:
    """Micro rates per split: sums of edits over sums of lengths, null without a length."""
    sums = {c: F.sum(c).alias(c) for c in ("character_edits", "reference_characters", "word_edits", "reference_words")}
    return (
        scored.groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count("expected").alias("reviewed"),
            F.count_if("strict").alias("strict_exports"),
            F.coalesce(F.count_if("accepted"), F.lit(0)).alias("accepted"),
            *sums.values(),
        )
        .withColumn("cer", F.try_divide("character_edits", "reference_characters"))
        .withColumn("wer", F.try_divide("word_edits", "reference_words"))
    )


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per ``by``: n_left, n_right and matches, the size of the multiset intersection over keys."""
    side = lambda rows, x: rows.select(*by, *keys, F.lit(x).alias("x"), F.lit(1 - x).alias("y"))
    both = side(left, 1).unionByName(side(right, 0)).groupBy(*by, *keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return both.groupBy(*by).agg(
        F.sum("x").alias("n_left"), F.sum("y").alias("n_right"), F.sum(F.least("x", "y")).alias("matches")
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (l, t, r, b) boxes."""
    width = F.greatest(F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.lit(0))
    height = F.greatest(F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), F.lit(0))
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    return width * height / (area(a) + area(b) - width * height)


def choose_candidate(scores: DataFrame) -> DataFrame:
    """The step with the most accepted pages, then exact cells, then the smallest step."""
    best = scores.groupBy("step").agg(F.sum("accepted").alias("accepted"), F.sum("cells").alias("cells"))
    return best.orderBy(F.desc("accepted"), F.desc("cells"), "step").limit(1)


#: Groups up to so many have their medians' buckets broadcast (about 100 bytes each); more of them spread a shuffle well.
MANY_GROUPS = 50_000
#: Buckets of a doubling of the value, then cells of a bucket.
PER_DOUBLING, CELLS = 64, 4096


def timing_summary(samples: DataFrame, *by: str, value: str = "seconds") -> DataFrame:
    """Number, exact median, least and most of finite non-negative samples.

    The median is found by counting, not by gathering: a histogram of logarithms
    names the bucket of the middle, a finer one its cell, and only the values of
    that cell are ranked. So a few groups of very many samples are no few tasks.
    """
    fine = samples.where((F.col(value) >= 0) & (F.col(value) < F.lit(float("inf")))).select(*by, F.col(value).cast("double").alias("v"))
    bucket = F.when(F.col("v") > 0, F.floor(F.log2("v") * PER_DOUBLING)).otherwise(F.lit(-(2**31))).cast("long")
    counted = stored(fine.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
    whole = counted.groupBy(*by).agg(F.sum("n").alias("samples"), F.min("least").alias("least"), F.max("most").alias("most"))
    middles = counted.withColumn("samples", F.sum("n").over(Window.partitionBy(*by)))
    middles = middles.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor((F.col("samples") - 1) / 2), F.floor(F.col("samples") / 2)))))

    def holding(rows, order):
        """The row of each group and rank whose counts hold the rank, with what is left of it."""
        upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy(order))
        return rows.withColumn("before", upto - F.col("n")).where("before <= left AND left < before + n").withColumn("left", F.col("left") - F.col("before")).drop("before", "n")

    found = stored(holding(middles.withColumn("left", F.col("rank")), "bucket").select(*by, "rank", "left", "bucket", "least", "most"))
    near = F.broadcast if found.count() <= MANY_GROUPS else (lambda df: df)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by] or [F.lit(True)]  # one row each without groups
    own = [F.col(f"x.{c}") for c in by]
    cell = F.when(F.col("most") > F.col("least"), F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * CELLS)).otherwise(0)
    inside = fine.alias("x").join(near(found).alias("y"), [*same, F.col("v").between(F.col("y.least"), F.col("y.most"))])
    cells = inside.select(*own, "rank", "left", cell.alias("cell"), "v").groupBy(*by, "rank", "left", "cell")
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    found = stored(holding(cells, "cell").select(*by, "rank", "left", "least", "most"))
    inside = fine.alias("x").join(near(found).alias("y"), [*same, F.col("v").between(F.col("y.least"), F.col("y.most"))])
    values = inside.select(*own, "rank", "left", "v").groupBy(*by, "rank", "left", "v").agg(F.count(F.lit(1)).alias("n"))
    median = holding(values, "v").groupBy(*by).agg(F.avg("v").alias("median"))
    joined = whole.alias("x").join(median.alias("y"), same)
    return joined.select(*own, "samples", "median", "least", "most")


def contiguous_steps(steps: DataFrame, run: str, step: str) -> DataFrame:
    """Per run whether its steps are 1, 2, ... without a gap."""
    order = Window.partitionBy(run).orderBy(step)
    marked = steps.select(run, (F.col(step) == F.coalesce(F.lag(step).over(order), F.lit(0)) + 1).alias("next"))
    return marked.groupBy(run).agg(F.bool_and("next").alias("contiguous"), F.count(F.lit(1)).alias("steps"))


def score_pictures(pages: DataFrame, threshold: float) -> DataFrame:
    """Adds picture_count_exact, picture_iou and accepted to scored pages with one-picture references.

    pages: strict, markdown_exact, structure_exact, asset_verified, expected_boxes, actual_boxes (arrays of
    struct l, t, r, b). A page that isn't strict has no overlap and isn't accepted.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0..1")
    single = (F.size("expected_boxes") == 1) & (F.size("actual_boxes") == 1)
    iou = box_iou(F.get("expected_boxes", F.lit(0)), F.get("actual_boxes", F.lit(0)))
    rows = pages.withColumn("picture_count_exact", F.col("strict") & single)
    rows = rows.withColumn("picture_iou", F.when(F.col("picture_count_exact"), iou))
    good = F.col("strict") & F.col("markdown_exact") & F.col("structure_exact") & F.col("asset_verified")
    return rows.withColumn("accepted", good & F.col("picture_count_exact") & F.coalesce(F.col("picture_iou") >= threshold, F.lit(False)))


def choose_least_edits(scores: DataFrame) -> DataFrame:
    """Most accepted pages, then fewest character and word edits, then the first place: the base wins ties."""
    sums = scores.groupBy("candidate", "place").agg(
        F.sum("accepted").alias("accepted"), F.sum("character_edits").alias("character_edits"), F.sum("word_edits").alias("word_edits")
    )
    return sums.orderBy(F.desc("accepted"), "character_edits", "word_edits", "place").limit(1)


def compare_runs(samples: DataFrame, outputs: DataFrame, stages: list[str]) -> DataFrame:
    """Per runtime and case the median of each stage, and whether all runtimes had the same output.

    samples: runtime, case, stage, seconds. outputs: runtime, case, output.
    """
    medians = samples.groupBy("runtime", "case").pivot("stage", stages).agg(F.median("seconds"))
    same = outputs.groupBy("case").agg((F.count_distinct("output") == 1).alias("same_output"))
    return medians.join(same, "case")


def differing_fields(left: str, right: str, fields: list[str]) -> Column:
    """Names of the fields in which two struct columns differ; nulls are equal to each other."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), f) for f in fields]))


def untagged(raw: Column) -> Column:
    """Raw text with every tag as a blank: diagnostic text, nothing is repaired."""
    return normalized(F.regexp_replace(raw, "<[^>]*>", " "))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, " ", -1), "")


@F.arrow_udf(T.IntegerType())
def inventory(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the multiset intersection of two arrays of strings; null where a side is null."""
    sizes = [None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.array(sizes, pa.int32())


def score_coverage(cases: DataFrame) -> DataFrame:
    """Adds lexical scores of untagged raw text to (expected, raw, stop_reason, n_diagnostics, markdown_written).

    Word order counts for the edits and not for ``inventory_matches``.
    """
    rows = cases.withColumns({"expected_text": normalized(F.col("expected")), "recognized_text": untagged(F.coalesce("raw", F.lit("")))})
    wanted, found = _words(F.col("expected_text")), _words(F.col("recognized_text"))
    rows = rows.withColumns(
        {
            "character_edits": character_edits("expected_text", "recognized_text"),
            "reference_characters": F.length("expected_text").cast("long"),
            "word_edits": word_edits("expected_text", "recognized_text"),
            "reference_words": F.size(wanted).cast("long"),
            "inventory_matches": inventory(wanted, found).cast("long"),
            "text_exact": F.col("expected_text") == F.col("recognized_text"),
        }
    )
    good = F.col("text_exact") & (F.col("stop_reason") == "eos") & (F.col("n_diagnostics") == 0) & F.col("markdown_written")
    return rows.withColumns(
        {
            "cer": F.try_divide("character_edits", "reference_characters"),
            "wer": F.try_divide("word_edits", "reference_words"),
            "accepted": F.coalesce(good, F.lit(False)),
        }
    )


def cell_inventory(tables: Column) -> Column:
    """All cells of an array of tables as texts ``table,r,c,rs,cs,text``, blanks of the text collapsed."""
    cell = lambda i: lambda c: F.concat_ws(
        ",", i.cast("string"), *[c[f].cast("string") for f in ("r", "c", "rs", "cs")], F.coalesce(normalized(c["text"]), F.lit(""))
    )
    return F.flatten(F.transform(tables, lambda t, i: F.transform(t["cells"], cell(i))))


def score_page(pages: DataFrame) -> DataFrame:
    """Scores of one expected table per page: expected_tables and tables (arrays of rows, columns, renderable, cells).

    A page is comparable if exactly one renderable table was found; otherwise no
    cell matches. The word inventory ignores reading order; nothing expected
    gives a recall of 1.
    """
    one = (F.size("tables") == 1) & F.get("tables", F.lit(0))["renderable"]
    rows = pages.withColumns(
        {
            "comparable": F.coalesce(one, F.lit(False)),
            "wanted": cell_inventory(F.col("expected_tables")),
            "found": cell_inventory(F.col("tables")),
        }
    )
    rows = rows.withColumn("exact_cell_matches", F.when(F.col("comparable"), inventory(F.col("wanted"), F.col("found"))).otherwise(0).cast("long"))
    first = lambda c: F.get(c, F.lit(0))
    same_size = (first("expected_tables")["rows"] == first("tables")["rows"]) & (first("expected_tables")["columns"] == first("tables")["columns"])
    text = F.array_join(F.flatten(F.transform("expected_tables", lambda t: F.transform(t["cells"], lambda c: c["text"]))), " ")
    words = _words(normalized(text))
    rows = rows.withColumns(
        {
            "expected_cells": F.size("wanted").cast("long"),
            "recognized_cells": F.size("found").cast("long"),
            "exact_table": F.col("comparable") & same_size & (F.array_sort("wanted") == F.array_sort("found")),
            "matched_words": inventory(words, _words(untagged(F.coalesce("raw", F.lit(""))))).cast("long"),
            "expected_words": F.size(words).cast("long"),
        }
    )
    good = F.col("exact_table") & (F.col("stop_reason") == "eos") & (F.col("n_diagnostics") == 0) & F.col("markdown_written")
    return rows.withColumns(
        {
            "table_accepted": F.coalesce(good, F.lit(False)),
            "word_recall": F.coalesce(F.try_divide("matched_words", "expected_words"), F.lit(1.0)),
        }
    ).drop("wanted", "found")


def score_document(cases: DataFrame) -> DataFrame:
    """Benchmark scores of whole documents: strict Markdown, cells of all tables, and untagged raw text.

    cases: markdown_reference, text_reference, expected_tables, markdown, raw,
    stop_reason, n_diagnostics, error, tables. A missing output or a recorded
    error stays as a row with empty output.
    """
    strict = F.coalesce(
        F.col("error").isNull() & (F.col("stop_reason") == "eos") & (F.col("n_diagnostics") == 0) & F.col("markdown").isNotNull(), F.lit(False)
    )
    none = F.array().cast("array<struct<rows:int,columns:int,renderable:boolean,cells:array<struct<r:int,c:int,rs:int,cs:int,text:string>>>>")
    shapes = lambda c: F.transform(c, lambda t: F.struct(t["rows"], t["columns"]))
    rows = cases.withColumns({"strict_export": strict, "tables": F.coalesce("tables", none)})
    rows = rows.withColumns(
        {
            "reference": normalized(F.col("markdown_reference")),
            "actual": F.when(F.col("strict_export"), normalized(F.col("markdown"))).otherwise(""),
            "reference_text": normalized(F.coalesce("text_reference", "markdown_reference")),
            "raw_text": untagged(F.coalesce("raw", F.lit(""))),
            "wanted": cell_inventory(F.col("expected_tables")),
            "found": cell_inventory(F.col("tables")),
        }
    )
    rows = rows.withColumns(
        {
            "markdown_exact": F.col("reference") == F.col("actual"),
            "tables_exact": (shapes(F.col("expected_tables")) == shapes(F.col("tables"))) & (F.array_sort("wanted") == F.array_sort("found")),
            "exact_cell_matches": inventory(F.col("wanted"), F.col("found")).cast("long"),
            "character_edits": character_edits("reference", "actual"),
            "reference_characters": F.length("reference").cast("long"),
            "word_edits": word_edits("reference", "actual"),
            "reference_words": F.size(_words(F.col("reference"))).cast("long"),
            "raw_text_character_edits": character_edits("reference_text", "raw_text"),
            "raw_text_reference_characters": F.length("reference_text").cast("long"),
            "raw_text_word_edits": word_edits("reference_text", "raw_text"),
            "raw_text_reference_words": F.size(_words(F.col("reference_text"))).cast("long"),
            "execution_error": F.col("error").isNotNull(),
        }
    )
    rows = rows.withColumn("accepted", F.col("strict_export") & F.col("markdown_exact") & F.col("tables_exact"))
    return rows.drop("reference", "actual", "reference_text", "raw_text", "wanted", "found")


#: (rate, edits, length) of a run summary.
RATES = (
    ("markdown_cer", "character_edits", "reference_characters"),
    ("markdown_wer", "word_edits", "reference_words"),
    ("raw_text_cer", "raw_text_character_edits", "raw_text_reference_characters"),
    ("raw_text_wer", "raw_text_word_edits", "raw_text_reference_words"),
)


def run_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Counts and micro rates of scored documents; a rate without a length is null. Parser-valid and exact are kept apart."""
    have = [r for r in RATES if r[1] in scored.columns]
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("strict_export").alias("strict_exports"),
        F.count_if("accepted").alias("accepted"),
        F.count_if("execution_error").alias("execution_failures"),
        *[F.try_divide(F.sum(edits), F.sum(total)).alias(rate) for rate, edits, total in have],
    )


def load_outputs(cases: DataFrame, outputs: DataFrame, errors: DataFrame, most_tokens: int) -> DataFrame:
    """cases (name) with their stored output or why there is none; ``problem`` names an inconsistent record.

    outputs: name, raw, stored_raw, token_ids, stop_reason. errors: name, error.
    """
    both = cases.join(outputs, "name", "left").join(errors, "name", "left")
    status = (
        F.when(F.col("error").isNotNull(), "recorded-execution-error")
        .when(F.col("raw").isNull() | F.col("stored_raw").isNull(), "missing-output")
        .otherwise("output")
    )
    fine = (
        (F.col("raw") == F.col("stored_raw"))
        & (F.size("token_ids") <= most_tokens)
        & F.col("stop_reason").isin("eos", "length", "unknown")
    )
    return both.withColumn("status", status).withColumn(
        "problem", F.when((F.col("status") == "output") & ~F.coalesce(fine, F.lit(False)), "inconsistent output")
    )


def split_phase_grid(scored: DataFrame, phases: list[str]) -> DataFrame:
    """Per split and phase accepted pages and exact cells: scored rows have split, phase, accepted, exact_cell_matches."""
    return scored.groupBy("split").pivot("phase", phases).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("accepted").alias("accepted"), F.sum("exact_cell_matches").alias("exact_cells")
    )


def grid_complete(scores: DataFrame, candidate: str, case: str) -> DataFrame:
    """(candidate, missing, repeated) of an incomplete candidate-by-case grid; no rows if it's whole."""
    cases = scores.select(case).distinct().agg(F.count(F.lit(1)).alias("n"))
    own = scores.groupBy(candidate).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(case).alias("cases"))
    return (
        own.join(F.broadcast(cases))
        .select(candidate, (F.col("n") - F.col("cases")).alias("missing"), (F.col("rows") - F.col("cases")).alias("repeated"))
        .where("missing > 0 OR repeated > 0")
    )


def single_table(raw: Column) -> Column:
    """The one table markup of an output, null if there is none or more."""
    found = F.regexp_extract_all(raw, F.lit("(?s)(<otsl>.*?</otsl>)"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def runtimes_agree(outputs: DataFrame, case: str) -> DataFrame:
    """(case, runtimes, agree): whether all runtimes gave the same ids, text and stop reason."""
    whole = F.sha2(F.to_json(F.struct("token_ids", "raw", "stop_reason")), 256)
    return outputs.groupBy(case).agg(F.count(F.lit(1)).alias("runtimes"), (F.count_distinct(whole) == 1).alias("agree"))


def trajectory_problems(steps: DataFrame, run: str = "run") -> DataFrame:
    """Per run what is wrong with its training steps (step, loss, handles, base_unchanged, adapter_changed).

    Steps follow without a gap, losses are finite and not negative, the number of
    handles stays as it begins and is positive.
    """
    order = Window.partitionBy(run).orderBy("step")
    marked = steps.withColumns(
        {"before": F.lag("step").over(order), "handles_before": F.coalesce(F.lag("handles").over(order), "handles")}
    )
    finite = (F.col("loss") >= 0) & (F.col("loss") < float("inf"))
    rules = (
        ("step", F.col("before").isNull() | (F.col("step") == F.col("before") + 1)),
        ("loss", finite),
        ("handles", (F.col("handles") == F.col("handles_before")) & (F.col("handles") > 0)),
        ("base", F.col("base_unchanged")),
        ("adapter", F.col("adapter_changed")),
    )
    broken = [F.bool_or(~F.coalesce(fine, F.lit(False))).alias(name) for name, fine in rules]
    found = marked.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), *broken)
    return found.select(run, "steps", F.array_compact(F.array(*[F.when(F.col(n), n) for n, _ in rules])).alias("problems"))


def resumed_equal(whole: DataFrame, resumed: DataFrame, after: int) -> DataFrame:
    """(steps, differing): steps behind ``after`` in either run, and those whose loss isn't exactly the same."""
    left = whole.where(F.col("step") > after).select("step", F.col("loss").alias("x"))
    both = left.join(resumed.select("step", F.col("loss").alias("y")), "step", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))


def signature(parsed: Column) -> Column:
    """Kind and level (0 without one) of each top-level element, in order."""
    top = F.filter(parsed["elements"], lambda e: e["parent"].isNull())
    return F.transform(top, lambda e: F.concat_ws(":", e["kind"], F.coalesce(e["level"], F.lit(0)).cast("string")))


def probe(parsed: Column, markdown: Column) -> Column:
    """A label's audit: distinct diagnostic codes in order of first appearance, and whether it renders strictly."""
    codes = F.array_distinct(F.transform(parsed["diagnostics"], lambda x: x["code"]))
    fatal = parsed["fatal_error"].isNotNull()
    return F.struct(F.when(fatal, F.array(F.lit("document-error"))).otherwise(codes).alias("codes"), markdown.isNotNull().alias("renderable"))


def loss_table(steps: DataFrame, run: str = "run") -> DataFrame:
    """Training steps with the change of the loss and the least loss so far, per run in step order."""
    order = Window.partitionBy(run).orderBy("step")
    return steps.withColumns({"change": F.col("loss") - F.lag("loss").over(order), "least": F.min("loss").over(order)})


def replay_differences(before: DataFrame, again: DataFrame) -> DataFrame:
    """(side, rows): rows that only the stored or only the recomputed result has, repeats counted; none means identical.

    Both sides meet in one grouping, with a plus for a stored row and a minus for a recomputed one.
    """
    columns = before.columns
    both = before.withColumn("weight_", F.lit(1)).unionByName(again.select(*columns).withColumn("weight_", F.lit(-1)))
    left_over = both.groupBy(*columns).agg(F.sum("weight_").alias("weight_")).where("weight_ <> 0")
    side = F.when(F.col("weight_") > 0, "stored").otherwise("recomputed").alias("side")
    return left_over.groupBy(side).agg(F.sum(F.abs("weight_")).cast("long").alias("rows"))
