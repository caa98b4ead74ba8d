"""License scans: an exact set-similarity join of text blocks with notice templates.

A block is a line, or a window of words across lines that is twice as long as
the notice; a template is the word set of a notice. A block matches if it holds
at least ``CONTAINED`` percent of the template's words. The join is exact:
template words are ordered by their frequency over the whole corpus, rarest
first, and a block can only match if it has a word of the template's prefix
(prefix filter), enough words (length filter) and, behind the first shared word
in that order, enough words on both sides (positional filter). What passes is
checked in full.

Only DataFrame functions are used. Templates are a fixed, small list, so their
side of the join is a constant inside each row's expression: nothing but word
counts is shuffled, and no row leaves its task. Windows are only looked at
around places of prefix words, each in time bounded by the window.

Defined results: words and phrases are cut and compared as the base scan says
(A-Z without case, every ASCII sign that is no letter or digit parts words); a
null or empty text has no words, no places and no labels (the empty string) and
a score of 0; equal rows get equal results each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import ascii_lower, need, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts words, in texts of any case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Base phrases and labels, fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: (label, notice): the method's templates.
TEMPLATES = (
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINED = 90
#: Words of a window for each word of the notice.
WINDOW = 2


def _needed(n: int) -> int:
    return -(-CONTAINED * n // 100)


def phrase_pattern(phrase: str) -> str:
    """The phrase's words in a row, as whole words, in any A-Z case."""
    inside = rf"{GAP}+".join(phrase.split())
    edge = r"[0-9A-Za-z[^\x00-\x7F]]"
    return rf"(?<!{edge})(?i:{inside})(?!{edge})"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_ANY)).cast("long")


#: The same words without lowering the text first.
WORD_ANY = r"[0-9A-Za-z[^\x00-\x7F]]+"


def places(text: Column, n_words: Column) -> list[tuple[str, Column]]:
    """Per base phrase its label and struct(n, first, last) of its places, null where it has none.

    The text is split at the phrase; words in the first and last part give the
    places' word numbers, so nothing is done for texts without the phrase.
    """
    def spread(width: int):
        return lambda parts: F.struct(
            (F.size(parts) - 1).cast("long").alias("n"),
            _words(F.get(parts, F.lit(0))).alias("first"),
            (n_words - _words(F.get(parts, F.size(parts) - 1)) - F.lit(width)).alias("last"),
        )

    out = []
    for phrase, label in PHRASES:
        pattern = phrase_pattern(phrase)
        found = F.transform(F.array(F.split(text, pattern, -1)), spread(len(phrase.split())))[0]
        some = F.lower(text).contains(phrase.split()[0]) & F.lower(text).contains(phrase.split()[-1])
        out.append((label, F.when(some & text.rlike(pattern), found)))  # the substrings are the cheap test
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, notice in TEMPLATES for w in notice.split()})


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): documents that hold each template word, over the whole corpus.

    Only template words are counted, at most one row per word and task is shuffled.
    """
    known = F.array(*[F.lit(w) for w in vocabulary()])
    words = F.array_intersect(F.split(ascii_light(F.col("text")), f"{GAP}+", -1), known)
    rows = need(docs, text="string").where("text IS NOT NULL").select(F.explode(words).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def ascii_light(text: Column) -> Column:
    """Lower case for matching ASCII words; other characters may change too."""
    return F.lower(text)


def templates(counts: dict[str, int]) -> tuple[list[dict], list[str]]:
    """The templates with words and prefix in the corpus's order, rarest first, and all their words in that order."""
    order = sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, notice in TEMPLATES:
        words = sorted(set(notice.split()), key=rank.get)
        least = _needed(len(words))
        out.append(
            {"label": label, "words": words, "need": least, "prefix": words[: len(words) - least + 1], "width": WINDOW * len(notice.split())}
        )
    return out, order


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _constant(found: list[dict]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(t["label"]).alias("label"), _strings(t["words"]).alias("words"), F.lit(t["need"]).alias("need"),
                _strings(t["prefix"]).alias("prefix"), F.lit(t["width"]).alias("width"),
            )
            for t in found
        ]
    )


def passes(template: Column, known: Column) -> Column:
    """Prefix, length and positional filter of a block's template words ``known``, which are in the corpus's order.

    Before the first shared word neither side has a common one, so what is
    shared is that word and at most the rest of the shorter side.
    """
    first = F.get(F.array_intersect(known, template["prefix"]), F.lit(0))
    rest = F.least(
        F.size(template["words"]) - F.array_position(template["words"], first), F.size(known) - F.array_position(known, first)
    )
    return (F.size(known) >= template["need"]) & F.coalesce(rest + 1 >= template["need"], F.lit(False))


def _match(template: Column, shared: Column) -> Column:
    """struct(label, score) of a template with that many shared words, null for too few."""
    return F.when(
        shared >= template["need"], F.struct(template["label"].alias("label"), (shared / F.size(template["words"])).alias("score"))
    )


def line_matches(text: Column, found: list[dict], order: list[str]) -> Column:
    """(label, score) of every line that holds enough of a template."""
    heads = sorted({w for t in found for w in t["prefix"]})

    def hopeful(line: Column) -> Column:
        light = ascii_light(line)
        some = F.lit(False)
        for w in heads:
            some = some | F.contains(light, F.lit(w))
        return some

    def matches(known: Column) -> Column:
        near = F.filter(_constant(found), lambda t: passes(t, known))
        return F.array_compact(F.transform(near, lambda t: _match(t, F.size(F.array_intersect(t["words"], known)))))

    def of_line(line: Column) -> Column:
        own = F.regexp_extract_all(ascii_lower(line), F.lit(WORD), F.lit(0))
        return bound(F.array_intersect(_strings(order), own), matches)

    return F.flatten(F.transform(F.filter(F.split(text, "\n", -1), hopeful), of_line))


def window_matches(text: Column, found: list[dict], order: list[str]) -> Column:
    """(label, score) of every window of words, across lines, that holds enough of a template.

    ``hits`` are the places of template words. Around each place of a prefix word
    only the hits within a window's width count, a slice of bounded size.
    """
    known_words = _strings(order)
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def of_template(hits: Column):
        def of_anchor(t: Column):
            def run(anchor: Column, j: Column) -> Column:
                begin = F.greatest(j - t["width"] + 2, F.lit(1))
                near = F.filter(
                    F.slice(hits, begin, 2 * t["width"]),
                    lambda h: (F.abs(h["i"] - anchor["i"]) < t["width"]) & F.array_contains(t["words"], h["w"]),
                )

                def counted(near: Column) -> Column:
                    inside = lambda s: F.size(
                        F.array_distinct(
                            F.transform(F.filter(near, lambda h: (h["i"] >= s["i"]) & (h["i"] < s["i"] + t["width"])), lambda h: h["w"])
                        )
                    )
                    starts = F.filter(near, lambda s: s["i"] <= anchor["i"])
                    known = F.array_intersect(t["words"], F.transform(near, lambda h: h["w"]))
                    return F.when(passes(t, known), _match(t, F.array_max(F.transform(starts, inside))))

                return F.when(F.array_contains(t["prefix"], anchor["w"]), bound(near, counted))

            return run

        return lambda t: F.array_compact(F.transform(hits, of_anchor(t)))

    def matches(hits: Column) -> Column:
        # a template whose words the whole text lacks has no window
        known = F.array_intersect(known_words, F.transform(hits, lambda h: h["w"]))
        near = bound(known, lambda k: F.filter(_constant(found), lambda t: passes(t, F.array_intersect(t["words"], k))))
        return F.flatten(F.transform(near, of_template(hits)))

    return bound(F.filter(placed, lambda p: F.array_contains(known_words, p["w"])), matches)


def contained(text: Column, counts: dict[str, int]) -> Column:
    """(label, score) of all blocks of a text that hold enough of a template; score is the share of its words.

    Texts without any prefix word are left out by plain substring tests.
    """
    found, order = templates(counts)
    light = ascii_light(text)
    some = F.lit(False)
    for w in sorted({w for t in found for w in t["prefix"]}):
        some = some | F.contains(light, F.lit(w))
    none = F.array().cast("array<struct<label:string,score:double>>")
    return F.when(some, F.array_union(line_matches(text, found, order), window_matches(text, found, order))).otherwise(none)


def labelled(label: str):
    """A place struct with its label, null for null."""
    fields = ("n", "first", "last")
    return lambda x: F.when(x.isNotNull(), F.struct(F.lit(label).alias("label"), *[x[f].alias(f) for f in fields]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per input row.

    ``score`` is 1 for a base phrase, else the best share of a template.
    """
    rows = need(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n_words", _words(F.col("text")))
    rows = rows.withColumn(
        "base",
        F.array(
            *[
                F.transform(
                    F.array(found),
                    labelled(label),
                )[0]
                for label, found in places(F.col("text"), F.col("n_words"))
            ]
        ),
    )
    counts = {r["word"]: r["n"] for r in frequencies(docs).collect()}  # at most the templates' words
    base = rows.select("doc_id", "n_words", F.array_compact("base").alias("base"), contained(F.col("text"), counts).alias("more"))
    return (
        base.select(
            "doc_id",
            "n_words",
            F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
            F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
            F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
            F.array_join(F.array_sort(F.transform("base", lambda x: x["label"])), ",").alias("base_labels"),
            F.array_join(
                F.array_sort(F.array_union(F.transform("base", lambda x: x["label"]), F.transform("more", lambda x: x["label"]))), ","
            ).alias("labels"),
            F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("more", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        )
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    spots = []
    for phrase, label in PHRASES:
        words = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(words))
        spots.append(
            f"SELECT row_id, '{label}' AS label, len(hits) AS n, hits[1] - 1 AS f, hits[-1] - 1 AS l FROM ("
            f"SELECT row_id, list_filter(range(1, len(words) + 1), lambda i: {same}) AS hits FROM w) WHERE len(hits) > 0"
        )
    notices = ", ".join(
        "('{}', [{}], {}, {})".format(label, ", ".join(f"'{w}'" for w in ws), len(ws), _needed(len(ws)))
        for label, ws in ((label, sorted(set(notice.split()))) for label, notice in TEMPLATES)
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
w AS (SELECT row_id, doc_id, text, regexp_extract_all(text, '{word}') AS words FROM d),
b AS ({" UNION ALL ".join(spots)}),
base AS (
  SELECT row_id, sum(n)::BIGINT AS n_base, min(f)::BIGINT AS first_word, max(l)::BIGINT AS last_word,
         string_agg(label, ',' ORDER BY label) AS base_labels, list(label) AS own FROM b GROUP BY row_id),
t AS (SELECT * FROM (VALUES {notices}) AS x(label, notice, size, need)),
lines AS (
  SELECT row_id, list_distinct(regexp_extract_all(line, '{word}')) AS own
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (
  SELECT row_id, label, len(list_intersect(own, notice)) / size AS score FROM lines, t
  WHERE len(list_intersect(own, notice)) >= need),
best AS (SELECT row_id, list_distinct(list(label)) AS more, max(score) AS best FROM m GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END)::DOUBLE AS score
FROM w LEFT JOIN base USING (row_id) LEFT JOIN best USING (row_id)
"""


ORACLE_SQL = _oracle()
