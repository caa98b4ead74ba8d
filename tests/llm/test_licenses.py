import re

from docflow.llm import licenses


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(text):
    words = words_of(text)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    more, best = set(), 0.0
    for line in (text or "").split("\n"):
        own = set(words_of(line))
        for label, notice in licenses.TEMPLATES:
            t = set(notice.split())
            if 100 * len(t & own) >= licenses.CONTAINED * len(t):
                more.add(label)
                best = max(best, len(t & own) / len(t))
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | more)),
        1.0 if starts else best,
    )


TEXTS = [
    "MIT License mit-license, x MIT\nLicense",
    "cc by cc-by CC--BY ccby éMIT License é mit licenseé",
    "gnu general public license gnu GENERAL public licenses apache licence apache\x00license",
    "Redistribution and use in source and binary forms, with or without modification,\nare permitted",
    "x Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: y",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated files",
    "😀 mit license 日本 apache license",
    "license " * 3000 + "mit license",
]


def test_texts(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 50)), "doc_id long, text string")
    docs = docs.unionByName(odd_docs.select("doc_id", "text")).selectExpr("*", "'c' AS n_words", "'c' AS key")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in texts), key=str)
    assert licenses.scan(no_docs).collect() == []


def test_main_path_is_native(spark, sf_dir):
    plan = licenses.op3_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def windows(text):
    """(label, score) of all windows, tried one by one."""
    words = words_of(text)
    out = {}
    for label, notice in licenses.TEMPLATES:
        t = set(notice.split())
        width = licenses.WINDOW * len(notice.split())
        for i in range(len(words)):
            share = len(t & set(words[i : i + width])) / len(t)
            if 100 * len(t & set(words[i : i + width])) >= licenses.CONTAINED * len(t):
                out[label] = max(out.get(label, 0), share)
    return out


WRAPPED = [
    "Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated\n * documentation files (the \"Software\")",
    "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:\n 1.",
    "Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not use this file except in compliance\nwith the License.",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation",
    "permission\nis\nhereby\ngranted free of charge to any one getting a copy of this software and associated documentation files",
    "software and " * 400 + "this is free and unencumbered\nsoftware released into the public domain",
    " word ".join("this is free and unencumbered software released into the public domain".split()),
    " word two ".join("this is free and unencumbered software released into the public domain".split()).replace("two free", "two\nfree"),
]


def test_notices_across_lines(spark):
    docs = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")
    some = 0
    for r in licenses.scan(docs).collect():
        text = WRAPPED[r["doc_id"]]
        want = windows(text)
        lines = plain(text)
        labels = sorted(set(filter(None, lines[5].split(","))) | set(want))
        assert r["labels"] == ",".join(labels)
        assert r["score"] == (1.0 if lines[1] else max([lines[6], *want.values()]))
        some += bool(set(want) - set(lines[5].split(",")))
    assert some >= 4


def test_filters_cut_and_lose_nothing(spark):
    """All pairs of a block and a template: what the filters drop never matches, and they drop most."""
    import random

    random.seed(8)
    found, order = licenses.templates({w: i * 7 % 23 for i, w in enumerate(licenses.vocabulary())})
    rank = {w: i for i, w in enumerate(order)}
    blocks = []
    for t in found * 6:
        own = [w for w in t["words"] if random.random() < random.choice([0.3, 0.85, 0.97])] + random.sample(order, 12)
        blocks.append(sorted(set(own), key=rank.get))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, known array<string>")
    from pyspark.sql import functions as F

    kept = F.transform(F.filter(licenses._constant(found), lambda t: licenses.passes(t, F.col("known"))), lambda t: t["label"])
    passed = {(r["i"], x) for r in df.select("i", kept.alias("x")).collect() for x in r["x"]}
    matching = {(i, t["label"]) for i, b in enumerate(blocks) for t in found if len(set(b) & set(t["words"])) >= t["need"]}
    prefix = {(i, t["label"]) for i, b in enumerate(blocks) for t in found if set(b) & set(t["prefix"]) and len(b) >= t["need"]}
    assert matching <= passed < prefix and len(passed) < 0.8 * len(blocks) * len(found)
