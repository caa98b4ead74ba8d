import hashlib
import re

import pytest

from docflow.llm import pii


def plain(text):
    """The forms as they are written down, with the usual engine."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    "a@b.c@d.e f@g",
    "x.y+z@mail-1.example.com.",
    "..@..a@a.b",
    "@a.b a@@b.c a@b..c a@b.c-d.e",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 12345678901234567890",
    "+1 (555) 555-0100 +12345 +1-2-3-4-5-6-7-8-9) +1234567890123456",
    "é+49 30 1234567 ü 😀 a@ß.de 192.168.0.1",
    "1" * 3000,
    "a" * 3000 + "@",
    "1." * 2000,
    "+" * 100 + "1 2 3 4 5 6 7 8 9",
]


@pytest.mark.parametrize("text", TEXTS)
def test_forms(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000 + "@", "1" * 2_000_000, "a@" * 500_000, "1.1.1" * 300_000, "+1" * 500_000):
        pii.occurrences(text, pii.base_spans(text))


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op5_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert r["base_sha256"] == hashlib.sha256(pii.digest(want).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert set(pii.digest(want).split(",")) - {""} <= set(spans)
        assert len(spans) == len(want) + r["n_added"]


def docs_with_contexts(spark):
    rows = [(i, f"Hello there, please call me at +1 (212) 555-01{i:02d} or so, text {i}.") for i in range(30)]
    rows += [(100, "Well, call me at 212-555-0177 today."), (101, "About 212-555-0188 things were sold.")]
    rows += [(102, "Well, call me at noon.")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_unseen_numbers(spark):
    found = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in pii.find(docs_with_contexts(spark)).collect()}
    assert found[100] == [("phone", 17, 29)]
    assert not any(v for k, v in found.items() if k != 100)


def test_redaction(spark):
    docs = docs_with_contexts(spark).withColumnRenamed("doc_id", "own").selectExpr("own AS doc_id", "text", "'c' AS base")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[3] == "Hello there, please call me at [PHONE] or so, text 3."
    assert out[100] == "Well, call me at [PHONE] today."
    assert out[102] == "Well, call me at noon."


def test_overlaps_go_as_one():
    assert pii.masked("x 4111 1111 1111 1111 y", [("phone", 7, 23)]) == "x [CARD]"


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["base"] or r["added"] for r in rows)
    same = pii.redact(odd_docs)
    assert same.columns == odd_docs.columns and sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.find(no_docs).collect() == [] and pii.redact(no_docs).collect() == []


def test_every_kind_has_candidates(spark):
    def card(i):
        body = f"4111 1111 1111 {i:03d}"
        return next(body + str(d) for d in range(10) if pii.luhn((body + str(d)).replace(" ", "")))

    rows = [(i, f"So the server address is 10.0.0.{i} here.") for i in range(30)]
    rows += [(100 + i, f"Now please charge card {card(i)} here.") for i in range(30)]
    rows += [(200 + i, f"Then call me at +1 212 555 01{i:02d} here.") for i in range(30)]
    wrong = card(7)[:-1] + str((int(card(7)[-1]) + 1) % 10)
    want = {
        900: ("ip", "So the server address is ", "2001:db8::1"),
        901: ("ip", "So the server address is ", "fe80::"),
        902: ("ip", "So the server address is ", "300.1.2.3"),
        903: ("card", "Now please charge card ", wrong),
        904: ("phone", "Then call me at ", "212 555 0177"),
    }
    rows += [(i, f"{before}{x} today.") for i, (_, before, x) in want.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in pii.find(docs).collect()}
    for i, (kind, before, x) in want.items():
        assert found[i] == [(kind, len(before), len(before) + len(x))]
    assert not any(v for k, v in found.items() if k not in want)
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[900] == "So the server address is [IP] today." and out[904] == "Then call me at [PHONE] today."
