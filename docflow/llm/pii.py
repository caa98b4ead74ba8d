"""Personal data by exact forms and bootstrapped contexts.

The exact forms (e-mail, IP, card, phone) are the seeds. Around them stand
lexical patterns: the one to three words before an entity, those behind it, and
the words next to it on both sides. What looks like an entity of a kind (of each
of the four) but misses its exact form is an unseen candidate. Patterns and
instances form a graph; Spark scores it in rounds: a pattern is as good as its
instances on average, seeds are certain, and an unseen instance is worth
``TRUST`` times its best pattern. So what unseen instances lend each other
shrinks from step to step, the scores converge by that factor in each round, and
``ROUNDS`` rounds leave less than a thousandth. Patterns that end with a high
confidence and enough distinct seeds in enough documents give their unseen
candidates as further spans.

Each text is scanned once in time proportional to its length: every form is
matched by an expression that never takes a character twice for one failure.

Defined results: offsets are code points, ends exclusive; a null or empty text
has no spans, and the digest of no spans is that of the empty string; equal
rows get equal results; added spans never overlap base spans or each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docflow.llm.common import durable, need, table, unused
from docflow.llm.words import chunks

KINDS = ("email", "ip", "card", "phone")
#: Words of a pattern on one side.
WIDTH = 3
#: Scoring: trust in unseen instances, rounds, least confidence, distinct seeds and documents of a pattern.
TRUST = 0.5
ROUNDS = 10
CONFIDENCE = 0.9
LEAST_SEEDS = 5
LEAST_DOCS = 5
#: Bytes of added spans that may be broadcast to the texts.
BROADCAST_BYTES = 16_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Loose forms of each kind, after white space; the exact forms are taken out before. What
#: fits several kinds is a candidate of each, and the patterns' scores decide.
LIKE = {
    "email": re.compile(r"(?<!\S)[^\s@<>\"]{1,64}@[^\s@<>\"]{2,255}"),
    "ip": re.compile(
        r"(?<!\S)(?:(?=:{0,2}[0-9A-Fa-f])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?:(?<=[0-9A-Fa-f])|(?<=::))(?:\.[0-9]{1,3}){0,3}"
        r"|[0-9]{1,4}(?:\.[0-9]{1,4}){3,5})(?![0-9A-Za-z])"
    ),
    "card": re.compile(r"(?<!\S)[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9]|[0-9A-Za-z])"),
    "phone": re.compile(r"(?<!\S)\(?\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![().-]{0,2}[0-9])(?![0-9.-]{0,20}[A-Za-z])"),
}
DIGIT = re.compile(r"[0-9]")
CLOSING = re.compile(r"[.,;:!?)]{0,3}")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in IP.finditer(text):
        if m[2] is not None and all(_octet(x) for x in (m[1], m[2][1:], m[3][1:], m[4][1:])):
            out.append(m.span())
    return out


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and int(digits) <= 255)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits with separators
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact forms, by kind as listed and then by start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [("ip", a, b) for a, b in _ips(text)]
        out += [("card", a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [("phone", a, b) for a, b in _phones(text)]
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _near(text: str, place: int, step: int) -> list[str]:
    """Up to WIDTH whole words next to a place, the nearest first; step is -1 before it and 1 behind it."""
    reach = 64
    while True:
        a, b = (max(0, place - reach), place) if step < 0 else (place, min(len(text), place + reach))
        words = text[a:b].split()
        at_end = a == 0 if step < 0 else b == len(text)
        if at_end or len(words) > WIDTH:
            break  # the last one seen may be cut and is one too many
        reach *= 4
    return words[: -WIDTH - 1 : -1] if step < 0 else words[:WIDTH]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns at a place, lower-cased, digits as 0; ``_`` stands for the entity."""
    before = _near(text, start, -1) if start and text[start - 1].isspace() else []
    after = CLOSING.match(text, end).end()  # an entity may close a clause
    behind = _near(text, after, 1) if after < len(text) and text[after].isspace() else []
    left = [" ".join(before[:n][::-1]) for n in range(1, len(before) + 1)]
    right = [" ".join(behind[:n]) for n in range(1, len(behind) + 1)]
    both = [f"{before[0]} _ {behind[0]}"] if before and behind else []
    return [DIGIT.sub("0", x.lower()) for x in [*(f"{x} _" for x in left), *(f"_ {x}" for x in right), *both]]


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, list[str], str, bool, int, int]]:
    """(kind, patterns, instance, is seed, start, end) of seeds and of unseen candidates."""
    out = [(kind, patterns(text, a, b), text[a:b], True, a, b) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    numbers = DIGIT.search(text) is not None
    for kind, form in LIKE.items():
        if not ("@" in text if kind == "email" else numbers or (kind == "ip" and "::" in text)):
            continue
        i = 0
        for m in form.finditer(text):
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i < len(taken) and taken[i][0] < b:
                continue
            out.append((kind, patterns(text, a, b), m[0], False, a, b))
    return out


SEEN = "array<struct<kind:string,patterns:array<string>,instance:string,seed:boolean,start:long,end:long>>"
SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("patterns", pa.list_(pa.string())),
            ("instance", pa.string()),
            ("seed", pa.bool_()),
            ("start", pa.int64()),
            ("end", pa.int64()),
        ]
    )
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base spans and occurrences of every row. No texts follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            base = [base_spans(t or "") for t in texts]
            seen = [occurrences(t or "", s) for t, s in zip(texts, base, strict=True)]
            span = ("kind", "start", "end")
            full = ("kind", "patterns", "instance", "seed", "start", "end")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([text_key(t) for t in texts], pa.string()),
                    pa.array([[dict(zip(span, s)) for s in x] for x in base], _SPAN),
                    pa.array([[dict(zip(full, s)) for s in x] for x in seen], _SEEN),
                ],
                names=["doc_id", "text_key", "base", "seen"],
            )

    return need(docs, doc_id="long", text="string").mapInArrow(
        run, f"doc_id long, text_key string, base {SPANS}, seen {SEEN}"
    )


def text_key(text: str | None) -> str:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def learn(seen: DataFrame) -> DataFrame:
    """(kind, pattern, confidence) of the accepted patterns from scanned rows.

    Occurrences are reduced to distinct edges before anything is joined, so
    copies of a document count once. Instances are compared by hash.
    """
    rows = seen.select("text_key", F.explode("seen").alias("s")).select(
        "text_key", "s.kind", F.explode("s.patterns").alias("pattern"), F.xxhash64("s.instance").alias("instance"), "s.seed"
    )
    # both counts are exact; distinct pairs are formed before the shuffle, those of texts only for patterns with seeds enough
    proven, support = rows.where("seed"), None
    for what, least in (("instance", LEAST_SEEDS), ("text_key", LEAST_DOCS)):
        left = proven if support is None else proven.join(support, ["kind", "pattern"], "left_semi")
        counted = left.select("kind", "pattern", what).distinct().groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"))
        support = durable(counted.where(F.col("n") >= least).select("kind", "pattern"))
    edges = rows.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")).join(support, ["kind", "pattern"])
    # all seeds of a pattern count alike: they are one row, and only unseen instances take part in the rounds
    own = durable(edges.groupBy("kind", "pattern").agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("n")))
    fresh = durable(edges.where("NOT seed").select("kind", "pattern", "instance"))
    found = own.withColumn("confidence", F.col("seeds") / F.col("n"))
    if fresh.take(1):
        for _ in range(ROUNDS):
            scores = (
                fresh.join(found.select("kind", "pattern", "confidence"), ["kind", "pattern"])
                .groupBy("kind", "instance")
                .agg((F.max("confidence") * TRUST).alias("score"))
            )
            lent = fresh.join(scores, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum("score").alias("lent"))
            found = durable(
                own.join(lent, ["kind", "pattern"], "left").withColumn(
                    "confidence", (F.col("seeds") + F.coalesce("lent", F.lit(0.0))) / F.col("n")
                )
            )
    # a pattern whose instances are mostly unseen proves nothing, however they score each other
    return found.where((F.col("confidence") >= CONFIDENCE) & (2 * F.col("seeds") >= F.col("n"))).select("kind", "pattern", "confidence")


def added_spans(seen: DataFrame, key: str) -> DataFrame:
    """(key, added): spans of unseen candidates that accepted patterns have, per key (row or text_key)."""
    fresh = seen.select(key, F.explode("seen").alias("s")).where("NOT s.seed")
    order = F.array(*[F.lit(k) for k in KINDS])
    kept = F.array().cast(SPANS)
    return (
        fresh.select(key, "s.kind", F.explode("s.patterns").alias("pattern"), "s.start", "s.end")
        .join(durable(learn(seen)), ["kind", "pattern"])
        .groupBy(key, "kind", "start", "end")
        .agg(F.max("confidence").alias("confidence"))
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col("confidence")).alias("rank"),
                        F.array_position(order, F.col("kind")).alias("place"),
                        F.struct("kind", "start", "end").alias("span"),
                    )
                )
            ).alias("found")
        )
        .select(key, F.array_sort(F.aggregate("found", kept, _with_span)).alias("added"))
    )


def _with_span(kept, found):
    """Of overlapping candidates the one with the better pattern stays."""
    span = found["span"]
    free = ~F.exists(kept, lambda k: (k["start"] < span["end"]) & (span["start"] < k["end"]))
    return F.when(free, F.array_append(kept, span)).otherwise(kept)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and added spans (arrays of kind, start, end) of every row.

    Rows are told apart by a number that is stored with them, so copies of one
    text are not brought together.
    """
    seen = durable(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    return (
        seen.select("row", "doc_id", "text_key", "base")
        .join(added_spans(seen, "row"), "row", "left")
        .select("doc_id", "text_key", "base", F.coalesce("added", F.array().cast(SPANS)).alias("added"))
    )


def redact(docs: DataFrame, key: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; other columns unchanged.

    Base spans are found in place. Added spans are usually few: their size is
    checked and they are broadcast up to ``BROADCAST_BYTES``, joined above, where
    Spark splits the rows of a frequent text.
    """
    seen = durable(scan(docs))
    added = durable(added_spans(seen, "text_key"))
    n, spans = added.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("added")), F.lit(0))).first()
    names = docs.columns
    at = names.index(key)
    key_of, more = unused(names, "text_key"), unused(names, "added")
    rows = docs.withColumn(more, F.lit(None).cast(SPANS))
    if n:
        kind = StructType([*docs.schema.fields, StructField(key_of, StringType())])
        keyed = docs.mapInArrow(_with_key(at), kind)
        side = added.select(F.col("text_key").alias(key_of), F.col("added").alias(more))
        side = F.broadcast(side) if 80 * n + 64 * spans <= BROADCAST_BYTES else side
        rows = keyed.join(side, key_of, "left").drop(key_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if not t else masked(t, [(s["kind"], s["start"], s["end"]) for s in more or ()])
                for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            ]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)


def _with_key(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([text_key(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "key"])

    return run


def masked(text: str, more: list[tuple[str, int, int]]) -> str:
    """The text without its base spans and the spans in ``more``; of overlapping ones the union goes."""
    spans = sorted((a, b, k) for k, a, b in [*base_spans(text), *more])
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in every document."""
    order = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    placed = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(placed)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
