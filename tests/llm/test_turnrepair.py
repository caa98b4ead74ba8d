import hashlib
import itertools
import re
import zlib

import pytest

from docflow.llm import turnrepair
from docflow.llm.common import crc32_sql


def plain_repair(signature, most_inserts=3):
    """All audits of the cheapest cost, by trying every choice per row and every insertion."""
    found = []
    slots = len(signature) + 1
    for edits in itertools.product("KDR", repeat=len(signature)):
        if any(e != "D" and x == "d" for e, x in zip(edits, signature)):
            continue
        for inserts in itertools.product(range(most_inserts), repeat=slots):
            cost = sum(3 * i for i in inserts)
            cost += sum({"K": 0, "D": 4, "R": 3}[e] + 3 * (e != "D" and x.isupper()) for e, x in zip(edits, signature))
            shown = "".join("?" * i + {"K": x.lower(), "D": "", "R": "?"}[e] for i, e, x in zip(inserts, edits, (*signature,)))
            shown += "?" * inserts[-1]
            for start in ("", "s"):
                body = shown[len(start):]
                if shown.startswith(start) and len(body) % 2 == 0 and (body or not start):
                    if all(c in ("?", w) for c, w in zip(body, itertools.cycle("ua"))):
                        audit = "".join("I" * i + e for i, e in zip(inserts, edits)) + "I" * inserts[-1]
                        found.append((cost, audit))
    return min(found)


def test_cheapest_and_least_audit_by_brute_force():
    for n in range(4):
        for x in itertools.product("suaxdUS", repeat=n):
            signature = "".join(x)
            cost, script = turnrepair.solve(signature)
            assert (cost, script.translate(str.maketrans("kduaUA", "KDRRII"))) == plain_repair(signature), signature


def test_a_very_long_signature_needs_no_stack():
    cost, script = turnrepair.solve("ua" * 100_000 + "u")
    assert cost == 3 and script == "k" * 200_001 + "A"


def plain(rows):
    """The contract read plainly: conversations damaged, judged and repaired one by one."""
    ids = {r[0] for r in rows}
    out = {}
    for c in ids:
        kept = []
        for conv, turn, role, text in rows:
            if conv != c:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in kept if t is not None}
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        seen, signature = set(), ""
        for _, role, text in kept:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = plain_repair(signature) if len(signature) < 4 else (None, None)
        lines = None
        if audit is not None:
            lines, rest = [], list(kept)
            for edit in audit:
                want = "assistant" if lines and lines[-1][0] == "u" else "user"
                if edit == "I":
                    lines.append(f"{want}:")
                else:
                    _, role, text = rest.pop(0)
                    if edit != "D":
                        lines.append(f"{role if edit == 'K' else want}:{text}")
            lines = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, lines)
    return out


KIND = "conv_id long, turn long, role string, text string, pos string, letter string, signature string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], KIND)


def test_conversations_against_plain_rules(spark):
    roles = ("user", "assistant", "system", None, "tool", "", "ursa")
    texts = ("Done.", "Why?", "cut off", "  \n", None, "", "Long " * 30_000 + ".", "a.b", "日本語!", "x.\x0b\x0c")
    rows = []
    for c in range(150):
        for t in range(c % 5):
            k = c * 31 + t * 7
            turn = None if k % 13 == 0 else t * (1 + c % 3)
            rows.append((c, turn, roles[k % 7 if c % 2 else t % 2], texts[(k // 3) % 10 if c % 3 else 0]))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (7_000_000_000, None, None, None)]
    rows += [(200, 1, "user", "Same."), (200, 1, "user", "Same."), (200, 1, "assistant", "Tie.")]
    got = turnrepair.repair_damaged(table(spark, rows)).collect()
    want = plain(rows)
    assert len(got) == len(want) and {r["conv_id"] for r in got} == set(want)
    for r in got:
        w = want[r["conv_id"]]
        have = tuple(r[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
        assert have[:5] == w[:5], r
        if w[5] is not None:
            assert have[5:] == w[5:], r


def test_no_rows(spark):
    assert turnrepair.repair_damaged(table(spark, [(1, 1, "user", "x.")]).limit(0)).count() == 0


def test_all_rows_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = turnrepair.repair_damaged(table(spark, [(gone, 0, "user", "x.")])).collect()
    assert (r["gaps"], r["cost"], r["audit"]) == (0, 0, "")
    assert r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_a_long_conversation(spark):
    rows = [(3, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    (r,) = turnrepair.repair(turnrepair._rows(table(spark, rows))).collect()
    assert r["audit"] == "K" * 3000 and r["cost"] == 0
    assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{x}:{y}" for _, _, x, y in rows).encode()).hexdigest()


@pytest.mark.parametrize("x", ["", "0", "41:7", "conversation"])
def test_crc_in_sql(x):
    import duckdb

    assert duckdb.sql(f"SELECT {crc32_sql('s')} FROM (SELECT '{x}' AS s)").fetchall()[0][0] == zlib.crc32(x.encode())
