"""Strict command line of a conversion job: arguments are checked before anything is opened."""

from __future__ import annotations

import hashlib
import re

OPTIONS = frozenset("input output model pages dpi max-new-tokens task device".split())
MAX_VALUE, MAX_SELECTION, MAX_PAGES, LAST_PAGE = 4096, 160, 16, 100_000
EXIT = {"complete": 0, "blocked": 2, "failed": 3, "error": 1, "usage": 64}


class UsageError(ValueError):
    """Arguments that a job can't be made from."""


def bounded(text: str, least: int, most: int) -> int:
    """One to eight ASCII digits within a range."""
    if not re.fullmatch("[0-9]{1,8}", text) or not least <= int(text) <= most:
        raise UsageError(f"expected an integer in {least}..{most}: {text[:20]!r}")
    return int(text)


def pages_of(text: str) -> list[int]:
    """``1,3-5`` as rising pages, at most MAX_PAGES."""
    if not 1 <= len(text) <= MAX_SELECTION:
        raise UsageError("page selection length")
    out: list[int] = []
    for part in text.split(","):
        ends = [bounded(x, 1, LAST_PAGE) for x in part.split("-")]
        if len(ends) > 2 or ends[0] > ends[-1] or ends[-1] - ends[0] >= MAX_PAGES:
            raise UsageError("page range")
        out += range(ends[0], ends[-1] + 1)
    if len(out) > MAX_PAGES or any(a >= b for a, b in zip(out, out[1:])):
        raise UsageError("pages must rise, at most sixteen of them")
    return out


def parse(arguments: list[str]) -> dict | None:
    """The job's settings; None for ``--help`` alone."""
    if arguments == ["--help"]:
        return None
    found: dict = {}
    rest = iter(arguments)
    for word in rest:
        name = word.removeprefix("--")
        if not word.startswith("--") or name not in OPTIONS | {"resume"}:
            raise UsageError(f"unknown option {word[:40]!r}")
        if name in found:
            raise UsageError(f"repeated option {word}")
        if name == "resume":
            found[name] = True
            continue
        value = next(rest, "")
        if not 1 <= len(value) <= MAX_VALUE or value.startswith("--"):
            raise UsageError(f"no value for {word}")
        found[name] = value
    if not {"input", "output"} <= set(found):
        raise UsageError("--input and --output are required")
    found["pages"] = pages_of(found.get("pages", "1"))
    found["dpi"] = bounded(found.get("dpi", "144"), 1, 300)
    found["max-new-tokens"] = bounded(found.get("max-new-tokens", "512"), 1, 4096)
    if found.setdefault("device", "cpu") not in ("cpu", "gpu"):
        raise UsageError("device must be cpu or gpu")
    return found


def identity(files: dict[str, str]) -> str:
    """One digest of name-to-digest pairs, whatever order they come in."""
    return hashlib.sha256("".join(f"{d} {n}\n" for n, d in sorted(files.items())).encode()).hexdigest()
