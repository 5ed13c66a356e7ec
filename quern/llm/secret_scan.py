"""Secret scan: base patterns, and sliding-window Shannon entropy per character class over candidate strings.

Base spans are those of three patterns (assign, access, hex), leftmost and not overlapping within each kind, after which matches that are too
short go. Then candidate strings - runs of ``WINDOW`` or more token characters - are cut into runs of each character class, and a window of WINDOW
characters slides along every run. Its entropy follows from sum(c * log2 c) over its character counts, kept in whole numbers and changed by what enters and what leaves
only, never counted anew. A window counts if its entropy reaches the class's least one and it mixes letters and digits. Windows that touch or overlap are one
``entropy`` span, dropped if it lies within a base span or if the allow-list knows it (alphabets, counting, UUIDs, integrity digests, examples, words joined by separators).
Base spans are never suppressed.

A span is that of its whole match, in code points, with its end exclusive. Each text is read whole, by itself: no shuffle, memory in proportion to the text.

Defined cases: null text is empty; without spans the list is empty; capitals and small letters of an assign keyword are ASCII; repeated rows and
null doc_ids are scanned each; an empty table gives no rows; further columns are kept by ``scanned`` and ``redacted``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed, and the base patterns.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # of text in small letters
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")  # one class to its end: a shorter run has no longer one within
_HEX = re.compile(rb"[0-9a-f]{16,}")

WINDOW = 20
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Character classes with the least entropy, in bits a character, of a window of theirs.
CLASSES = ((re.compile(rb"[0-9a-f]{20,}"), 2.9), (re.compile(rb"[0-9A-F]{20,}"), 2.9), (re.compile(rb"[A-Za-z0-9]{20,}"), 3.6), (re.compile(rb"[A-Za-z0-9+/=]{20,}"), 3.7), (re.compile(rb"[A-Za-z0-9_=-]{20,}"), 3.7))
#: What is no secret, found anywhere in a span's candidate.
ALLOW = tuple(
    re.compile(x)
    for x in (
        rb"(?i)abcdefghij|qrstuvwxyz|0123456789|1234567890",
        rb"(?i)(?<![0-9a-f])[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?![0-9a-f])",
        rb"^sha(?:1|256|384|512)[-=]",
        rb"(?i)example|placeholder|dummy|changeme|redacted|your[_-]",
        rb"(?:[A-Za-z]{3,}[/_=-]+){3,}",
        rb"(.)\1{7}",
    )
)
_UNIT = 1 << 32
#: c * log2 c; a window holds one more for the moment between one that enters and one that leaves.
_PART = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 2)]


def windows(run: bytes, least: float) -> Iterator[int]:
    """Starts of the windows of WINDOW characters whose entropy is at least ``least`` and that mix letters and digits."""
    most = round(WINDOW * (math.log2(WINDOW) - least) * _UNIT)
    counts, total, digits = [0] * 256, 0, 0
    for at, new in enumerate(run):
        c = counts[new]
        counts[new] = c + 1
        total += _PART[c + 1] - _PART[c]
        digits += 0x30 <= new <= 0x39
        if at >= WINDOW:
            old = run[at - WINDOW]
            c = counts[old]
            counts[old] = c - 1
            total += _PART[c - 1] - _PART[c]
            digits -= 0x30 <= old <= 0x39
        if at >= WINDOW - 1 and total <= most and 2 <= digits <= WINDOW - 2:
            yield at - WINDOW + 1


def joined_windows(starts: Iterator[int], offset: int) -> list[tuple[int, int]]:
    """Spans of the windows at ascending starts, as they come: a long run leaves few."""
    out: list[tuple[int, int]] = []
    for at in starts:
        a, b = offset + at, offset + at + WINDOW
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    return sorted(out)


def entropy_spans(raw: bytes, allow: tuple = ALLOW) -> list[tuple[int, int]]:
    """(start, end) in bytes, whatever the base patterns say."""
    out = []
    for m in _CANDIDATE.finditer(raw):
        text, found = m.group(), []
        for chars, least in CLASSES:
            for run in chars.finditer(text):
                found += joined_windows(windows(run.group(), least), run.start())
        if found and not any(x.search(text) for x in allow):
            out += [(m.start() + a, m.start() + b) for a, b in merged(found)]
    return out


def spans_of(raw: bytes, allow: tuple = ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    base = base_spans(raw)
    reach, furthest = [], 0  # of the base spans that start at or before each of them, the furthest end
    for _, _, b in base:
        furthest = max(furthest, b)
        reach.append(furthest)
    found, at = list(base), 0
    for a, b in entropy_spans(raw, allow):
        while at < len(base) and base[at][0] <= a:
            at += 1
        if not at or reach[at - 1] < b:
            found.append((a, 3, b))
    found.sort()
    if raw.isascii() or not found:
        return found
    points, now, done = {}, 0, 0
    for x in sorted({y for a, _, b in found for y in (a, b)}):
        done += len(raw[now:x].decode("utf-8", "replace"))
        now = x
        points[x] = done
    return [(points[a], kind, points[b]) for a, kind, b in found]


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _secrets, an array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(raw or b"")] for raw in texts], dtype=object)

    return docs.withColumn("_secrets", spans(F.col(text).cast("string").cast("binary")))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of their text replaced by a mark; spans that overlap are one."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            if x is not None:
                for a, b in reversed(merged([(a, b) for a, _, b in spans_of(x.encode("utf-8", "replace"))])):
                    x = x[:a] + mark + x[b:]
            out.append(x)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text).cast("string")))


def digest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scanned(docs.select("doc_id", "text")).select("doc_id", "_secrets")
    show = lambda l: F.array_join(F.transform(l, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("_secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(show(F.filter("_secrets", lambda s: s["kind"] != "entropy")).cast("binary"), 256)
    return rows.select("doc_id", *[n(k) for k in KINDS[:3]], base.alias("base_sha256"), show(F.col("_secrets")).alias("spans"))
