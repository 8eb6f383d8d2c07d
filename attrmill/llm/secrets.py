"""Secret scans: fixed base patterns, and entropy windows over candidate strings.

Base spans are the contract's three patterns. The method adds `entropy` spans: in
every candidate string (a run of 20 or more characters of the base64 alphabet) a
window slides over the characters of one class at a time (hexadecimal, base64);
its Shannon entropy follows from counts that change by one character in and one
out per step. Windows at or over the class's threshold are joined to spans.
Candidates on the allow-list (words without digits in one case or camel case, also
between separators, numbers, UUIDs, dates, versions, addresses, paths, repeated short
units) add nothing; other candidates without digits are keys like any. A base span is
never suppressed; an entropy span that lies inside a base span is not repeated.

Offsets are code points, the end exclusive. Spans are sorted by start, then kind
as listed in `KINDS`. Null texts are empty. Rows are independent of each other;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from attrmill.llm.common import arrow_stage

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as `[0-9a-f]+` of 24 or more
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")

#: Class: its characters, the window's length, the least entropy in bits. Random
#: hexadecimal windows of 24 have about 3.5 bits, random base64 ones of 20 about 4.1;
#: words of a natural language stay near 3.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 24, 3.0),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.7),
}
ALLOWED = tuple(map(re.compile, (
    # no digit: words in one case or camel case, between separators; separator lines
    r"[+/_=.-]*(?:(?:[a-z]+|[A-Z]+|[A-Z]{0,4}[a-z]*(?:[A-Z][a-z]{2,14})+)(?:[+/_=.-]+|$))*",
    r"[0-9+/_=.-]*",  # numbers, dates, versions, phone numbers
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"(.{1,6})\1{2,}.?",  # a short unit again and again
    r"/?([a-z]+[0-9]{0,4}[/._-])+[a-z]*[0-9]{0,4}/?",  # paths, host names, slugs
)))
_MAYBE = ("passw", "secret", "token", "api")


def entropy_windows(s: str, members: frozenset, size: int, least: float) -> list[tuple[int, int]]:
    """Spans of s covered by windows of ``size`` class members with entropy >= least."""
    spans: list[tuple[int, int]] = []
    log = [0.0] + [k * math.log2(k) for k in range(1, size + 1)]
    counts: dict[str, int] = {}
    start, total = 0, 0.0  # of the window; sum of c*log2(c)
    for end, c in enumerate(s):
        if c not in members:
            counts.clear()
            start, total = end + 1, 0.0
            continue
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += log[k + 1] - log[k] if k < size else 0.0
        if end - start + 1 > size:
            gone = s[start]
            k = counts[gone]
            counts[gone] = k - 1
            total += log[k - 1] - log[k] if k <= size else 0.0
            start += 1
        if end - start + 1 == size and math.log2(size) - total / size >= least:
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], end + 1)
            else:
                spans.append((start, end + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in _MAYBE):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    candidates = [(m.start(), m.group()) for m in _CANDIDATE.finditer(text)]
    for at, s in candidates:  # a run of 24 hexadecimal digits is inside a candidate
        base += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(s)]
    base.sort()
    starts = [b[0] for b in base]
    reach = list(itertools.accumulate((b[2] for b in base), max))  # farthest end of the spans up to here
    more = set()
    for at, s in candidates:
        if not any(p.fullmatch(s) for p in ALLOWED):
            for members, size, least in CLASSES.values():
                for x, y in entropy_windows(s, members, size, least):
                    upto = bisect.bisect_right(starts, at + x)
                    if not upto or reach[upto - 1] < at + y:
                        more.add((at + x, 3, at + y))
    return base, sorted(base + list(more))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            base, spans = scan(text) if text else ([], [])
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs.select("doc_id", "text"), _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redact(batches, text_at, length_at):
    for b in batches:
        texts = b.column(text_at).to_pylist()
        new = [redact(t) if t else t for t in texts]
        cols = list(b.columns)
        cols[text_at] = pa.array(new, b.schema.field(text_at).type)
        if length_at is not None:
            old = b.column(length_at).to_pylist()
            cols[length_at] = pa.array([n if t == u else len(u) for n, t, u in zip(old, texts, new)], b.schema.field(length_at).type)
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, secrets in `text` replaced and `n_chars` (if there) brought up to date."""
    names = docs.columns
    return arrow_stage(docs, functools.partial(_redact, text_at=names.index("text"), length_at=names.index("n_chars") if "n_chars" in names else None), docs.schema)
