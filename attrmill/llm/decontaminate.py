"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A text's words are the ASCII-lower-cased runs of letters, digits and non-ASCII
characters. Patterns are all windows of `WINDOW` consecutive words of the test
items (an item of fewer words is one pattern). The search works on word
sequences: a block is two consecutive words, the shift table holds for each
block how far the window may jump, the last block's bucket lists the patterns
that end in it, and a bucket's patterns are compared word by word. Patterns of
fewer words than the block are looked up directly. Words inside any occurrence
are hit.

The pattern set is broadcast only up to `MAX_PATTERNS` windows at a time; a larger
one is dealt into blocks by hash and the documents pass through one search per
block, which adds to the same hit marks, so the result does not change.

Rows: null and empty texts have no words. Repeated documents are searched alike;
repeated items and items that share a window are all counted. An item with a
null id marks words but is not listed. Columns of the documents that the
search does not need are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrmill.llm.common import arrow_stage

WINDOW = 10
MAX_PATTERNS = 1_000_000
_BLOCK = 2
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on UTF-8 bytes, after A-Z became a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _windows(batches):
    for b in batches:
        item, window = [], []
        for i, t in zip(*(b.column(c).to_pylist() for c in (0, 1))):
            w = words_of(t)
            for at in range(max(1, len(w) - WINDOW + 1) if w else 0):
                item.append(i), window.append(b" ".join(w[at : at + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.binary())], ["item_id", "window"])


def windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id as string, window) of all test items."""
    return arrow_stage(
        items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")), _windows, "item_id string, window binary"
    ).distinct()


class _Group:
    """Wu-Manber tables for patterns of one length (in words)."""

    def __init__(self, patterns: list[tuple[bytes, ...]]) -> None:
        self.m = m = len(patterns[0])
        self.buckets: dict[bytes, list[tuple[bytes, ...]]] = {}
        self.shift: dict[bytes, int] = {}
        self.far = m - _BLOCK + 1
        for p in patterns:
            for end in range(_BLOCK, m + 1):
                block = p[end - 2] + b" " + p[end - 1]
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.buckets.setdefault(p[-2] + b" " + p[-1], []).append(p)

    def find(self, words: list[bytes]):
        m, n, far, shift = self.m, len(words), self.far, self.shift
        end = m
        while end <= n:
            block = words[end - 2] + b" " + words[end - 1]
            jump = shift.get(block, far)
            if jump:
                end += jump
                continue
            for p in self.buckets[block]:
                if words[end - m] == p[0] and tuple(words[end - m : end]) == p:
                    yield end - m, p
            end += 1


class Searcher:
    def __init__(self, found: dict[bytes, list[str]]) -> None:
        self.items: dict[tuple[bytes, ...], list[str]] = {tuple(w.split(b" ")): i for w, i in found.items()}
        by_len: dict[int, list] = {}
        for p in self.items:
            by_len.setdefault(len(p), []).append(p)
        self.single = by_len.pop(1, [])
        self.groups = [_Group(p) for _, p in sorted(by_len.items())]
        self.single_words = {p[0] for p in self.single}

    def search(self, words: list[bytes]):
        """(start, pattern) of every occurrence."""
        for g in self.groups:
            yield from g.find(words)
        if self.single_words:
            for at, w in enumerate(words):
                if w in self.single_words:
                    yield at, (w,)


def _search(batches, patterns, text_at):
    searcher = Searcher(patterns.value)
    for b in batches:
        texts, hits, ids = (b.column(i).to_pylist() for i in (text_at, text_at + 1, text_at + 2))
        n_words, marks, items = [], [], []
        for text, before, known in zip(texts, hits, ids):
            words = words_of(text)
            mark, found = None, set(known or ())
            for at, p in searcher.search(words):
                if mark is None:
                    mark = np.frombuffer(before, np.uint8).copy() if before else np.zeros(len(words), np.uint8)
                mark[at : at + len(p)] = 1
                found.update(searcher.items[p])
            n_words.append(len(words))
            marks.append(before if mark is None else mark.tobytes())
            items.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(text_at + 1)), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64())],
            [*b.schema.names[: text_at + 1], "_hits", "_items", "_n_words"],
        )


def mark_occurrences(docs: DataFrame, items: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``docs`` (its last column the text as binary) with `_hits` (a byte for each word, null if
    none is hit), `_items` (sorted ids whose windows occur) and `_n_words`."""
    spark = docs.sparkSession
    found = windows(items).persist()
    try:
        blocks = max(1, -(-found.select("window").distinct().count() // max_patterns))
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        schema = f"{kept}, _hits binary, _items array<string>, _n_words long"
        out = docs.withColumn("_hits", F.lit(None).cast("binary")).withColumn("_items", F.lit(None).cast("array<string>"))
        for k in range(blocks):
            part: dict[bytes, list[str]] = {}
            for r in found.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect():
                part.setdefault(bytes(r.window), []).extend([] if r.item_id is None else [r.item_id])
            # at most about max_patterns windows
            sent = spark.sparkContext.broadcast(part)
            out = arrow_stage(out.drop("_n_words"), functools.partial(_search, patterns=sent, text_at=len(docs.columns) - 1), schema)
        return out
    finally:
        found.unpersist()


def _digest(batches, text_at):
    for b in batches:
        hits = [h.count(b"\x01") if h else 0 for h in b.column(1).to_pylist()]
        items = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(3), pa.array(hits, pa.int64()), pa.array(list(map(len, items)), pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, items: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    marked = mark_occurrences(docs.select("doc_id", F.col("text").cast("binary").alias("text")), items, max_patterns)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(
        marked.select("doc_id", "_hits", "_items", "_n_words"), functools.partial(_digest, text_at=1),
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )
