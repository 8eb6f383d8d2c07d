"""Language identification by word-first backoff.

A word known to the model scores by its log frequency in each language. An
unknown word falls back to its character n-grams (with word-boundary marks), the
longest length first: the word is covered by the longest known n-grams, and only
characters that no known n-gram covers get the floor. A text's score per language
is the sum over all its words; the prediction is the best language (ties: the
smaller name), its score the normalised posterior per word, in 0 to 1.

The model learns from text and language only. It is a classifier fitted to at
most `SAMPLE` labelled documents (chosen by a hash of the id, all of them where
there are fewer) and keeps at most `WORDS` words and `GRAMS` n-grams of each
length, the most frequent ones; both bounds are parameters. Prediction reads
every whole text.

Rows: null texts and texts without a letter give `und` with score 0; without any
labelled document every text is `und`. Repeated rows are predicted alike; other
columns of the input are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrmill.llm.common import Memo, arrow_stage

SAMPLE, WORDS, GRAMS = 20_000, 200_000, 50_000
LENGTHS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L); signs such as ½ ² ① are numbers, not letters."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def _count_words(batches):
    counts: Counter = Counter()

    def report():
        rows = [(lang, w, n) for (lang, w), n in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w, n in Counter(words_of(text)).items():
                counts[lang, w] += n
            if len(counts) >= 300_000:
                yield report()
    if counts:
        yield report()


def _count_grams(batches):
    counts: Counter = Counter()
    for b in batches:
        for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            marked = f"<{word}>"
            for k in LENGTHS:
                for i in range(len(marked) - k + 1):
                    counts[lang, marked[i : i + k]] += n
        rows = [(lang, g, n) for (lang, g), n in counts.items()]
        counts.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])


class Model:
    """Per-language log probabilities of words and n-grams; small and immutable."""

    def __init__(self, words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]], totals: dict[str, int]) -> None:
        self.langs = sorted(totals)
        self.words = {w: self._logs(c, totals) for w, c in words.items()}
        by_len = {k: {lang: 1 for lang in self.langs} for k in LENGTHS}
        for g, c in grams.items():
            for lang, n in c.items():
                by_len[len(g)][lang] += n
        self.grams = {g: self._logs(c, by_len[len(g)]) for g, c in grams.items()}

    def _logs(self, counts: dict[str, int], totals: dict[str, int]) -> tuple[float, ...]:
        return tuple(math.log((counts.get(lang, 0) + 0.01) / (totals[lang] + 1)) for lang in self.langs)

    def word(self, w: str) -> tuple[float, ...]:
        known = self.words.get(w)
        return known if known is not None else self._backoff(f"<{w}>")

    def _backoff(self, marked: str) -> tuple[float, ...]:
        """Mean of the n-gram scores of the longest known length that covers each character."""
        open_at = bytearray(b"\1" * len(marked))
        hits = []
        for k in LENGTHS:
            found = []
            for i in range(len(marked) - k + 1):
                if open_at.find(1, i, i + k) >= 0:
                    s = self.grams.get(marked[i : i + k])
                    if s is not None:
                        found.append(i)
                        hits.append(s)
            for i in found:
                open_at[i : i + k] = bytes(k)
            if 1 not in open_at:
                break
        return tuple(sum(x) / len(hits) for x in zip(*hits)) if hits else (0.0,) * len(self.langs)


def fit(labelled: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """labelled: doc_id, text, lang; rows with a null text or language teach nothing."""
    rows = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    counts = (
        arrow_stage(rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text"), _count_words, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    )
    try:
        totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        known = counts.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("c"))
        top = known.filter("all > 1").orderBy(F.desc("all"), "word").limit(words).collect()
        pieces = (
            arrow_stage(counts, _count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("c")).persist()
        )
        best: dict = {}
        for k in LENGTHS:
            best |= {r.gram: r.c for r in pieces.filter(F.length("gram") == k).orderBy(F.desc("all"), "gram").limit(grams).collect()}
        pieces.unpersist()
    finally:
        counts.unpersist()
    return Model({r.word: r.c for r in top}, best, totals)


class _Scores:
    """Scores of the words met so far as rows of one matrix. Bounded: when full it
    begins anew between two texts, and grows beyond that only for one text's own words."""

    def __init__(self, model: Model, limit: int = 400_000) -> None:
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.rows = np.empty((1 << 12, len(self.model.langs)))
        self.at = Memo(self._add, 1 << 62)

    def _add(self, word: str) -> int:
        n = len(self.at)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n] = self.model.word(word)
        return n

    def total(self, words: list[str]) -> np.ndarray:
        if len(self.at) >= self.limit:
            self.clear()
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            at = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            total += self.rows[at].sum(axis=0)
        return total


def _predict(batches, model, n_keep):
    m = model.value
    scores = _Scores(m)
    for b in batches:
        lang, score = [], []
        for text in b.column(n_keep).to_pylist():
            found = words_of(text) if text else ()
            if not found or not m.langs:
                lang.append(UNDETERMINED), score.append(0.0)
                continue
            sums = scores.total(found)
            top = int(sums.argmax())
            lang.append(m.langs[top])
            score.append(float(1 / np.exp(np.maximum((sums - sums[top]) / len(found), -700)).sum()))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(n_keep)), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
            [*b.schema.names[:n_keep], "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS + 5 x GRAMS entries
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs.select("doc_id", "text"), functools.partial(_predict, model=sent, n_keep=1), f"doc_id {kind}, lang_pred string, score double")
