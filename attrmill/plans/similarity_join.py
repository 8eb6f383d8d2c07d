"""Similarity self-join of a vocabulary (L2): all unordered pairs with indel ratio > s, exact.

For lengths la, lb the pair is a match iff LCS(a, b) >= t(la, lb), with t = floor((2s+1)(la+lb)/400) + 1
(from round-half-even(200*LCS/(la+lb)) > s). No cross join; two kinds of signature, by the longer word:

* up to SHORT letters: deletion variants. A match has a common subsequence of exactly t letters,
  so every word emits its subsequences with k letters deleted, for the few k that its possible
  partners of at most SHORT letters ask for (k <= 3 at s = 80), and equal variants join.
* longer words: linear signatures. Each adjacent pair of the t matched letters (ends included) is
  a bigram of both words unless one of the la + lb - 2t unmatched letters parts it, so a match
  shares c = 3t - la - lb + 1 bigrams, in order, each at positions at most max(la, lb) - t apart.
  With bigrams ordered rarest first, the first shared one lies in the first (l + 1) - c + 1 of both
  words (prefix filter; the matching is monotone, so the first occurrences pair up and the
  position bound holds for them). Only these prefixes join, on the bigram; the join condition
  holds the length band, both prefix lengths for this very pair of lengths, the positions and a
  bound on letters: la + lb - 2t is at least the size of the difference of the letter counts, and
  that at least the differing bits of two 64-bit unary histograms.
  Low cut-offs (3t <= la + lb can hold) take single letters instead, of which t are shared.

What the joins emit is linear in the letters; surviving pairs are made distinct and verified and
scored by one bit-parallel LCS. The rarest-first order only decides the cost. AQE splits hot bigrams.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrmill.functions import text as X

#: Pairs whose longer word has at most so many letters join on deletion variants.
SHORT = 14
#: Odd numbers that spread the hashes of deletion variants over 64 bits.
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Cutoff:
    """Least LCS of two lengths: t = (a * (la + lb) + b) div c."""

    a: int
    b: int
    c: int

    def least(self, la: int, lb: int) -> int:
        return (self.a * (la + lb) + self.b) // self.c

    def column(self, la: Column, lb: Column) -> Column:
        return F.floor(((la + lb) * self.a + self.b).cast("long") / F.lit(self.c)).cast("int")

    @property
    def bigrams(self) -> bool:
        """Whether every match shares a bigram."""
        return 3 * self.a >= self.c


def score_cutoff(min_score: int) -> Cutoff:
    """round-half-even(200 * LCS / (la + lb)) > min_score."""
    return Cutoff(2 * min_score + 1, 400, 400)


def ratio_cutoff(num: int, den: int) -> Cutoff:
    """2 * LCS / (la + lb) >= num / den, not rounded."""
    return Cutoff(num, 2 * den - 1, 2 * den)


def min_common(la: int, lb: int, min_score: int) -> int:
    """Smallest LCS length t with round-half-even(200*t/(la+lb)) > min_score."""
    return score_cutoff(min_score).least(la, lb)


def min_common_ratio(la: int, lb: int, num: int, den: int) -> int:
    """Smallest LCS length t with 2*t/(la+lb) >= num/den (unrounded ratio cut-off)."""
    return ratio_cutoff(num, den).least(la, lb)


def deletion_counts(length: int, min_score: int = 80, cutoff: Cutoff | None = None, longest: int | None = None) -> list[int]:
    """Deletion counts a word of this length needs over all partner lengths (up to ``longest``) that can match."""
    cutoff = cutoff or score_cutoff(min_score)
    # t grows with the partner's length: from the first longer partner that needs more
    # letters than this word has, no partner can match, whatever the cut-off.
    if cutoff.least(length, 1_000_000_000) <= 0:
        raise ValueError("a similarity join needs a cut-off above 0")
    ks = set()
    for m in itertools.count(1) if longest is None else range(1, longest + 1):
        t = cutoff.least(length, m)
        if 0 < t <= min(length, m):
            ks.add(length - t)
        elif m > length and t > length:
            break
    return sorted(ks)


def deletion_variants(word: str, ks: list[int]) -> list[str]:
    """Distinct subsequences of `word` with k letters deleted, for every needed k."""
    out: set[str] = set()
    for k in ks:
        out.update(map("".join, itertools.combinations(word, len(word) - k)))
    return list(out)


def _kept_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every way to delete k letters of words of one length (a row a word): a sum of letters times powers
    of a number by place. With places before and after the deletions from running sums, a way takes k + 1 differences."""
    n = codes.shape[1]
    # what is left between the i-th and the next deletion moves i places on
    power = [np.uint64(pow(_BASE, i, 1 << 64)) for i in range(n)]
    runs = np.zeros((k + 1, n + 1, len(codes)), np.uint64)
    for i in range(k + 1):
        for j in range(i, n):
            runs[i, j + 1] = runs[i, j] + codes[:, j] * power[j - i]
    out = []
    for gone in itertools.combinations(range(n), k):
        ends, h = [*gone, n], np.zeros(len(codes), np.uint64)
        for i, end in enumerate(ends):
            h = h + runs[i, end] - runs[i, ends[i - 1] + 1 if i else 0]
        out.append(h)
    return np.stack(out, 1)


def deletion_hashes(words: list[str], ks: dict[int, list[int]]) -> list[np.ndarray]:
    """Per word the hashes of its deletion variants, each once; equal variants of two words have equal hashes. The last
    six bits are the number of letters left."""
    out: list = [None] * len(words)
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    for n, rows in lengths.items():
        codes = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), n).astype(np.uint64) + np.uint64(1)
        found = [_kept_hashes(codes, k) * _MIX & ~np.uint64(63) | np.uint64((n - k) & 63) for k in ks[n]]
        h = np.concatenate([np.zeros((len(rows), 0), np.uint64), *found], 1).view(np.int64)
        h.sort(1)
        new = np.ones(h.shape, bool)
        new[:, 1:] = h[:, 1:] != h[:, :-1]
        for i, row, first in zip(rows, h, new):
            out[i] = row[first]
    return out


def _variant_pairs(words: DataFrame, cutoff: Cutoff, longest: int) -> DataFrame:
    """(x, y), x < y: all matches among words of at most ``longest`` letters."""
    ks = {n: deletion_counts(n, cutoff=cutoff, longest=longest) for n in range(1, longest + 1)}

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def variants(col: pd.Series) -> pd.Series:
        return pd.Series(deletion_hashes(col.tolist(), ks))

    # the hash stands for the variant; what only shares a hash is sorted out by the LCS
    few = words.where(F.col("l") <= longest).select("w", "l", F.explode(variants("w")).alias("h"))
    a = few.select(F.col("w").alias("x"), F.col("l").alias("la"), "h")
    b = few.select(F.col("w").alias("y"), F.col("l").alias("lb"), "h")
    left = F.col("h").bitwiseAND(F.lit(63)) == cutoff.column(F.col("la"), F.col("lb")) % 64
    hits = a.join(b, "h").where((F.col("x") < F.col("y")) & left)
    return hits.select("x", "y").distinct()


@F.pandas_udf(T.StructType([T.StructField("m1", T.LongType()), T.StructField("m2", T.LongType())]))
def _letters(col: pd.Series) -> pd.DataFrame:
    """Two 64-bit unary histograms: 16 classes of letters each, 4 bits a class."""
    out = []
    for w in col:
        masks = [0, 0]
        for ch in w:
            k = ord(ch) & 31
            at = (k & 15) * 4
            held = (masks[k >> 4] >> at) & 15
            masks[k >> 4] |= ((held << 1 | 1) & 15) << at
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return pd.DataFrame(out, columns=["m1", "m2"], dtype="int64")


def _grams(words: DataFrame, size: int) -> DataFrame:
    """(w, l, m1, m2, gram, pos, rank): the grams of every word, rarest first."""
    # both ends count as letters
    text = F.concat(F.lit("\x01"), F.col("w"), F.lit("\x01")) if size == 2 else F.col("w")
    count = F.col("l") + 1 if size == 2 else F.col("l")
    cut = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(size)))
    known = words.withColumn("m", _letters("w"))
    grams = known.select("w", "l", "m.m1", "m.m2", F.posexplode(cut).alias("pos", "gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("w").orderBy("often", "gram", "pos")
    return grams.join(often, "gram").withColumn("rank", F.row_number().over(order)).drop("often")


def _shared(cutoff: Cutoff, size: int, la: Column, lb: Column, t: Column) -> Column:
    return 3 * t - la - lb + 1 if size == 2 else t


def _gram_pairs(shorter: DataFrame, longer: DataFrame, cutoff: Cutoff, size: int, tie: Column) -> DataFrame:
    """(s, w): candidates with ``s`` from the grams ``shorter`` (columns as _grams, prefixed s_)
    not longer than ``w`` from ``longer``; ``tie`` decides pairs of equal length."""
    extra = 1 if size == 2 else 0
    la, lb = F.col("s_l"), F.col("l")
    t = cutoff.column(la, lb)
    c = _shared(cutoff, size, la, lb, t)
    bits = F.bit_count(F.col("s_m1").bitwiseXOR(F.col("m1"))) + F.bit_count(F.col("s_m2").bitwiseXOR(F.col("m2")))
    cond = (
        ((la < lb) | ((la == lb) & tie))
        & (t <= la)
        & (F.abs(F.col("s_pos") - F.col("pos")) <= lb - t)
        & (F.col("s_rank") <= la + extra - c + 1)
        & (F.col("rank") <= lb + extra - c + 1)
        & (bits <= la + lb - 2 * t)
    )
    s = shorter.select("gram", *[F.col(c).alias(f"s_{c}") for c in ("w", "l", "m1", "m2", "pos", "rank")])
    # the longest prefix that any partner asks for: an equal length for the shorter side, the least
    # length that can match for the longer one (lower bounds of c, by the cut-off without rounding)
    least = lambda x: (3 * cutoff.a / cutoff.c - 1) * x + 1 if size == 2 else cutoff.a / cutoff.c * x
    s = s.where(F.col("s_rank") <= la + extra + 1 - F.floor(least(2.0 * la)))
    w = longer.where(F.col("rank") <= lb + extra + 1 - F.floor(least(lb * cutoff.c / (cutoff.c - cutoff.a))))
    return s.join(w, "gram").where(cond).select(F.col("s_w").alias("s"), F.col("w")).distinct()


def _words(df: DataFrame, column: str) -> DataFrame:
    w = df.select(F.col(column).alias("w")).where(F.col("w").isNotNull() & (F.length("w") > 0)).distinct()
    return w.select("w", F.length("w").alias("l"))


def _self_pairs(words: DataFrame, cutoff: Cutoff, short: int) -> DataFrame:
    """(x, y) with x < y: a superset of the matches, each pair once."""
    size = 2 if cutoff.bigrams else 1
    short = short if cutoff.bigrams else 0
    # a word can be the shorter one of a long pair if it matches some length above `short`
    able = words.where(cutoff.column(F.col("l"), F.greatest(F.col("l"), F.lit(short + 1))) <= F.col("l"))
    grams = _grams(able, size)
    long_ = _gram_pairs(grams, grams.where(F.col("l") > short), cutoff, size, F.col("s_w") < F.col("w"))
    pairs = long_.select(F.least("s", "w").alias("x"), F.greatest("s", "w").alias("y"))
    return pairs.unionByName(_variant_pairs(words, cutoff, short)) if short else pairs


def ratio_cutoff_pairs(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """All (query, word) with query from `left`, word from `right`, query != word and
    2*LCS/(|query|+|word|) >= num/den, with `lcs`; by the linear signatures at every length."""
    cutoff = ratio_cutoff(num, den)
    size = 2 if cutoff.bigrams else 1
    q, w = _words(left, left.columns[0]), _words(right, right.columns[0])
    # one order of grams for both sides
    grams = _grams(q.unionByName(w).distinct(), size)
    sides = q.select("w", F.lit(True).alias("is_q")).join(w.select("w", F.lit(True).alias("is_w")), "w", "full")
    grams = grams.join(sides, "w")
    qs, ws = grams.where("is_q"), grams.where("is_w")
    up = _gram_pairs(qs, ws, cutoff, size, F.col("s_w") != F.col("w")).select(F.col("s").alias("query"), F.col("w").alias("word"))
    down = _gram_pairs(ws, qs, cutoff, size, F.lit(False)).select(F.col("w").alias("query"), F.col("s").alias("word"))
    pairs = up.unionByName(down).withColumn("lcs", X.lcs_udf("query", "word"))
    return pairs.where(F.col("lcs") >= cutoff.column(F.length("query"), F.length("word")))


def similar_pairs(vocabulary: DataFrame, min_score: int = 80, column: str = "attribute", short: int = SHORT) -> DataFrame:
    """L2 + L3: (attribute1, attribute2, levenshtein) for attribute1 < attribute2, ratio > min_score."""
    cutoff = score_cutoff(min_score)
    pairs = _self_pairs(_words(vocabulary, column), cutoff, short).withColumn("lcs", X.lcs_udf("x", "y"))
    la, lb = F.length("x"), F.length("y")
    score = X.ratio_from_lcs(F.col("lcs"), la, lb)
    return pairs.where(F.col("lcs") >= cutoff.column(la, lb)).select(F.col("x").alias("attribute1"), F.col("y").alias("attribute2"), score.alias("levenshtein"))


def shared_term_exemption(pairs: DataFrame, term: str = "vioscreen", min_score: int = 80) -> DataFrame:
    """L4: when both names contain `term`, rescore without it; drop if below min_score.

    The rescored ratio replaces `levenshtein` for the later flags.
    """
    both = F.col("attribute1").contains(term) & F.col("attribute2").contains(term)
    # other pairs pass nulls, which are not scored
    bare = [F.when(both, F.replace(F.col(c), F.lit(term), F.lit(""))) for c in ("attribute1", "attribute2")]
    rescored = X.fuzzy_ratio(*bare)
    out = pairs.withColumn("levenshtein", F.when(both, rescored).otherwise(F.col("levenshtein")))
    return out.where(~both | (F.col("levenshtein") >= min_score))


# Fixed value: names of nucleotide letters alone.
NUCLEOTIDES = "^[atgcuATGCU]+$"


def drop_nucleotide_pairs(pairs: DataFrame) -> DataFrame:
    """Drop pairs where both names are nucleotide strings."""
    return pairs.where(~(F.col("attribute1").rlike(NUCLEOTIDES) & F.col("attribute2").rlike(NUCLEOTIDES)))


def candidate_pairs(vocabulary: DataFrame, min_score: int = 80, term: str = "vioscreen", column: str = "attribute") -> DataFrame:
    """L2 -> L3 -> L4 -> L5 -> L6: the pair spine with name and id."""
    p = drop_nucleotide_pairs(shared_term_exemption(similar_pairs(vocabulary, min_score, column), term, min_score))
    name = X.pair_name(F.col("attribute1"), F.col("attribute2"))
    return p.withColumn("name", name).withColumn("pair_id", X.pair_id(F.col("name")))
