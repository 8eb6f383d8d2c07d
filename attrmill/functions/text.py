"""String scalars for attribute names (X1-X8, L1, L6) as Spark column expressions.

The similarity measure is the indel ratio: round(100 * 2*LCS / (|a|+|b|)),
rounded half to even, 0 when either string is empty. It is computed from an
LCS length, which comes either from an Arrow-batched pandas UDF (bit-parallel
LCS, the fast path) or from a native SQL lambda form (kept as a cross-check).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# LCS length


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro): one word op per char of b."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


#: Rows of a pair of lengths from which they are counted together, and letters of a word that holds the bits of one.
TOGETHER, WORD = 32, 63


def lcs_lengths(a: list, b: list) -> list:
    """lcs_length(a[i], b[i]) of all rows, None where a side is None. Rows of equal lengths take each letter together."""
    out: list = [None] * len(a)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None:
            groups.setdefault((len(x), len(y)), []).append(i)
    for (n1, n2), rows in groups.items():
        if len(rows) < TOGETHER or not 0 < n1 <= WORD or not n2:
            for i in rows:
                out[i] = lcs_length(a[i], b[i])
            continue
        codes = lambda s, n: np.frombuffer("".join([s[i] for i in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), n).T.copy()
        one, two = codes(a, n1), codes(b, n2)
        bit = np.left_shift(np.uint64(1), np.arange(n1, dtype=np.uint64))[:, None]
        full = np.uint64((1 << n1) - 1)
        s = np.full(len(rows), full)
        for ch in two:
            u = s & np.where(one == ch, bit, np.uint64(0)).sum(0, dtype=np.uint64)
            s = ((s + u) | (s - u)) & full
        for i, n in zip(rows, (n1 - np.bitwise_count(s).astype(np.int64)).tolist()):
            out[i] = n
    return out


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a.tolist(), b.tolist()), dtype="Int32")


def lcs_native(a: Column, b: Column) -> Column:
    """LCS length as nested SQL lambdas (no Python). Row j of the DP is
    cur[j] = max(prev[j], max over k<=j with b[k]=c of prev[k-1]+1)."""
    lb = F.length(b)
    zero = F.array_repeat(F.lit(0), lb + 1)

    def step(prev, c):
        def cell(j):
            hits = F.filter(F.sequence(F.lit(1), F.greatest(j, F.lit(1))), lambda k: (k <= j) & (F.substring(b, k, 1) == c))
            best = F.array_max(F.transform(hits, lambda k: F.element_at(prev, k) + 1))
            return F.greatest(F.element_at(prev, j + 1), F.coalesce(best, F.lit(0)))

        return F.transform(F.sequence(F.lit(0), lb), cell)

    chars = F.filter(F.split(a, ""), lambda x: x != "")
    last = F.aggregate(chars, zero, step)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.element_at(last, lb + 1))


def ratio_from_lcs(lcs: Column, la: Column, lb: Column) -> Column:
    """round(200*lcs/(la+lb)) with ties to even, in integer arithmetic; 0 if a side is empty."""
    x = lcs.cast("long") * 200
    d = (la + lb).cast("long")
    q = F.floor(x / d).cast("long")
    r = x - q * d
    rounded = F.when(2 * r > d, q + 1).when((2 * r == d) & (q % 2 == 1), q + 1).otherwise(q)
    return F.when((la == 0) | (lb == 0), F.lit(0)).otherwise(rounded).cast("int")


def fuzzy_ratio(a: Column, b: Column, native: bool = False) -> Column:
    """L1: indel ratio 0-100 of two strings."""
    lcs = lcs_native(a, b) if native else lcs_udf(a, b)
    return ratio_from_lcs(lcs, F.length(a), F.length(b))


def above_threshold(lcs: Column, la: Column, lb: Column, min_score: int = 80) -> Column:
    """score > min_score, exactly: round-half-even(200*lcs/d) > s  <=>  400*lcs > (2s+1)*d."""
    return F.lit(400) * lcs > F.lit(2 * min_score + 1) * (la + lb)


# ---------------------------------------------------------------------------------------
# Normal forms of a name


def strip_whitespace(c: Column) -> Column:
    """Remove all whitespace runs (Unicode-aware like Python's \\s)."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def strip_digits(c: Column) -> Column:
    """Remove digit runs (Unicode-aware like Python's \\d)."""
    return F.regexp_replace(c, r"(?U)\d+", "")


def case_fold(c: Column) -> Column:
    """X3."""
    return F.lower(c)


def special_chars(c: Column) -> Column:
    """The characters outside [a-zA-Z0-9 ] (in order, with repeats)."""
    return F.regexp_replace(c, "[a-zA-Z0-9 ]+", "")


def letters_only(c: Column) -> Column:
    """Keep [a-zA-Z ] and lower-case."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z ]", ""))


def possible_camel_case(a1: Column) -> Column:
    """Decided on attribute1 only: capitals after the first char and no whitespace."""
    return (F.substr(a1, F.lit(2)) != F.substr(F.lower(a1), F.lit(2))) & (a1 == strip_whitespace(a1))


# Fixed value: where a camel-case name is split.
CAMEL_SPLIT = r"((?<=[a-z])[A-Z]|(?<!\A)[A-Z](?=[a-z]))"


def _split_ws(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda t: t != "")


def camel_tokens_cased(c: Column) -> Column:
    """Camel split of the letters-and-spaces text, case kept: sampleSourceDNAName -> sample Source DNA Name."""
    kept = F.regexp_replace(c, "[^a-zA-Z ]", "")
    return _split_ws(F.regexp_replace(kept, CAMEL_SPLIT, " $1"))


def word_punct_tokens(c: Column) -> Column:
    """Word and punctuation runs: \\w+ | [^\\w\\s]+ (Unicode classes)."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]+"), 0)


def tokens(c: Column, camel: Column) -> Column:
    """Lower-case letter tokens; camel split when the pair is camel case."""
    plain = _split_ws(letters_only(c))
    cam = F.transform(camel_tokens_cased(c), lambda t: F.lower(t))
    return F.when(camel, cam).otherwise(plain)


def cased_tokens(c: Column, camel: Column) -> Column:
    """Tokens with case kept: camel split, else word/punct tokens of the digit-free name."""
    return F.when(camel, camel_tokens_cased(c)).otherwise(word_punct_tokens(F.regexp_replace(c, r"(?U)\d+", "")))


def printed_list(arr: Column) -> Column:
    """Text of a Python list of plain words: ['a', 'b'] ([] when empty)."""
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']")))


def strip_one_s(arr: Column) -> Column:
    """Drop one trailing 's' from each token."""
    return F.transform(arr, lambda t: F.when(t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def pair_name(a1: Column, a2: Column) -> Column:
    """L6: 'a1 § a2'."""
    return F.concat_ws(" § ", a1, a2)


def pair_id(name: Column) -> Column:
    return F.xxhash64(name)
