import itertools
import random

import duckdb
import pytest

from attrmill.functions.text import lcs_length, lcs_lengths
from attrmill.plans import similarity_join as S


def _brute(words, min_score=80):
    out = set()
    for a, b in itertools.combinations(sorted(set(words)), 2):
        if 400 * lcs_length(a, b) > (2 * min_score + 1) * (len(a) + len(b)):
            out.add((a, b))
    return out


def test_signature_join_equals_brute_force(spark):
    words = [r[0] for r in duckdb.sql(
        "select distinct unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) from '/root/testdata/sf0.001/documents.parquet'"
    ).fetchall()]
    rnd = random.Random(11)
    sample = rnd.sample(sorted(words), 800) + ["frozenDessertFrequency", "frozenDesertFrequency", "serovar", "sex"]
    voc = spark.createDataFrame([(w,) for w in sample], "attribute string")
    got = {(r.attribute1, r.attribute2) for r in S.similar_pairs(voc).collect()}
    assert got == _brute(sample)
    assert ("frozenDesertFrequency", "frozenDessertFrequency") in got
    assert ("serovar", "sex") not in got


def _names(n, seed, low=3, high=60):
    """Names of words that many share, with near copies a few letters apart."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeghilmnoprstuäé_ 01") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    out = set()
    while len(out) < n:
        name = "_".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))[: rnd.randint(low, high)]
        out.add(name)
        for _ in range(rnd.randint(0, 2)):
            chars = list(name)
            for _ in range(rnd.randint(1, max(1, len(chars) // 6))):
                at = rnd.randrange(len(chars))
                if rnd.random() < 0.5:
                    chars.insert(at, rnd.choice("abcx"))
                elif len(chars) > 1:
                    del chars[at]
            out.add("".join(chars))
    return sorted(out)


@pytest.mark.parametrize("min_score,short", [(80, S.SHORT), (80, 0), (70, 6), (55, 0)])
def test_long_and_short_names_equal_brute_force(spark, min_score, short):
    names = _names(320, min_score) + ["a", "aa", "aaa", "aaaa", "abab" * 12, "baba" * 12, "ab" * 30, "x" * 60, "x" * 50, "ä" * 13, "ä" * 12]
    voc = spark.createDataFrame([(w,) for w in [*names, None, ""]], "attribute string")
    rows = S.similar_pairs(voc, min_score, short=short).collect()
    assert len(rows) == len({(r.attribute1, r.attribute2) for r in rows})
    assert {(r.attribute1, r.attribute2) for r in rows} == _brute(names, min_score)
    for r in rows:
        x, d = 200 * lcs_length(r.attribute1, r.attribute2), len(r.attribute1) + len(r.attribute2)
        assert r.levenshtein == round(x / d) and r.levenshtein > min_score


@pytest.mark.parametrize("num,den", [(3, 5), (4, 5), (1, 1)])
def test_ratio_join_equals_brute_force(spark, num, den):
    names = _names(260, 5)
    left, right = names[::7] + ["abc", "unknown thing"], names[::2]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string")
    got = sorted((r.query, r.word, r.lcs) for r in S.ratio_cutoff_pairs(frame(left), frame(right), num, den).collect())
    want = [(a, b, lcs_length(a, b)) for a in set(left) for b in set(right) if a != b and 2 * den * lcs_length(a, b) >= num * (len(a) + len(b))]
    assert got == sorted(want)


def test_empty_vocabulary(spark):
    assert S.similar_pairs(spark.createDataFrame([], "attribute string")).count() == 0


def test_exemption_and_nucleotides(spark):
    pairs = spark.createDataFrame(
        [("gut", "guta", 86), ("cat", "cart", 86), ("vioscreen_a", "vioscreen_b", 91)],
        "attribute1 string, attribute2 string, levenshtein int",
    )
    kept = {r.attribute1 for r in S.drop_nucleotide_pairs(S.shared_term_exemption(pairs)).collect()}
    assert kept == {"cat"}


def test_deletion_counts_cover_every_partner_length():
    for la in range(1, 25):
        for lb in range(1, 40):
            t = S.min_common(la, lb, 80)
            if t <= min(la, lb):
                assert la - t in S.deletion_counts(la, 80)
                assert lb - t in S.deletion_counts(lb, 80)


def test_exempt_term_is_taken_literally(spark):
    pairs = spark.createDataFrame(
        [("v.x visit", "v.x visits", 95), ("v.x a", "v.x b", 80), ("vax one", "vax two", 81)], "attribute1 string, attribute2 string, levenshtein int"
    )
    got = {(r.attribute1, r.levenshtein) for r in S.shared_term_exemption(pairs, term="v.x").collect()}
    assert got == {("v.x visit", 92), ("vax one", 81)}


def test_deletion_hashes_stand_for_the_variants():
    """Equal hashes where, and but for collisions only where, variants are equal; each once, with its length."""
    words = ["a", "ab", "ba", "aab", "banana", "ananas", "frozen", "frozne", "ä\x00ä", "abcabcabcabc", "bcabcabcabca", "x" * 12]
    ks = {n: S.deletion_counts(n, longest=12) for n in range(1, 13)}
    found = dict(zip(words, S.deletion_hashes(words, ks)))
    for w in words:
        assert len(found[w]) == len(set(found[w].tolist())) == len(S.deletion_variants(w, ks[len(w)]))
        assert sorted(int(h) & 63 for h in found[w]) == sorted(len(v) for v in S.deletion_variants(w, ks[len(w)]))
    for v, w in itertools.combinations(words, 2):
        same = set(S.deletion_variants(v, ks[len(v)])) & set(S.deletion_variants(w, ks[len(w)]))
        assert len(set(found[v].tolist()) & set(found[w].tolist())) == len(same)


def test_lcs_of_rows_equals_single_pairs():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abä") for _ in range(n))
    a = [word(rnd.choice([0, 1, 7, 63, 64])) for _ in range(2000)] + [None, "a", None]
    b = [word(rnd.choice([0, 1, 6, 70])) for _ in range(2000)] + ["a", None, None]
    assert lcs_lengths(a, b) == [None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b)]


def test_variants_are_not_shuffled_as_text(spark):
    """Short words join on one number a variant; the old plan dealt out the text of each variant in Python lists."""
    words = S._words(spark.createDataFrame([("word",), ("words",)], "attribute string"), "attribute")
    pairs = S._variant_pairs(words, S.score_cutoff(80), S.SHORT)
    assert "array<string>" not in pairs._jdf.queryExecution().analyzed().treeString()
    assert [(r.x, r.y) for r in pairs.collect()] == [("word", "words")]
