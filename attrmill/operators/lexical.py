"""Pair diagnosis (X1-X32): why two similar attribute names differ.

Work is split by what it depends on:
* per token (dictionary membership, noun lemma, Porter stem): computed once
  over the distinct tokens of the vocabulary (X9-X11);
* per (attribute, camel mode): tokens and their lemma/stem/unknown lists,
  reassembled in token order with a join + ordered collect per attribute;
* per (attribute, camel mode) as well: every form that pairs compare (`attribute_forms`);
* per pair: comparisons of forms, and indel ratios only of forms that differ from the name.
The pair table joins the per-attribute table twice (shuffle joins on the
attribute name); nothing is broadcast whose size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrmill.functions import text as X
from attrmill.functions.porter import stem_udf
from attrmill.session import written

# The English stop word list named by the reference's documentation (in its order).
STOP_WORDS = [
    "on", "here", "himself", "just", "doesn", "hadn", "mightn", "before", "our", "so", "be", "haven", "off", "up",
    "o", "same", "ma", "yourself", "when", "between", "wouldn", "re", "were", "too", "his", "theirs", "them", "few",
    "weren", "of", "nor", "only", "such", "but", "the", "not", "didn", "i", "an", "is", "don", "him", "a", "it",
    "below", "t", "ourselves", "we", "did", "each", "while", "being", "couldn", "he", "doing", "y", "some", "down",
    "yours", "more", "hers", "whom", "she", "other", "very", "having", "this", "into", "during", "further", "by",
    "in", "no", "because", "or", "under", "are", "do", "they", "their", "your", "both", "why", "as", "herself",
    "from", "until", "all", "after", "needn", "against", "and", "myself", "wasn", "own", "was", "me", "her",
    "shouldn", "won", "who", "had", "where", "than", "will", "now", "over", "m", "have", "with", "through", "d",
    "ll", "isn", "my", "to", "itself", "has", "once", "for", "been", "again", "ve", "at", "mustn", "those", "that",
    "you", "any", "s", "should", "hasn", "above", "does", "which", "its", "shan", "these", "if", "there", "how",
    "ours", "then", "can", "out", "about", "ain", "aren", "most", "yourselves", "am", "what", "themselves",
]

# WordNet's noun detachment rules (suffix, replacement), in its order.
NOUN_RULES = [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]

FLAGS = [
    "number_discrepancy",
    "case_discrepancy",
    "space_discrepancy",
    "specials_discrepancy",
    "word_no_discrepancy",
    "stop_word_discrepancy",
    "spell_discrepancy",
    "lemma_discrepancy",
    "stem_discrepancy",
    "only_space_discrepancy",
    "just_specials_discrepancy",
    "s_discrepancy",
    "s_lower_discrepancy",
]


# ---------------------------------------------------------------------------------------
# Dictionary (S6 / X9 input)


def dictionary_from_tokens(token_sample_attr: DataFrame, min_docs: int = 20) -> DataFrame:
    """Lower-case words used in at least `min_docs` samples -> (word)."""
    return (
        token_sample_attr.select("sample_id", F.lower("attribute").alias("word"))
        .distinct()
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= min_docs)
        .select("word")
    )


# ---------------------------------------------------------------------------------------
# Token level


def token_info(tokens_df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token) -> (token, known, lemma, stem) over distinct tokens.

    lemma: the shortest of {token} + noun-rule forms that is in the dictionary
    (earlier rule wins a tie); the token itself when none is.
    """
    toks = tokens_df.select("token").distinct()
    dic = dictionary.select(F.col("word").alias("cand")).distinct()
    forms = [F.struct(F.lit(0).alias("rank"), F.col("token").alias("cand"))]
    for i, (suf, rep) in enumerate(NOUN_RULES, start=1):
        cut = F.col("token").substr(F.lit(1), F.length("token") - len(suf))
        forms.append(
            F.struct(
                F.lit(i).alias("rank"),
                F.when(F.col("token").endswith(suf) & (F.length("token") > len(suf)), F.concat(cut, F.lit(rep))).alias("cand"),
            )
        )
    cands = toks.select("token", F.explode(F.array(*forms)).alias("f")).select("token", "f.rank", "f.cand").where(F.col("cand").isNotNull())
    found = cands.join(dic, "cand", "left_semi")
    best = found.groupBy("token").agg(F.min(F.struct(F.length("cand").alias("len"), "rank", "cand")).getField("cand").alias("lemma"))
    known = toks.join(dic.withColumnRenamed("cand", "token"), "token", "left_semi").select("token", F.lit(True).alias("known"))
    return (
        toks.join(best, "token", "left")
        .join(known, "token", "left")
        .select(
            "token",
            F.coalesce("known", F.lit(False)).alias("known"),
            F.coalesce("lemma", "token").alias("lemma"),
            stem_udf("token").alias("stem"),
        )
    )


# ---------------------------------------------------------------------------------------
# Attribute level


def attribute_tokens(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(attribute, camel) -> tokens, cased tokens, lemmas, stems, unknown words."""
    camel = X.possible_camel_case(F.col("attribute1"))
    both = pairs.select(F.col("attribute1").alias("attribute"), camel.alias("camel")).unionByName(
        pairs.select(F.col("attribute2").alias("attribute"), camel.alias("camel"))
    ).distinct()
    toks = both.select("attribute", "camel", X.tokens(F.col("attribute"), F.col("camel")).alias("tokens"),
                       X.cased_tokens(F.col("attribute"), F.col("camel")).alias("cased_tokens"))
    exploded = toks.select("attribute", "camel", F.posexplode("tokens").alias("pos", "token"))
    info = token_info(exploded, dictionary)
    per = (
        exploded.join(info, "token")
        .groupBy("attribute", "camel")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "lemma", "stem", "known", "token"))).alias("t"))
        .select(
            "attribute",
            "camel",
            F.transform("t", lambda s: s["lemma"]).alias("lemmas"),
            F.transform("t", lambda s: s["stem"]).alias("stems"),
            F.transform(F.filter("t", lambda s: ~s["known"]), lambda s: s["token"]).alias("unknown"),
        )
    )
    empty = F.array().cast("array<string>")
    return toks.join(per, ["attribute", "camel"], "left").select(
        "attribute",
        "camel",
        "tokens",
        "cased_tokens",
        F.coalesce("lemmas", empty).alias("lemmas"),
        F.coalesce("stems", empty).alias("stems"),
        F.coalesce("unknown", empty).alias("unknown"),
    )


# ---------------------------------------------------------------------------------------
# Pair level


def _ratio(a: Column, b: Column) -> Column:
    return X.fuzzy_ratio(a, b)


def attribute_forms(at: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """(attribute, camel) -> all that the flags of a pair compare, computed once per attribute, however
    many pairs it is in. A form that equals the name (a printed list that equals that of the
    tokens) is null, so that rows stay short and equal work is seen as such."""
    c, tok = F.col("attribute"), F.col("tokens")
    changed = lambda form: F.when(form != c, form)
    bare = X.strip_whitespace(c)
    stops = F.array(*[F.lit(w) for w in stop_words])
    printed = X.printed_list(tok)
    moved = lambda words: F.when(X.printed_list(F.col(words)) != printed, X.printed_list(F.col(words)))
    return at.select(
        "attribute",
        "camel",
        changed(X.strip_digits(c)).alias("digitless"),
        changed(F.lower(c)).alias("lowered"),
        changed(bare).alias("spaceless"),
        (F.length(c) - F.length(bare)).alias("blanks"),
        F.array_sort(F.filter(F.split(X.special_chars(c), ""), lambda x: x != "")).alias("specials"),
        changed(F.regexp_replace(c, "[^a-zA-Z0-9 ]", "")).alias("plain"),
        F.size(tok).alias("words"),
        F.array_sort(F.filter(tok, lambda t: F.array_contains(stops, F.lower(t)))).alias("stops"),
        "unknown",
        F.array_sort("unknown").alias("unknown_sorted"),
        printed.alias("printed"),
        moved("lemmas").alias("printed_lemmas"),
        moved("stems").alias("printed_stems"),
        F.array_sort(X.strip_one_s(tok)).alias("singular"),
        F.array_sort(X.strip_one_s(F.col("cased_tokens"))).alias("cased_singular"),
    )


def diagnose(pairs: DataFrame, attributes: DataFrame, dictionary: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """Flags, bad words, camel marker, pseudo confidence and polarity per pair.

    `pairs` has (attribute1, attribute2, levenshtein) with attribute1 < attribute2
    (the L2-L5 output); `attributes` has (attribute, frequency). The forms and the frequency
    of each attribute are written once and joined to both ends of its pairs.
    """
    forms = attribute_forms(attribute_tokens(pairs, dictionary), stop_words)
    forms = written(forms.join(attributes.select("attribute", "frequency"), "attribute", "left"), "attribute-forms")
    side = lambda i: forms.select(*[F.col(c).alias(f"{c}{i}") if c != "camel" else F.col(c) for c in forms.columns])
    p = pairs.withColumn("camel", X.possible_camel_case(F.col("attribute1")))
    p = p.join(side(1), ["attribute1", "camel"]).join(side(2), ["attribute2", "camel"])

    c1, c2 = F.col("attribute1"), F.col("attribute2")
    lev = F.col("levenshtein")
    both = lambda form, name="attribute": [F.coalesce(f"{form}{i}", f"{name}{i}") for i in (1, 2)]
    is_changed = lambda form: F.col(f"{form}1").isNotNull() | F.col(f"{form}2").isNotNull()
    # a ratio only where a form differs from what was compared already; the others pass nulls
    ratio_where = lambda cond, a, b: _ratio(F.when(cond, a), F.when(cond, b))
    base = _ratio(c1, c2)
    number = F.coalesce(ratio_where(is_changed("digitless"), *both("digitless")), base) > lev
    case = F.coalesce(ratio_where(is_changed("lowered"), *both("lowered")), base) > lev
    lemmas, stems = is_changed("printed_lemmas"), is_changed("printed_stems")
    printed = ratio_where(lemmas | stems, F.col("printed1"), F.col("printed2"))
    lemma = F.coalesce(ratio_where(lemmas, *both("printed_lemmas", "printed")) > printed, F.lit(False))
    stem = F.coalesce(ratio_where(stems, *both("printed_stems", "printed")) > printed, F.lit(False))
    (sp1, sp2), (plain1, plain2) = both("spaceless"), both("plain")
    specials = F.col("specials1") != F.col("specials2")
    s_flag = lemma & (F.col("singular1") == F.col("singular2"))
    s_lower = s_flag & (F.col("cased_singular1") != F.col("cased_singular2"))
    u1, u2 = F.col("unknown1"), F.col("unknown2")
    bad_words = F.when(F.size(u1) + F.size(u2) > 0, F.concat(u1, F.array_except(u2, u1)))

    out = p.select(
        "attribute1",
        "attribute2",
        "levenshtein",
        number.alias("number_discrepancy"),
        case.alias("case_discrepancy"),
        (F.col("blanks1") != F.col("blanks2")).alias("space_discrepancy"),
        specials.alias("specials_discrepancy"),
        (F.col("words1") != F.col("words2")).alias("word_no_discrepancy"),
        (F.col("stops1") != F.col("stops2")).alias("stop_word_discrepancy"),
        (F.col("unknown_sorted1") != F.col("unknown_sorted2")).alias("spell_discrepancy"),
        lemma.alias("lemma_discrepancy"),
        stem.alias("stem_discrepancy"),
        (sp1 == sp2).alias("only_space_discrepancy"),
        (specials & (plain1 == plain2)).alias("just_specials_discrepancy"),
        s_flag.alias("s_discrepancy"),
        s_lower.alias("s_lower_discrepancy"),
        bad_words.alias("bad_words"),
        F.col("camel").alias("possible_camel_case"),
        F.col("frequency1").alias("freq1"),
        F.col("frequency2").alias("freq2"),
    )
    out = _polarized(out.withColumn("pseudo_confidence", pseudo_confidence()))
    return out.withColumn("name", X.pair_name(c1, c2)).withColumn("pair_id", X.pair_id(F.col("name")))


def pseudo_confidence() -> Column:
    """0.1 for number; 0.9 for the exclusive flags; else 0.9 - 0.1 per issue."""
    f = F.col
    penalties = [
        f("case_discrepancy"),
        f("space_discrepancy"),
        f("specials_discrepancy"),
        f("word_no_discrepancy"),
        f("stop_word_discrepancy"),
        f("spell_discrepancy"),
        f("lemma_discrepancy") | f("stem_discrepancy"),
    ]
    tenths = F.lit(9)
    for pen in penalties:
        tenths = tenths - F.when(pen, 1).otherwise(0)
    exclusive = f("only_space_discrepancy") | f("just_specials_discrepancy") | f("s_discrepancy") | f("s_lower_discrepancy")
    score = F.when(f("number_discrepancy"), F.lit(1)).when(exclusive, F.lit(9)).otherwise(tenths)
    return F.round(score / F.lit(10.0), 1)


def polarity(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """The more frequent attribute is good; ties make attribute2 good."""
    f1 = attributes.select(F.col("attribute").alias("attribute1"), F.col("frequency").alias("freq1"))
    f2 = attributes.select(F.col("attribute").alias("attribute2"), F.col("frequency").alias("freq2"))
    p = pairs.join(f1, "attribute1", "left").join(f2, "attribute2", "left")
    return _polarized(p)


def _polarized(p: DataFrame) -> DataFrame:
    """The polarity of pairs that hold the frequencies of their ends (freq1, freq2) in place of them."""
    first_good = F.col("freq1") > F.col("freq2")
    return p.select(
        *[c for c in p.columns if c not in ("freq1", "freq2")],
        F.when(first_good, F.col("attribute1")).otherwise(F.col("attribute2")).alias("good_attribute"),
        F.when(first_good, F.col("attribute2")).otherwise(F.col("attribute1")).alias("bad_attribute"),
        F.when(first_good, F.col("freq1")).otherwise(F.col("freq2")).alias("good_freq"),
        F.when(first_good, F.col("freq2")).otherwise(F.col("freq1")).alias("bad_freq"),
    )


def undiagnosed() -> Column:
    """None of the 13 flags is true."""
    anyf = F.lit(False)
    for f in FLAGS:
        anyf = anyf | F.col(f)
    return ~anyf


def flag_totals(diag: DataFrame) -> DataFrame:
    """Totals of each flag, undiagnosed and camel-case pairs, in one pass."""
    aggs = [F.count_if(F.col(f)).alias(f) for f in FLAGS]
    aggs += [
        F.count_if(undiagnosed()).alias("undiagnosed"),
        F.count_if(F.col("possible_camel_case")).alias("camel_case"),
        F.count_if(~F.col("possible_camel_case")).alias("not_camel_case"),
        F.count(F.lit(1)).alias("pairs"),
    ]
    return diag.agg(*aggs)


def flag_signature_counts(diag: DataFrame) -> DataFrame:
    """Number of pairs per combination of the 13 flags."""
    return diag.groupBy(*FLAGS).agg(F.count(F.lit(1)).alias("count"))


def issue_message() -> Column:
    """The curator-facing message for a pair's flags."""
    f = F.col
    labels = [
        ("number_discrepancy", "numeric"),
        ("case_discrepancy", "case"),
        ("space_discrepancy", "space"),
        ("specials_discrepancy", "special characters"),
        ("stop_word_discrepancy", "stop word"),
        ("spell_discrepancy", "spelling"),
        ("lemma_discrepancy", "lemma"),
        ("stem_discrepancy", "stem"),
    ]
    issues = F.filter(F.array(*[F.when(f(c), F.lit(t)) for c, t in labels]), lambda x: x.isNotNull())
    n = F.size(issues)
    head = F.array_join(F.slice(issues, 1, F.greatest(n - 1, F.lit(1))), ", ")
    cumulative = (
        F.when(n == 0, F.lit("No lexical issues have been detected"))
        .when(n == 1, F.concat(F.element_at(issues, 1), F.lit(" discrepancy detected")))
        .otherwise(F.concat(head, F.lit(" and "), F.element_at(issues, -1), F.lit(" discrepancies detected")))
    )
    return (
        F.when(f("only_space_discrepancy"), F.lit("Space discrepancy detected"))
        .when(f("just_specials_discrepancy"), F.lit("Special character discrepancy detected"))
        .when(f("s_discrepancy"), F.lit("Pluralisation discrepancy detected"))
        .when(f("s_lower_discrepancy"), F.lit("Pluralisation and case discrepancy detected"))
        .otherwise(cumulative)
    )
