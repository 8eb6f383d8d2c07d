"""Registered queries of the pair diagnosis (X*) over part names in several spellings, with SQL
twins of everything but stems (Porter's rules have no SQL form; see tests/test_porter.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrmill.catalog import register
from attrmill.catalog_lexical import sql_lcs, sql_ratio
from attrmill.functions import text as X
from attrmill.operators import lexical as L
from attrmill.operators import stats as B
from attrmill.plans import similarity_join as S
from attrmill.session import cut_lineage
from attrmill.sources import adapters as A

FLAGS = [f for f in L.FLAGS if f != "stem_discrepancy"]


def _ratio(a: str, b: str) -> str:
    return sql_ratio(sql_lcs(a, b), f"length({a})", f"length({b})")


def _printed(tokens: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN '[]' ELSE '[''' || array_to_string({tokens}, ''', ''') || ''']' END"


def _no_s(tokens: str) -> str:
    return f"list_sort([CASE WHEN t LIKE '%s' THEN substr(t, 1, length(t) - 1) ELSE t END for t in {tokens}])"


_STOPS = "[" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "]"
_FORMS = ", ".join(
    f"{{'rank': {i}, 'cand': CASE WHEN token LIKE '%{suf}' AND length(token) > {len(suf)} THEN substr(token, 1, length(token) - {len(suf)}) || '{rep}' END}}"
    for i, (suf, rep) in enumerate(L.NOUN_RULES, start=1)
)

SQL_NAMES = f"""WITH styled AS (
  SELECT DISTINCT l_orderkey AS sample_id, {A.STYLED_NAME} AS attribute FROM lineitem JOIN part ON l_partkey = p_partkey),
attrs AS (SELECT attribute, count(*) AS frequency FROM styled GROUP BY attribute),
forms AS (
  SELECT attribute, regexp_replace(attribute, '\\s+', '', 'g') AS no_space, regexp_replace(attribute, '\\d+', '', 'g') AS no_digits,
         lower(attribute) AS lower_case, regexp_replace(attribute, '[a-zA-Z0-9 ]+', '', 'g') AS specials,
         regexp_replace(attribute, '[^a-zA-Z ]', '', 'g') AS kept FROM attrs),
camels AS (SELECT *, substr(attribute, 2) <> substr(lower_case, 2) AND attribute = no_space AS camel FROM forms),
split AS (
  SELECT *, list_filter(string_split(lower(kept), ' '), lambda t: t <> '') AS plain,
         list_filter(string_split(regexp_replace(regexp_replace(kept, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([^ ])([A-Z][a-z])', '\\1 \\2', 'g'), ' '),
                     lambda t: t <> '') AS cut,
         regexp_extract_all(no_digits, '\\w+|[^\\w\\s]+') AS runs FROM camels)"""

SQL_FLAGS = (
    SQL_NAMES
    + f""",
near AS (
  SELECT a.attribute AS attribute1, b.attribute AS attribute2, a.camel, length(a.attribute) AS la, length(b.attribute) AS lb
  FROM split a JOIN split b ON a.attribute < b.attribute
  -- the indel distance is at least the Levenshtein distance
  WHERE levenshtein(a.attribute, b.attribute) <= length(a.attribute) + length(b.attribute)
        - 2 * (161 * (length(a.attribute) + length(b.attribute)) // 400 + 1)),
scored AS (SELECT *, {sql_lcs('attribute1', 'attribute2')} AS lcs FROM near),
prs AS (SELECT attribute1, attribute2, camel, {sql_ratio('lcs', 'la', 'lb')} AS levenshtein FROM scored WHERE 400 * lcs > 161 * (la + lb)),
toks AS (
  SELECT x.attribute, x.camel, CASE WHEN x.camel THEN [lower(t) for t in s.cut] ELSE s.plain END AS tokens,
         CASE WHEN x.camel THEN s.cut ELSE s.runs END AS cased
  FROM (SELECT attribute1 AS attribute, camel FROM prs UNION SELECT attribute2, camel FROM prs) x JOIN split s ON x.attribute = s.attribute),
words AS (SELECT attribute, camel, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM toks),
dic AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
lemmas AS (
  SELECT token, min({{'len': length(f.cand), 'rank': f.rank, 'cand': f.cand}}).cand AS lemma
  FROM (SELECT token, unnest([{{'rank': 0, 'cand': token}}, {_FORMS}]) AS f FROM (SELECT DISTINCT token FROM words))
  WHERE f.cand IN (SELECT word FROM dic) GROUP BY token),
per AS (
  SELECT w.attribute, w.camel, list(coalesce(l.lemma, w.token) ORDER BY w.pos) AS lemmas,
         coalesce(list(w.token ORDER BY w.pos) FILTER (WHERE w.token NOT IN (SELECT word FROM dic)), []) AS unknown
  FROM words w LEFT JOIN lemmas l ON w.token = l.token GROUP BY w.attribute, w.camel),
sides AS (
  SELECT t.*, coalesce(p.lemmas, []) AS lemmas, coalesce(p.unknown, []) AS unknown, {_printed('t.tokens')} AS ptok,
         {_printed('coalesce(p.lemmas, [])')} AS plem, s.no_space, s.no_digits, s.lower_case, s.specials,
         regexp_replace(t.attribute, '[^a-zA-Z0-9 ]', '', 'g') AS no_specials
  FROM toks t JOIN split s ON t.attribute = s.attribute LEFT JOIN per p ON p.attribute = t.attribute AND p.camel = t.camel),
flat AS (
  SELECT prs.*, a.tokens AS t1, b.tokens AS t2, a.cased AS c1, b.cased AS c2, a.unknown AS u1, b.unknown AS u2, a.ptok AS ptok1, b.ptok AS ptok2,
         a.plem AS plem1, b.plem AS plem2, a.no_space AS sp1, b.no_space AS sp2, a.no_digits AS nd1, b.no_digits AS nd2,
         a.lower_case AS lc1, b.lower_case AS lc2, a.specials AS x1, b.specials AS x2, a.no_specials AS ns1, b.no_specials AS ns2
  FROM prs JOIN sides a ON a.attribute = attribute1 AND a.camel = prs.camel JOIN sides b ON b.attribute = attribute2 AND b.camel = prs.camel),
marks AS (
  SELECT *, list_sort(string_split(x1, '')) <> list_sort(string_split(x2, '')) AS specials_discrepancy,
         {_ratio('plem1', 'plem2')} > {_ratio('ptok1', 'ptok2')} AS lemma_discrepancy,
         {_no_s('t1')} = {_no_s('t2')} AS same_words, {_no_s('c1')} = {_no_s('c2')} AS same_cased FROM flat),
flags AS (
  SELECT attribute1 || ' § ' || attribute2 AS name, attribute1, attribute2, levenshtein, camel AS possible_camel_case,
         {_ratio('nd1', 'nd2')} > levenshtein AS number_discrepancy, {_ratio('lc1', 'lc2')} > levenshtein AS case_discrepancy,
         length(attribute1) - length(sp1) <> length(attribute2) - length(sp2) AS space_discrepancy, specials_discrepancy,
         len(t1) <> len(t2) AS word_no_discrepancy,
         list_sort(list_filter(t1, lambda t: list_contains({_STOPS}, t))) <> list_sort(list_filter(t2, lambda t: list_contains({_STOPS}, t))) AS stop_word_discrepancy,
         list_sort(u1) <> list_sort(u2) AS spell_discrepancy, lemma_discrepancy, sp1 = sp2 AS only_space_discrepancy,
         specials_discrepancy AND ns1 = ns2 AS just_specials_discrepancy, lemma_discrepancy AND same_words AS s_discrepancy,
         lemma_discrepancy AND same_words AND NOT same_cased AS s_lower_discrepancy,
         array_to_string(list_sort(list_distinct(u1 || u2)), ' ') AS bad_words FROM marks)"""
)


@register(
    "name_forms",
    SQL_NAMES
    + """ SELECT attribute, no_space, no_digits, lower_case, specials, lower(kept) AS letters, camel,
          array_to_string(CASE WHEN camel THEN [lower(t) for t in cut] ELSE plain END, '|') AS tokens,
          array_to_string(CASE WHEN camel THEN cut ELSE runs END, '|') AS cased_tokens FROM split""",
)
def q_name_forms(spark, sf_dir):
    """The normal forms and tokens of every name (camel case by the name itself)."""
    c, camel = F.col("attribute"), X.possible_camel_case(F.col("attribute"))
    return B.attribute_frequency(A.styled_baskets(spark, sf_dir)).select(
        c, X.strip_whitespace(c).alias("no_space"), X.strip_digits(c).alias("no_digits"), X.case_fold(c).alias("lower_case"),
        X.special_chars(c).alias("specials"), X.letters_only(c).alias("letters"), camel.alias("camel"),
        F.array_join(X.tokens(c, camel), "|").alias("tokens"), F.array_join(X.cased_tokens(c, camel), "|").alias("cased_tokens"),
    )


def _diagnosed(spark, sf_dir):
    # both are read by several branches of the diagnosis
    names = cut_lineage(B.attribute_frequency(A.styled_baskets(spark, sf_dir)))
    pairs = cut_lineage(S.candidate_pairs(names).select("attribute1", "attribute2", "levenshtein"))
    return L.diagnose(pairs, names, A.part_words(spark, sf_dir))


@register(
    "name_pair_flags",
    SQL_FLAGS
    + f""" SELECT f.name, f.levenshtein, f.possible_camel_case, {', '.join(FLAGS)}, bad_words,
           CASE WHEN a.frequency > b.frequency THEN attribute1 ELSE attribute2 END AS good_attribute,
           greatest(a.frequency, b.frequency) AS good_freq, least(a.frequency, b.frequency) AS bad_freq
           FROM flags f JOIN attrs a ON f.attribute1 = a.attribute JOIN attrs b ON f.attribute2 = b.attribute""",
)
def q_name_pair_flags(spark, sf_dir):
    """X9-X24, X28 with a curator's own word list: all flags but stems for every pair of similar names."""
    bad = F.array_join(F.array_sort(F.array_distinct(F.coalesce("bad_words", F.array().cast("array<string>")))), " ").alias("bad_words")
    return _diagnosed(spark, sf_dir).select("name", "levenshtein", "possible_camel_case", *FLAGS, bad, "good_attribute", "good_freq", "bad_freq")


@register(
    "name_flag_totals",
    SQL_FLAGS
    + " SELECT "
    + ", ".join(f"count_if({f}) AS {f}" for f in FLAGS)
    + ", count_if(possible_camel_case) AS camel_case, count_if(NOT possible_camel_case) AS not_camel_case, count(*) AS pairs FROM flags",
)
def q_name_flag_totals(spark, sf_dir):
    """X29, X31 over the styled names."""
    return L.flag_totals(_diagnosed(spark, sf_dir)).drop("stem_discrepancy", "undiagnosed")


@register("name_flag_signatures", SQL_FLAGS + f" SELECT {', '.join(FLAGS)}, count(*) AS count FROM flags GROUP BY ALL")
def q_name_flag_signatures(spark, sf_dir):
    """X30 over the styled names, without stems."""
    return L.flag_signature_counts(_diagnosed(spark, sf_dir)).groupBy(*FLAGS).agg(F.sum("count").alias("count"))
