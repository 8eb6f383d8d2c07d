"""Registered queries for candidate pairs (L*), pair diagnosis (X*) and R3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.catalog import SQL_BASKETS, register
from attrmill.operators import lexical as L
from attrmill.operators import recommend as R
from attrmill.operators import stats as B
from attrmill.plans import similarity_join as S
from attrmill.session import cut_lineage, written
from attrmill.sources import adapters as A


def sql_lcs(a: str, b: str) -> str:
    """LCS length in DuckDB SQL (list lambdas), the same DP row rule as the native Spark form."""
    return (
        f"list_reduce(str_split({a}, ''), lambda prev, c: "
        f"[greatest(prev[j+1], coalesce(list_max([prev[k] + 1 for k in range(1, j+1) "
        f"if substr({b}, k::BIGINT, 1) = c]), 0)) for j in range(0, length({b})+1)], "
        f"[0 for _x in range(0, length({b})+1)])[length({b})+1]"
    )


def sql_ratio(lcs: str, la: str, lb: str) -> str:
    x, d = f"(200 * ({lcs}))", f"(({la}) + ({lb}))"
    q = f"({x} // {d})"
    r = f"({x} - {q} * {d})"
    return (
        f"CAST(CASE WHEN ({la}) = 0 OR ({lb}) = 0 THEN 0 WHEN 2 * {r} > {d} THEN {q} + 1 "
        f"WHEN 2 * {r} = {d} AND {q} % 2 = 1 THEN {q} + 1 ELSE {q} END AS INTEGER)"
    )


SQL_SIMILAR_BASKETS = (
    "WITH "
    + SQL_BASKETS
    + f""",
voc AS (SELECT DISTINCT attribute AS w FROM baskets),
cand AS (SELECT a.w AS attribute1, b.w AS attribute2, length(a.w) AS la, length(b.w) AS lb,
                {sql_lcs('a.w', 'b.w')} AS lcs
         FROM voc a JOIN voc b ON a.w < b.w
         WHERE 400 * least(length(a.w), length(b.w)) > 161 * (length(a.w) + length(b.w))),
sim AS (SELECT attribute1, attribute2, {sql_ratio('lcs', 'la', 'lb')} AS levenshtein
            FROM cand WHERE 400 * lcs > 161 * (la + lb))"""
)


def baskets_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.attribute_frequency(A.baskets(spark, sf_dir))


@register("similar_pairs", SQL_SIMILAR_BASKETS + " SELECT * FROM sim")
def q_similar_pairs(spark, sf_dir):
    return S.similar_pairs(baskets_vocabulary(spark, sf_dir))


@register(
    "candidate_pairs",
    SQL_SIMILAR_BASKETS
    + """ SELECT attribute1, attribute2, levenshtein, attribute1 || ' § ' || attribute2 AS name FROM sim
          WHERE NOT (regexp_matches(attribute1, '^[atgcuATGCU]+$') AND regexp_matches(attribute2, '^[atgcuATGCU]+$'))
            AND NOT (contains(attribute1, 'vioscreen') AND contains(attribute2, 'vioscreen'))""",
)
def q_candidate_pairs(spark, sf_dir):
    # (no baskets name contains the exempt term, so the rescoring branch is empty here)
    return S.candidate_pairs(baskets_vocabulary(spark, sf_dir)).drop("pair_id")


@register("similar_pairs_tokens")
def q_similar_pairs_tokens(spark, sf_dir):
    """L2 over the whole word vocabulary of all documents (no SQL twin: no LCS at this size in SQL)."""
    return S.similar_pairs(B.attribute_frequency(A.tokens(spark, sf_dir)))


def _diagnosis(spark: SparkSession, sf_dir: str, vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    # each is read by several branches of the diagnosis
    vocabulary = cut_lineage(vocabulary)
    dic = cut_lineage(L.dictionary_from_tokens(tokens))
    pairs = cut_lineage(S.candidate_pairs(vocabulary).select("attribute1", "attribute2", "levenshtein"))
    return L.diagnose(pairs, vocabulary, dic)


@register("pair_diagnosis")
def q_pair_diagnosis(spark, sf_dir):
    d = _diagnosis(spark, sf_dir, baskets_vocabulary(spark, sf_dir), A.tokens(spark, sf_dir))
    return d.drop("pair_id").withColumn("issue_message", L.issue_message())


def _token_diagnosis(spark, sf_dir):
    tokens = written(A.tokens(spark, sf_dir), "tokens")
    return _diagnosis(spark, sf_dir, B.attribute_frequency(tokens), tokens)


@register("flag_signature_counts")
def q_flag_signature_counts(spark, sf_dir):
    return L.flag_signature_counts(_token_diagnosis(spark, sf_dir))


@register("flag_totals")
def q_flag_totals(spark, sf_dir):
    return L.flag_totals(_token_diagnosis(spark, sf_dir))


@register("issue_messages")
def q_issue_messages(spark, sf_dir):
    d = _diagnosis(spark, sf_dir, baskets_vocabulary(spark, sf_dir), A.tokens(spark, sf_dir))
    return d.select("name", L.issue_message().alias("issue_message"), "pseudo_confidence")


@register(
    "did_you_mean",
    "WITH "
    + SQL_BASKETS
    + f""",
voc AS (SELECT DISTINCT attribute AS w FROM baskets),
q AS (SELECT DISTINCT event_type AS query FROM events),
hit AS (SELECT query FROM q WHERE query IN (SELECT w FROM voc)),
cand AS (SELECT query, w, {sql_lcs('query', 'w')} AS lcs, length(query) AS la, length(w) AS lb
         FROM q JOIN voc ON query <> w),
scored AS (SELECT query, w AS suggestion, 2.0 * lcs / (la + lb) AS score FROM cand
           WHERE 10 * lcs >= 3 * (la + lb) AND query NOT IN (SELECT query FROM hit)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, suggestion DESC) AS rank FROM scored)
SELECT q.query, q.query IN (SELECT query FROM hit) AS known,
       list(r.suggestion ORDER BY r.rank) FILTER (WHERE r.suggestion IS NOT NULL) AS suggestions
FROM q LEFT JOIN ranked r ON q.query = r.query AND r.rank <= 3
GROUP BY q.query""",
)
def q_did_you_mean(spark, sf_dir):
    queries = A.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("query")).distinct()
    out = R.did_you_mean(queries, baskets_vocabulary(spark, sf_dir))
    return out
