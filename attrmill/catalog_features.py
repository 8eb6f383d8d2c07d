"""Registered queries for per-pair co-occurrence features (C*) on the baskets graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.catalog import SQL_ATTRS, SQL_COEXIST, SQL_EDGES_RAW, SQL_NSAMPLES, SQL_SYM, baskets_stats, r6, register
from attrmill.catalog_lexical import SQL_SIMILAR_BASKETS
from attrmill.operators import coexist as C
from attrmill.operators import lexical as L
from attrmill.operators import stats as B
from attrmill.plans import similarity_join as S
from attrmill.session import written
from attrmill.sources import adapters as A

# Pair spine: the baskets candidate pairs with good/bad polarity by frequency.
SQL_PAIRS = (
    SQL_SIMILAR_BASKETS
    + ","
    + ",".join([SQL_ATTRS, SQL_COEXIST, SQL_NSAMPLES, SQL_EDGES_RAW, SQL_SYM])
    + """,
pairs AS (
  SELECT s.attribute1, s.attribute2, s.levenshtein, s.attribute1 || ' § ' || s.attribute2 AS name,
         CASE WHEN f1.frequency > f2.frequency THEN s.attribute1 ELSE s.attribute2 END AS good_attribute,
         CASE WHEN f1.frequency > f2.frequency THEN s.attribute2 ELSE s.attribute1 END AS bad_attribute,
         CASE WHEN f1.frequency > f2.frequency THEN f1.frequency ELSE f2.frequency END AS good_freq,
         CASE WHEN f1.frequency > f2.frequency THEN f2.frequency ELSE f1.frequency END AS bad_freq
  FROM sim s LEFT JOIN attrs f1 ON s.attribute1 = f1.attribute LEFT JOIN attrs f2 ON s.attribute2 = f2.attribute),
nodes AS (SELECT DISTINCT src AS attribute FROM sym),
deg AS (SELECT src AS attribute, count(DISTINCT dst) AS degree FROM sym GROUP BY src),
gp AS (SELECT * FROM pairs WHERE bad_attribute IN (SELECT attribute FROM nodes)
                              AND good_attribute IN (SELECT attribute FROM nodes)),
common AS (SELECT p.name, count(*) AS c FROM gp p
           JOIN (SELECT DISTINCT src, dst FROM sym) a ON a.src = p.bad_attribute
           JOIN (SELECT DISTINCT src, dst FROM sym) b ON b.src = p.good_attribute AND a.dst = b.dst GROUP BY p.name),
feat AS (
  SELECT p.name, p.bad_attribute, p.good_attribute, coalesce(w.weight, 0.0) AS edge_weight,
         coalesce(db.degree, 0) AS degree_bad, coalesce(dg.degree, 0) AS degree_good,
         coalesce(c.c, 0) AS common_n, w.weight IS NOT NULL AS adjacent
  FROM gp p LEFT JOIN deg db ON db.attribute = p.bad_attribute
            LEFT JOIN deg dg ON dg.attribute = p.good_attribute
            LEFT JOIN common c ON c.name = p.name
            LEFT JOIN sym w ON w.src = p.bad_attribute AND w.dst = p.good_attribute)"""
)


def baskets_pairs(spark: SparkSession, sf_dir: str, kept: tuple[str, ...] = ()) -> dict:
    s = baskets_stats(spark, sf_dir, kept)
    pairs = S.candidate_pairs(s["attributes"]).select("attribute1", "attribute2", "levenshtein", "name")
    s["pairs"] = L.polarity(pairs, s["attributes"])
    if "pairs" in kept:
        s["pairs"] = written(s["pairs"], "pairs")
    return s


@register(
    "attribute_degree",
    SQL_PAIRS + " SELECT attribute, degree FROM deg",
)
def q_attribute_degree(spark, sf_dir):
    return C.degree(baskets_stats(spark, sf_dir)["edges"])


@register(
    "pair_polarity",
    SQL_PAIRS + " SELECT name, good_attribute, bad_attribute, good_freq, bad_freq FROM pairs",
)
def q_pair_polarity(spark, sf_dir):
    return baskets_pairs(spark, sf_dir)["pairs"].select("name", "good_attribute", "bad_attribute", "good_freq", "bad_freq")


@register(
    "pair_graph_features",
    SQL_PAIRS
    + """ SELECT name, bad_attribute, good_attribute, round(edge_weight, 6) AS edge_weight,
          round(CASE WHEN degree_bad + degree_good - common_n > 0
                     THEN common_n / (degree_bad + degree_good - common_n) ELSE 0.0 END, 6) AS jaccard_coefficient,
          degree_bad, degree_good, degree_bad + degree_good AS edge_total,
          CAST(adjacent AS INTEGER) + common_n AS break_no_lower, least(degree_bad, degree_good) AS break_no_upper
          FROM feat""",
)
def q_pair_graph_features(spark, sf_dir):
    s = baskets_pairs(spark, sf_dir)
    f = C.graph_features(s["pairs"], s["edges"], exact_break_no=False)
    return f.select(
        "name", "bad_attribute", "good_attribute", r6("edge_weight"), r6("jaccard_coefficient"),
        "degree_bad", "degree_good", "edge_total", "break_no_lower", "break_no_upper",
    )


@register("pair_break_numbers")
def q_pair_break_numbers(spark, sf_dir):
    """C5/C6 with exact max-flow for the pairs whose bounds differ (no SQL twin)."""
    # the features read pairs and edges many times: what they are made of is written once
    s = baskets_pairs(spark, sf_dir, kept=("sample_attr", "coexist", "pairs"))
    f = C.graph_features(s["pairs"], written(s["edges"], "edges"), exact_break_no=True)
    return f.select("name", "break_no_lower", "break_no_upper", "break_no", "break_no_exact", r6("attribute_sim"))


@register("word_graph_break_numbers")
def q_word_graph_break_numbers(spark, sf_dir):
    """C5/C6 on the sparse graph of words that share a benchmark item, where most bounds differ and the flow runs
    (no SQL twin; tested against brute force)."""
    # the features read pairs and edges many times: what they are made of is written once
    sa = written(A.item_words(spark, sf_dir), "words")
    attributes = B.attribute_frequency(sa)
    weights = B.cooccurrence_weights(B.cooccurrence(sa), attributes, B.sample_total(sa))
    pairs = L.polarity(S.candidate_pairs(attributes).select("attribute1", "attribute2", "levenshtein", "name"), attributes)
    f = C.graph_features(written(pairs, "pairs"), written(B.symmetric_edges(weights), "edges"))
    return f.select("name", "degree_bad", "degree_good", "break_no_lower", "break_no_upper", "break_no", r6("attribute_sim"))


@register(
    "pairs_missing_from_graph",
    SQL_PAIRS
    + """ SELECT name, good_attribute, bad_attribute,
          CASE WHEN bad_attribute NOT IN (SELECT attribute FROM nodes) AND good_attribute NOT IN (SELECT attribute FROM nodes)
               THEN 'both missing'
               WHEN bad_attribute NOT IN (SELECT attribute FROM nodes) THEN 'bad attribute missing'
               ELSE 'good attribute missing' END AS reason
          FROM pairs WHERE name NOT IN (SELECT name FROM gp)""",
)
def q_pairs_missing_from_graph(spark, sf_dir):
    s = baskets_pairs(spark, sf_dir)
    p = s["pairs"].select("name", "good_attribute", "bad_attribute")
    return C.pairs_missing_from_graph(p, s["edges"])
