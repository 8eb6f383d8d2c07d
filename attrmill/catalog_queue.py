"""Registered queries for the curation queue and the decision log (Q*).

Pair spine: the column pairs of `catalog_values`, numbered 0..104 in name order
(the decision adapter refers to pairs by that number), with good/bad polarity and
frequencies from the value profile. Queues ordered by pseudo confidence use the
lexical diagnosis of the two names (Spark only: stems have no SQL twin).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attrmill.catalog import register
from attrmill.catalog_values import COLUMN_PAIRS, _sql_str, sql_column_values, sql_typed
from attrmill.operators import lexical as L
from attrmill.operators import queue as Q
from attrmill.operators import stats as B
from attrmill.operators import values as V
from attrmill.sources import adapters as A


def pair_spine(spark: SparkSession, sf_dir: str, with_confidence: bool = False):
    vals = A.column_values(spark, sf_dir)
    prof = V.value_type_profile(vals).select("attribute", "total_freq")
    fixed = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(COLUMN_PAIRS)], "pair_no bigint, attribute1 string, attribute2 string")
    f1 = prof.select(F.col("attribute").alias("attribute1"), F.col("total_freq").alias("f1"))
    f2 = prof.select(F.col("attribute").alias("attribute2"), F.col("total_freq").alias("f2"))
    p = fixed.join(f1, "attribute1").join(f2, "attribute2")
    first_good = F.col("f1") > F.col("f2")
    spine = p.select(
        "pair_no",
        "attribute1",
        "attribute2",
        F.concat_ws(" § ", "attribute1", "attribute2").alias("name"),
        F.when(first_good, F.col("attribute1")).otherwise(F.col("attribute2")).alias("good_attribute"),
        F.when(first_good, F.col("attribute2")).otherwise(F.col("attribute1")).alias("bad_attribute"),
        F.when(first_good, F.col("f1")).otherwise(F.col("f2")).alias("good_freq"),
        F.when(first_good, F.col("f2")).otherwise(F.col("f1")).alias("bad_freq"),
    )
    if with_confidence:
        from attrmill.functions import text as X

        dic = L.dictionary_from_tokens(A.tokens(spark, sf_dir))
        lex = spine.select("attribute1", "attribute2", X.fuzzy_ratio(F.col("attribute1"), F.col("attribute2")).alias("levenshtein"))
        attrs = prof.select("attribute", F.col("total_freq").alias("frequency"))
        diag = L.diagnose(lex, attrs, dic).select("name", "pseudo_confidence")
        spine = spine.join(diag, "name")
    return spine


def decisions(spark, sf_dir):
    return A.decisions(spark, sf_dir)


SQL_SPINE = (
    "WITH "
    + sql_column_values()
    + ","
    + sql_typed("colvals")
    + ",\ncpairs AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {_sql_str(a)}, {_sql_str(b)})" for i, (a, b) in enumerate(COLUMN_PAIRS))
    + """) t(pair_no, attribute1, attribute2)),
spine AS (
  SELECT CAST(c.pair_no AS BIGINT) AS pair_no, c.attribute1 || ' § ' || c.attribute2 AS name,
         CASE WHEN f1.total_freq > f2.total_freq THEN c.attribute1 ELSE c.attribute2 END AS good_attribute,
         CASE WHEN f1.total_freq > f2.total_freq THEN c.attribute2 ELSE c.attribute1 END AS bad_attribute,
         CASE WHEN f1.total_freq > f2.total_freq THEN f1.total_freq ELSE f2.total_freq END AS good_freq,
         CASE WHEN f1.total_freq > f2.total_freq THEN f2.total_freq ELSE f1.total_freq END AS bad_freq
  FROM cpairs c JOIN prof f1 ON c.attribute1 = f1.attribute JOIN prof f2 ON c.attribute2 = f2.attribute),
dec AS (
  SELECT CAST(user_id AS VARCHAR) AS username, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pair_no,
         CASE event_type WHEN 'purchase' THEN 'SUGGESTED_MERGE' WHEN 'signup' THEN 'SUGGESTED_NOMERGE'
                         WHEN 'click' THEN 'SUGGESTED_REVERSEMERGE' WHEN 'view' THEN 'SKIPPED' END AS decision, ts
  FROM events WHERE event_type <> 'error'),
und AS (SELECT * FROM spine WHERE pair_no NOT IN (SELECT pair_no FROM dec WHERE pair_no IS NOT NULL)),
top3 AS (SELECT attribute FROM prof ORDER BY total_freq DESC, attribute LIMIT 3)"""
)

SPINE_COLS = ["pair_no", "name", "good_attribute", "bad_attribute", "good_freq", "bad_freq"]


@register("undecided_pairs", SQL_SPINE + " SELECT pair_no, name, good_attribute, bad_attribute, good_freq, bad_freq FROM und")
def q_undecided(spark, sf_dir):
    return Q.undecided(pair_spine(spark, sf_dir), decisions(spark, sf_dir)).select(*SPINE_COLS)


def _sql_queue(expr: str, prefix: str | None = None) -> str:
    where = f"WHERE NOT starts_with(good_attribute, '{prefix}') AND NOT starts_with(bad_attribute, '{prefix}')" if prefix else ""
    return (
        SQL_SPINE
        + f""" SELECT pair_no, name, m, CAST(rank AS INTEGER) AS rank FROM (
          SELECT pair_no, name, {expr} AS m, row_number() OVER (ORDER BY {expr} DESC, name) AS rank FROM und {where})
          WHERE rank <= 200"""
    )


@register("queue_max", _sql_queue("least(bad_freq, good_freq)"))
def q_queue_max(spark, sf_dir):
    return Q.queue_max(pair_spine(spark, sf_dir), decisions(spark, sf_dir)).select("pair_no", "name", "m", F.col("rank").cast("int"))


@register("queue_major", _sql_queue("greatest(bad_freq, good_freq)"))
def q_queue_major(spark, sf_dir):
    return Q.queue_major(pair_spine(spark, sf_dir), decisions(spark, sf_dir)).select("pair_no", "name", "m", F.col("rank").cast("int"))


@register("queue_major_omit_prefix", _sql_queue("greatest(bad_freq, good_freq)", prefix="part."))
def q_queue_major_omit(spark, sf_dir):
    out = Q.queue_major(pair_spine(spark, sf_dir), decisions(spark, sf_dir), prefix="part.")
    return out.select("pair_no", "name", "m", F.col("rank").cast("int"))


@register("queue_smart")
def q_queue_smart(spark, sf_dir):
    out = Q.queue_smart(pair_spine(spark, sf_dir, with_confidence=True), decisions(spark, sf_dir))
    return out.select("pair_no", "name", "pseudo_confidence", F.col("rank").cast("int"))


def _top3(spark, sf_dir):
    prof = V.value_type_profile(A.column_values(spark, sf_dir))
    return prof.orderBy(F.col("total_freq").desc(), F.col("attribute")).limit(3).select("attribute")


@register("queue_my_attributes")
def q_queue_my_attributes(spark, sf_dir):
    out = Q.queue_my_attributes(pair_spine(spark, sf_dir, with_confidence=True), decisions(spark, sf_dir), _top3(spark, sf_dir))
    return out.select("pair_no", "name", "pseudo_confidence", F.col("rank").cast("int"))


@register(
    "pairs_left",
    SQL_SPINE
    + """, sides AS (SELECT DISTINCT pair_no, good_attribute AS attribute FROM und
                     UNION SELECT DISTINCT pair_no, bad_attribute AS attribute FROM und)
     SELECT t.attribute, count(s.pair_no) AS pairs_left FROM top3 t LEFT JOIN sides s ON t.attribute = s.attribute
     GROUP BY t.attribute""",
)
def q_pairs_left(spark, sf_dir):
    return Q.pairs_left(pair_spine(spark, sf_dir), decisions(spark, sf_dir), _top3(spark, sf_dir))


@register(
    "previous_attributes",
    SQL_SPINE
    + """ SELECT DISTINCT d.username,
            CASE WHEN d.decision = 'SUGGESTED_MERGE' THEN s.bad_attribute ELSE s.good_attribute END AS attribute
          FROM dec d JOIN spine s ON d.pair_no = s.pair_no
          WHERE d.decision IN ('SUGGESTED_MERGE', 'SUGGESTED_REVERSEMERGE')""",
)
def q_previous_attributes(spark, sf_dir):
    return Q.previous_attributes(pair_spine(spark, sf_dir), decisions(spark, sf_dir), good=False)


@register("queue_dynamic")
def q_queue_dynamic(spark, sf_dir):
    """Q9 for the curator with the most decisions (a top-1 pick; the limit is the feature)."""
    d = decisions(spark, sf_dir)
    top_user = d.groupBy("username").count().orderBy(F.col("count").desc(), F.col("username")).first()["username"]
    out = Q.queue_dynamic(pair_spine(spark, sf_dir, with_confidence=True), d, _top3(spark, sf_dir), top_user)
    return out.select("pair_no", "name", "pseudo_confidence", F.col("rank").cast("int"))


@register(
    "last_decision",
    SQL_SPINE
    + """ SELECT username, pair_no, arg_max(decision, ts) AS decision, max(ts) AS ts,
            CASE arg_max(decision, ts) WHEN 'SKIPPED' THEN 'Skip' WHEN 'SUGGESTED_MERGE' THEN 'Merge'
                 WHEN 'SUGGESTED_NOMERGE' THEN 'Don''t merge' WHEN 'SUGGESTED_REVERSEMERGE' THEN 'Merge reverse' END AS last_decision
          FROM dec GROUP BY username, pair_no""",
)
def q_last_decision(spark, sf_dir):
    return Q.last_decision(decisions(spark, sf_dir))


@register(
    "profile_stats",
    SQL_SPINE
    + """ SELECT username,
            count_if(decision IN ('SUGGESTED_MERGE', 'SUGGESTED_NOMERGE', 'SUGGESTED_REVERSEMERGE')) AS all_curated,
            count_if(decision = 'SUGGESTED_MERGE') AS merges, count_if(decision = 'SUGGESTED_NOMERGE') AS no_merges,
            count_if(decision = 'SUGGESTED_REVERSEMERGE') AS reverse_merges
          FROM dec GROUP BY username""",
)
def q_profile_stats(spark, sf_dir):
    return Q.profile_stats(decisions(spark, sf_dir))


@register(
    "wipe_decisions",
    SQL_SPINE
    + """, busiest AS (SELECT username FROM dec GROUP BY username ORDER BY count(*) DESC, username LIMIT 1)
          SELECT * FROM dec WHERE username NOT IN (SELECT username FROM busiest)""",
)
def q_wipe_decisions(spark, sf_dir):
    """Q15: the log without the busiest curator's decisions."""
    d = decisions(spark, sf_dir)
    busiest = d.groupBy("username").count().orderBy(F.col("count").desc(), F.col("username")).limit(1)
    return Q.wipe_decisions(d, busiest)


@register(
    "overview_counts",
    SQL_SPINE.replace("WITH ", "WITH ", 1)
    + """, bs AS (SELECT DISTINCT l_orderkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
          SELECT (SELECT count(*) FROM spine) AS pairs, (SELECT count(*) FROM bs) AS samples""",
)
def q_overview_counts(spark, sf_dir):
    return Q.overview_counts(pair_spine(spark, sf_dir), A.baskets(spark, sf_dir))


@register(
    "decision_totals_by_type",
    SQL_SPINE + " SELECT decision, count(*) AS n, count(DISTINCT username) AS curators FROM dec GROUP BY decision",
)
def q_decision_totals(spark, sf_dir):
    """The decision log summarised per decision type (input to Q17-style progress reports)."""
    d = decisions(spark, sf_dir)
    return d.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("username").alias("curators"))
