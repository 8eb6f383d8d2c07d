"""Registered queries: one Spark DataFrame builder per operator, plus the
equivalent DuckDB SQL used as the correctness oracle.

Every query reads the driver's tables at ``sf_dir`` in full. Doubles that are
sums of floats are rounded to 6 places on both sides, since summation order
differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.operators import recommend as R
from attrmill.operators import stats as B
from attrmill.session import written
from attrmill.sources import adapters as A

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    # Each module registers its queries on import.
    import importlib

    for mod in _MODULES:
        importlib.import_module(mod)


_MODULES: list[str] = ["attrmill.catalog_lexical", "attrmill.catalog_features", "attrmill.catalog_values", "attrmill.catalog_queue", "attrmill.catalog_samples", "attrmill.catalog_styles", "attrmill.catalog_stores"]


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --------------------------------------------------------------------------------------
# Adapter views in SQL (same definitions as attrmill.sources.adapters)

SQL_BASKETS = """
baskets AS (
  SELECT l.l_orderkey AS sample_id, p.p_name AS attribute,
         CAST(min([CAST(l.l_linenumber AS DOUBLE), l.l_quantity])[2] AS VARCHAR) AS value
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey, p.p_name)"""

SQL_USER_EVENTS = """
user_events AS (
  SELECT user_id AS sample_id, event_type AS attribute,
         CAST(arg_min(value, (ts, event_id)) AS VARCHAR) AS value
  FROM events GROUP BY user_id, event_type)"""

SQL_ATTRS = """
attrs AS (SELECT attribute, count(*) AS frequency FROM baskets GROUP BY attribute)"""

SQL_COEXIST = """
coexist AS (
  SELECT a.attribute AS attribute1, b.attribute AS attribute2, count(*) AS totals
  FROM baskets a JOIN baskets b ON a.sample_id = b.sample_id AND a.attribute < b.attribute
  GROUP BY 1, 2)"""

SQL_NSAMPLES = """
nsamples AS (SELECT CAST(count(DISTINCT sample_id) AS DOUBLE) AS n FROM baskets)"""

SQL_EDGES_RAW = """
edges_raw AS (
  SELECT c.attribute1, c.attribute2, c.totals,
         (a1.frequency / ns.n) * (a2.frequency / ns.n) * ns.n AS exp
  FROM coexist c JOIN attrs a1 ON c.attribute1 = a1.attribute
                 JOIN attrs a2 ON c.attribute2 = a2.attribute, nsamples ns),
weights AS (
  SELECT attribute1, attribute2, totals, exp, totals - exp AS diff,
         (totals - exp) / (SELECT sum(totals - exp) FROM edges_raw) AS weight
  FROM edges_raw)"""

SQL_SYM = """
sym AS (
  SELECT attribute1 AS src, attribute2 AS dst, totals, weight FROM weights
  UNION ALL
  SELECT attribute2 AS src, attribute1 AS dst, totals, weight FROM weights)"""

SQL_STATS = "WITH " + ",".join([SQL_BASKETS, SQL_ATTRS, SQL_COEXIST, SQL_NSAMPLES, SQL_EDGES_RAW, SQL_SYM])


# --------------------------------------------------------------------------------------
# Cached per-session building blocks (lazy DataFrames; cheap to rebuild)


def baskets_stats(spark: SparkSession, sf_dir: str, kept: tuple[str, ...] = ()) -> dict:
    """The tables of the baskets; those named in ``kept`` (sample_attr, coexist), which a query with
    several jobs reads again and again, are written once."""
    sa = A.baskets(spark, sf_dir)
    if "sample_attr" in kept:
        sa = written(sa, "baskets")
    attributes = B.attribute_frequency(sa)
    coexist = B.cooccurrence(sa)
    if "coexist" in kept:
        coexist = written(coexist, "coexist")
    n = B.sample_total(sa)
    weights = B.cooccurrence_weights(coexist, attributes, n)
    return {
        "sample_attr": sa,
        "attributes": attributes,
        "coexist": coexist,
        "n": n,
        "weights": weights,
        "edges": B.symmetric_edges(weights),
    }


# ---- B: statistics ----------------------------------------------------------------------


@register("attribute_frequency", "WITH " + SQL_BASKETS + ", " + SQL_ATTRS + " SELECT attribute, frequency FROM attrs")
def q_attribute_frequency(spark, sf_dir):
    return B.attribute_frequency(A.baskets(spark, sf_dir))


@register(
    "value_counts",
    "WITH " + SQL_BASKETS + " SELECT attribute, value, count(*) AS n FROM baskets GROUP BY attribute, value",
)
def q_value_counts(spark, sf_dir):
    return B.value_counts(A.baskets(spark, sf_dir))


@register(
    "merge_partial_value_counts",
    "WITH " + SQL_BASKETS + "," + SQL_USER_EVENTS + """
     SELECT attribute, value, CAST(sum(n) AS BIGINT) AS n FROM (
       SELECT attribute, value, count(*) AS n FROM baskets GROUP BY 1, 2
       UNION ALL
       SELECT attribute, value, count(*) AS n FROM user_events GROUP BY 1, 2) GROUP BY 1, 2""",
)
def q_merge_partial_value_counts(spark, sf_dir):
    return B.merge_partial_value_counts(
        B.value_counts(A.baskets(spark, sf_dir)), B.value_counts(A.user_events(spark, sf_dir))
    )


@register("cooccurrence", "WITH " + SQL_BASKETS + "," + SQL_COEXIST + " SELECT * FROM coexist")
def q_cooccurrence(spark, sf_dir):
    return B.cooccurrence(A.baskets(spark, sf_dir))


@register(
    "merge_partial_cooccurrence",
    "WITH " + SQL_BASKETS + "," + SQL_USER_EVENTS + "," + SQL_COEXIST + """,
     ue AS (SELECT a.attribute AS attribute1, b.attribute AS attribute2, count(*) AS totals
            FROM user_events a JOIN user_events b ON a.sample_id = b.sample_id AND a.attribute < b.attribute
            GROUP BY 1, 2)
     SELECT least(attribute1, attribute2) AS attribute1, greatest(attribute1, attribute2) AS attribute2,
            CAST(sum(totals) AS BIGINT) AS totals
     FROM (SELECT * FROM coexist UNION ALL SELECT attribute2, attribute1, totals FROM ue) GROUP BY 1, 2""",
)
def q_merge_partial_cooccurrence(spark, sf_dir):
    ue = B.cooccurrence(A.user_events(spark, sf_dir))
    # The second part arrives in reversed orientation, as a worker might write it.
    ue_rev = ue.select(F.col("attribute2").alias("attribute1"), F.col("attribute1").alias("attribute2"), "totals")
    return B.merge_partial_cooccurrence(B.cooccurrence(A.baskets(spark, sf_dir)), ue_rev)


@register(
    "sample_total",
    "WITH " + SQL_BASKETS + " SELECT count(DISTINCT sample_id) AS n_samples FROM baskets",
)
def q_sample_total(spark, sf_dir):
    return B.sample_total(A.baskets(spark, sf_dir))


@register(
    "cooccurrence_weights",
    SQL_STATS
    + """ SELECT attribute1, attribute2, totals, round(exp, 6) AS exp, round(diff, 6) AS diff,
                 round(weight, 6) AS weight FROM weights""",
)
def q_cooccurrence_weights(spark, sf_dir):
    w = baskets_stats(spark, sf_dir)["weights"]
    return w.select("attribute1", "attribute2", "totals", r6("exp"), r6("diff"), r6("weight"))


@register(
    "dropped_pairs",
    SQL_STATS
    + """ SELECT c.attribute1, c.attribute2, c.totals FROM coexist c
          WHERE NOT EXISTS (SELECT 1 FROM weights w WHERE w.attribute1 = c.attribute1 AND w.attribute2 = c.attribute2)""",
)
def q_dropped_pairs(spark, sf_dir):
    s = baskets_stats(spark, sf_dir)
    return B.dropped_pairs(s["coexist"], s["weights"])


@register(
    "symmetric_edges",
    SQL_STATS + " SELECT src, dst, totals, round(weight, 6) AS weight FROM sym",
)
def q_symmetric_edges(spark, sf_dir):
    e = baskets_stats(spark, sf_dir)["edges"]
    return e.select("src", "dst", "totals", r6("weight"))


# ---- R: recommendation ----------------------------------------------------------------

SQL_GIVEN_TOP3 = """
given AS (SELECT attribute FROM attrs ORDER BY frequency DESC, attribute LIMIT 3)"""


def _sql_recommend(n: int) -> str:
    return (
        SQL_STATS
        + ","
        + SQL_GIVEN_TOP3
        + f""",
     near AS (
       SELECT dst AS attribute, sum(weight) AS total_weight FROM sym
       WHERE src IN (SELECT attribute FROM given) AND dst NOT IN (SELECT attribute FROM given)
       GROUP BY dst),
     top AS (SELECT attribute, total_weight,
                    row_number() OVER (ORDER BY round(total_weight, 9) DESC, attribute) AS rank
             FROM near)
     SELECT attribute, round(total_weight, 6) AS total_weight, CAST(rank AS INTEGER) AS rank
     FROM top WHERE rank <= {n}"""
    )


def _given_top3(attributes: DataFrame) -> DataFrame:
    # The three most used attributes stand for a curator's list (top-k is the feature).
    return attributes.orderBy(F.col("frequency").desc(), F.col("attribute")).limit(3).select("attribute")


@register("recommend_5", _sql_recommend(5))
def q_recommend_5(spark, sf_dir):
    s = baskets_stats(spark, sf_dir)
    out = R.recommend(s["edges"], _given_top3(s["attributes"]), n=5)
    return out.select("attribute", r6("total_weight"), F.col("rank").cast("int"))


@register("recommend_500", _sql_recommend(500))
def q_recommend_500(spark, sf_dir):
    s = baskets_stats(spark, sf_dir)
    out = R.recommend(s["edges"], _given_top3(s["attributes"]), n=500)
    return out.select("attribute", r6("total_weight"), F.col("rank").cast("int"))


@register(
    "known_attributes",
    "WITH " + SQL_BASKETS + " SELECT DISTINCT attribute FROM baskets",
)
def q_known_attributes(spark, sf_dir):
    return R.known_attributes(B.attribute_frequency(A.baskets(spark, sf_dir)))


@register(
    "batch_recommend",
    SQL_STATS
    + """,
     own AS (SELECT DISTINCT sample_id, attribute FROM baskets),
     cand AS (
       SELECT o.sample_id, s.dst AS attribute, sum(s.weight) AS total_weight
       FROM own o JOIN sym s ON o.attribute = s.src
       WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.sample_id = o.sample_id AND x.attribute = s.dst)
       GROUP BY 1, 2),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id
                       ORDER BY round(total_weight, 9) DESC, attribute) AS rank FROM cand)
     SELECT sample_id, attribute, round(total_weight, 6) AS total_weight, CAST(rank AS INTEGER) AS rank
     FROM ranked WHERE rank <= 5""",
)
def q_batch_recommend(spark, sf_dir):
    s = baskets_stats(spark, sf_dir, kept=("sample_attr", "coexist"))
    out = R.batch_recommend(s["sample_attr"], s["edges"], n=5)
    return out.select("sample_id", "attribute", r6("total_weight"), F.col("rank").cast("int"))
