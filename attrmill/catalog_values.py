"""Registered queries for value comparison (V*).

Attributes are the chosen columns of the driver tables (adapter `column_values`);
the pairs compared are all pairs of those columns, a fixed list derived from the
adapter's column list by rule.
"""

from __future__ import annotations

import itertools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attrmill.catalog import SQL_BASKETS, r6, register
from attrmill.operators import values as V
from attrmill.session import cut_lineage
from attrmill.sources import adapters as A

COLUMN_ATTRIBUTES = sorted(f"{t}.{c}" for t, c, _ in A.COLUMN_VALUE_SOURCES)
COLUMN_PAIRS = list(itertools.combinations(COLUMN_ATTRIBUTES, 2))


def sql_column_values() -> str:
    parts = []
    for table, col, kind in A.COLUMN_VALUE_SOURCES:
        if kind == "number":
            txt = f"CAST(CAST({col} AS DECIMAL(18,2)) AS VARCHAR)"
        elif kind == "date":
            txt = f"strftime({col}, '%Y-%m-%d')"
        else:
            txt = col
        parts.append(
            f"SELECT '{table}.{col}' AS attribute, {txt} AS value, count(*) AS n FROM {table} "
            f"WHERE {col} IS NOT NULL GROUP BY 2"
        )
    return "colvals AS (" + " UNION ALL ".join(parts) + ")"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Date formats of the SQL twin, in the terms of its own parser.
SQL_DATE_FORMATS = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y-%m", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%d-%b-%Y",
    "%B %d, %Y", "%b %d, %Y", "%B %Y", "%b %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ",
]


def sql_typed(src: str) -> str:
    formats = ", ".join(_sql_str(f) for f in SQL_DATE_FORMATS)
    return f"""
numbered AS (SELECT *, coalesce(TRY_CAST(value AS DOUBLE), TRY_CAST(replace(value, ',', '.') AS DOUBLE)) AS num FROM {src}),
typed AS (
  SELECT attribute, value, n, num,
         CASE WHEN num IS NOT NULL THEN 'numeric'
              WHEN try_strptime(value, [{formats}]) IS NOT NULL THEN 'date' ELSE 'string' END AS vt
  FROM numbered),
prof AS (
  SELECT attribute,
         CAST(sum(CASE WHEN vt = 'numeric' THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric,
         CAST(sum(CASE WHEN vt = 'string' THEN 1 ELSE 0 END) AS BIGINT) AS n_string,
         CAST(sum(CASE WHEN vt = 'date' THEN 1 ELSE 0 END) AS BIGINT) AS n_date,
         count(*) AS no_unique_values, CAST(sum(n) AS BIGINT) AS total_freq,
         avg(CASE WHEN vt = 'numeric' AND NOT isnan(num) THEN num END) AS numeric_mean,
         first(value ORDER BY n DESC, value) AS top_value
  FROM typed GROUP BY attribute),
profr AS (SELECT *, n_numeric / no_unique_values AS ratio_numeric, n_string / no_unique_values AS ratio_string,
                 n_date / no_unique_values AS ratio_date FROM prof)"""


def sql_pairs_fixed() -> str:
    rows = ", ".join(f"({_sql_str(a)}, {_sql_str(b)})" for a, b in COLUMN_PAIRS)
    return f"""
cpairs AS (SELECT * FROM (VALUES {rows}) t(attribute1, attribute2)),
vpairs AS (
  SELECT c.attribute1 || ' § ' || c.attribute2 AS name,
         CASE WHEN f1.total_freq > f2.total_freq THEN c.attribute1 ELSE c.attribute2 END AS good_attribute,
         CASE WHEN f1.total_freq > f2.total_freq THEN c.attribute2 ELSE c.attribute1 END AS bad_attribute
  FROM cpairs c JOIN prof f1 ON c.attribute1 = f1.attribute JOIN prof f2 ON c.attribute2 = f2.attribute)"""


def _mixed_sql(t: str) -> str:
    return (
        f"(g.ratio_{t} > 0.25 AND b.ratio_{t} > 0.25 AND b.ratio_{t} > g.ratio_{t} * 0.95 "
        f"AND b.ratio_{t} < g.ratio_{t} * 1.05)"
    )


SQL_FEATURES = f"""
vf AS (
  SELECT p.name, p.good_attribute, p.bad_attribute, g.no_unique_values AS u_g, b.no_unique_values AS u_b,
         g.total_freq AS f_g, b.total_freq AS f_b, g.numeric_mean + 1e-9 AS m1, b.numeric_mean + 1e-9 AS m2,
         CASE WHEN g.ratio_numeric > 0.9 AND b.ratio_numeric > 0.9 THEN 'numeric match'
              WHEN g.ratio_string > 0.9 AND b.ratio_string > 0.9 THEN 'strings match'
              WHEN g.ratio_date > 0.9 AND b.ratio_date > 0.9 THEN 'date match'
              WHEN {_mixed_sql('string')} AND {_mixed_sql('numeric')} AND {_mixed_sql('date')} THEN 'mixed string, numeric and date match'
              WHEN {_mixed_sql('string')} AND {_mixed_sql('numeric')} THEN 'mixed string and numeric match'
              WHEN {_mixed_sql('string')} AND {_mixed_sql('date')} THEN 'mixed string and date match'
              WHEN {_mixed_sql('numeric')} AND {_mixed_sql('date')} THEN 'mixed numeric and date match'
              WHEN {_mixed_sql('string')} THEN 'mixed match string'
              WHEN {_mixed_sql('numeric')} THEN 'mixed match numeric'
              WHEN {_mixed_sql('date')} THEN 'mixed match date'
              ELSE 'no match' END AS type_match
  FROM vpairs p JOIN profr g ON p.good_attribute = g.attribute JOIN profr b ON p.bad_attribute = b.attribute),
shared AS (
  SELECT p.name, count(*) AS n_shared, sum(x.n + y.n) AS shared_freq
  FROM vpairs p JOIN vals x ON x.attribute = p.good_attribute
                JOIN vals y ON y.attribute = p.bad_attribute AND x.value = y.value
  GROUP BY p.name),
mag AS (
  SELECT *, m1 <> 0 AND m2 <> 0 AND isfinite(m1) AND isfinite(m2) AS ok,
         CAST(floor(log10(abs(m1))) AS INTEGER) AS g1, CAST(floor(log10(abs(m2))) AS INTEGER) AS g2
  FROM vf)
SELECT m.name, m.good_attribute, m.bad_attribute, m.type_match,
       round((coalesce(s.n_shared, 0) * 2.0 / (u_g + u_b)) * (coalesce(s.shared_freq, 0) / (f_g + f_b)), 6) AS exact_score,
       CASE WHEN type_match = 'numeric match' AND ok THEN g1 = g2 END AS roughly_equivalent,
       CASE WHEN type_match = 'numeric match' AND ok AND g1 <> g2 THEN
            CASE WHEN (m1 >= 0) = (m2 >= 0) THEN abs(g1 - g2) ELSE abs(g1 + g2) END END AS magnitude_difference
FROM mag m LEFT JOIN shared s ON m.name = s.name"""


def column_pairs(spark: SparkSession, prof):
    fixed = spark.createDataFrame(COLUMN_PAIRS, "attribute1 string, attribute2 string")
    f1 = prof.select(F.col("attribute").alias("attribute1"), F.col("total_freq").alias("f1"))
    f2 = prof.select(F.col("attribute").alias("attribute2"), F.col("total_freq").alias("f2"))
    p = fixed.join(f1, "attribute1").join(f2, "attribute2")
    first_good = F.col("f1") > F.col("f2")
    return p.select(
        F.concat_ws(" § ", "attribute1", "attribute2").alias("name"),
        F.when(first_good, F.col("attribute1")).otherwise(F.col("attribute2")).alias("good_attribute"),
        F.when(first_good, F.col("attribute2")).otherwise(F.col("attribute1")).alias("bad_attribute"),
    )


SQL_PROFILE_COLS = """attribute, n_numeric, n_string, n_date, no_unique_values, total_freq,
       round(ratio_numeric, 6) AS ratio_numeric, round(ratio_string, 6) AS ratio_string,
       round(ratio_date, 6) AS ratio_date, round(numeric_mean, 6) AS numeric_mean, top_value"""


@register(
    "value_type_profile",
    "WITH " + sql_column_values() + "," + sql_typed("colvals") + " SELECT " + SQL_PROFILE_COLS + " FROM profr",
)
def q_value_type_profile(spark, sf_dir):
    p = V.value_type_profile(A.column_values(spark, sf_dir))
    return p.select(
        "attribute", "n_numeric", "n_string", "n_date", "no_unique_values", "total_freq",
        r6("ratio_numeric"), r6("ratio_string"), r6("ratio_date"), r6("numeric_mean"), "top_value",
    )


def _features_out(f, *more):
    return f.select(
        "name", "good_attribute", "bad_attribute", "type_match", r6("exact_score"),
        "roughly_equivalent", "magnitude_difference", *more,
    )


SQL_BASKET_VALUES = "bvals AS (SELECT attribute, value, count(*) AS n FROM baskets GROUP BY 1, 2)"


def _sql_value_features_baskets() -> str:
    from attrmill.catalog_lexical import SQL_SIMILAR_BASKETS

    return (
        SQL_SIMILAR_BASKETS
        + ","
        + SQL_BASKET_VALUES
        + ", vals AS (SELECT * FROM bvals),"
        + sql_typed("bvals")
        + """,
battrs AS (SELECT attribute, count(*) AS frequency FROM baskets GROUP BY 1),
vpairs AS (
  SELECT s.attribute1 || ' § ' || s.attribute2 AS name,
         CASE WHEN f1.frequency > f2.frequency THEN s.attribute1 ELSE s.attribute2 END AS good_attribute,
         CASE WHEN f1.frequency > f2.frequency THEN s.attribute2 ELSE s.attribute1 END AS bad_attribute
  FROM sim s JOIN battrs f1 ON s.attribute1 = f1.attribute JOIN battrs f2 ON s.attribute2 = f2.attribute),"""
        + SQL_FEATURES
    )


@register("value_features_baskets", _sql_value_features_baskets())
def q_value_features_baskets(spark, sf_dir):
    from attrmill.catalog_features import baskets_pairs
    from attrmill.operators import stats as B

    s = baskets_pairs(spark, sf_dir)
    vals = B.value_counts(s["sample_attr"])
    return _features_out(V.value_features(s["pairs"], vals, fuzzy=False))


def _sql_hamming(a: str, b: str) -> str:
    return (
        f"(CAST(coalesce(list_sum([CASE WHEN substr({a}, i::BIGINT, 1) <> substr({b}, i::BIGINT, 1) THEN 1 ELSE 0 END "
        f"for i in range(1, least(length({a}), length({b})) + 1)]), 0) AS BIGINT) + abs(length({a}) - length({b})))"
    )


SQL_FUZZY = f"""
capped AS (SELECT attribute, value FROM colvals),
need AS (SELECT name, good_attribute, bad_attribute FROM vf
         WHERE type_match NOT IN ('numeric match', 'date match')),
sizes AS (SELECT n.name, n.good_attribute, n.bad_attribute,
                 (SELECT count(*) FROM capped c WHERE c.attribute = n.good_attribute) AS s1,
                 (SELECT count(*) FROM capped c WHERE c.attribute = n.bad_attribute) AS s2 FROM need n),
roles AS (SELECT name, CASE WHEN s1 > s2 THEN bad_attribute ELSE good_attribute END AS short_attr,
                       CASE WHEN s1 > s2 THEN good_attribute ELSE bad_attribute END AS long_attr FROM sizes),
combos AS (SELECT r.name, a.value AS v, b.value AS w, jaro_winkler_similarity(a.value, b.value) AS jw
           FROM roles r JOIN capped a ON a.attribute = r.short_attr JOIN capped b ON b.attribute = r.long_attr),
best AS (SELECT name, v, m.w AS w, -m.s AS jw FROM (
         SELECT name, v, min({{'s': CASE WHEN v = w THEN -1.0 ELSE -jw END, 'w': w}}) AS m FROM combos GROUP BY name, v)),
scored AS (SELECT name, jw, CAST(damerau_levenshtein(v, w) AS DOUBLE) AS dl, CAST({_sql_hamming('v', 'w')} AS DOUBLE) AS hm FROM best)
SELECT name,
  round(avg(jw), 6) AS jaro_mean, round(stddev_samp(jw), 6) AS jaro_std, round(quantile_cont(jw, 0.9), 6) AS jaro_q90,
  round(avg(dl), 6) AS damerau_levenshtein_mean, round(stddev_samp(dl), 6) AS damerau_levenshtein_std,
  round(quantile_cont(dl, 0.9), 6) AS damerau_levenshtein_q90,
  round(avg(hm), 6) AS hamming_mean, round(stddev_samp(hm), 6) AS hamming_std, round(quantile_cont(hm, 0.9), 6) AS hamming_q90
FROM scored GROUP BY name"""

SQL_FUZZY_CTES, _, SQL_FUZZY_STATS = SQL_FUZZY.rpartition("\nSELECT name,\n")
_SIDES = [f"{x}_{t}" for t in ("numeric", "string", "date") for x in ("n", "ratio")] + ["no_unique_values", "top_value"]


def _sql_feature_rows() -> str:
    """The whole feature row, the value features joined with the fuzzy score and both profiles."""
    ctes, _, features = SQL_FEATURES.partition("\nSELECT m.name")
    cell = lambda c, side: f"round({side}.{c}, 6)" if c.startswith("ratio") else f"{side}.{c}"
    both = [f"{cell(c, s[0])} AS {c}_{s}" for s in ("good", "bad") for c in _SIDES]
    return (
        "WITH " + sql_column_values() + ", vals AS (SELECT * FROM colvals)," + sql_typed("colvals") + "," + sql_pairs_fixed() + "," + ctes + "," + SQL_FUZZY_CTES
        + ",\nfz AS (SELECT name, quantile_cont(jw, 0.9) AS q FROM scored GROUP BY name),\nbase AS (SELECT m.name" + features + ")\n"
        + "SELECT x.*, round(fz.q, 6) AS jaro_score, " + ", ".join(both)
        + " FROM base x JOIN profr g ON x.good_attribute = g.attribute JOIN profr b ON x.bad_attribute = b.attribute LEFT JOIN fz ON fz.name = x.name"
    )


@register("value_feature_rows", _sql_feature_rows())
def q_value_feature_rows(spark, sf_dir):
    vals = cut_lineage(A.column_values(spark, sf_dir))
    f = V.value_features(column_pairs(spark, V.value_type_profile(vals)), vals)
    cell = lambda c: r6(c) if c.startswith(("ratio", "exact")) else F.col(c)
    names = ["name", "good_attribute", "bad_attribute", "type_match", "exact_score", "roughly_equivalent", "magnitude_difference"]
    both = [f"{c}_{s}" for s in ("good", "bad") for c in _SIDES]
    return f.select(*[cell(c) for c in names], r6("jaro_score"), *[cell(c) for c in both])


@register(
    "value_features",
    _sql_feature_rows().partition("SELECT x.*")[0] + "SELECT x.*, round(fz.q, 6) AS jaro_score FROM base x LEFT JOIN fz ON fz.name = x.name",
)
def q_value_features(spark, sf_dir):
    """V14 without the profiles of both sides: type match, exact score, magnitude and fuzzy score of a pair."""
    vals = cut_lineage(A.column_values(spark, sf_dir))
    pairs = column_pairs(spark, V.value_type_profile(vals))
    return _features_out(V.value_features(pairs, vals), r6("jaro_score"))


@register(
    "fuzzy_value_scores",
    "WITH "
    + sql_column_values()
    + ", vals AS (SELECT * FROM colvals),"
    + sql_typed("colvals")
    + ","
    + sql_pairs_fixed()
    + ","
    + SQL_FEATURES.split("\nSELECT m.name")[0]
    + ","
    + SQL_FUZZY,
)
def q_fuzzy_value_scores(spark, sf_dir):
    vals = cut_lineage(A.column_values(spark, sf_dir))
    prof = V.value_type_profile(vals)
    pairs = column_pairs(spark, prof)
    f = V.value_features(pairs, vals, fuzzy=False)
    need = cut_lineage(f.where(~F.col("type_match").isin("numeric match", "date match")).select("name", "good_attribute", "bad_attribute"))
    out = V.best_value_matches_stats(need, vals)
    return out.select("name", *[r6(c) for c in out.columns if c != "name"])


@register(
    "pairs_missing_values",
    "WITH " + sql_column_values() + "," + SQL_BASKETS + """,
     voc AS (SELECT DISTINCT attribute FROM colvals),
     bp AS (SELECT DISTINCT attribute FROM baskets)
     SELECT p.name, p.good_attribute, p.bad_attribute,
            CASE WHEN p.good_attribute NOT IN (SELECT attribute FROM voc) AND p.bad_attribute NOT IN (SELECT attribute FROM voc)
                 THEN 'both have no values'
                 WHEN p.good_attribute NOT IN (SELECT attribute FROM voc) THEN 'good attribute has no values'
                 ELSE 'bad attribute has no values' END AS reason
     FROM (SELECT 'part.p_name' || ' § ' || attribute AS name, attribute AS good_attribute, 'part.p_name' AS bad_attribute FROM bp) p""",
)
def q_pairs_missing_values(spark, sf_dir):
    """Each part name paired with the column `part.p_name`: the part names have no values in
    the column-value table, so every such pair is reported as skipped with its reason."""
    vals = A.column_values(spark, sf_dir)
    names = A.baskets(spark, sf_dir).select("attribute").distinct()
    pairs = names.select(
        F.concat_ws(" § ", F.lit("part.p_name"), F.col("attribute")).alias("name"),
        F.col("attribute").alias("good_attribute"),
        F.lit("part.p_name").alias("bad_attribute"),
    )
    return V.pairs_missing_values(pairs, vals)
