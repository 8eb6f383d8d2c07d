"""Registered queries of sources, sinks, versioned tables, incremental state and run reports.

Each writes what it needs below the checkpoint folder with the library's own sinks, from the
whole given tables, and reads it back through the operator that it is about.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attrmill.catalog import SQL_BASKETS, SQL_COEXIST, SQL_STATS, SQL_USER_EVENTS, baskets_stats, register
from attrmill.operators import coexist as C
from attrmill.operators import queue as Q
from attrmill.operators import recommend as R
from attrmill.operators import samples as S
from attrmill.operators import stats as B
from attrmill.session import table_path, written
from attrmill.sources import adapters as A
from attrmill.sources import readers as RD
from attrmill.sources import sinks
from attrmill.sources.versioned import VersionedTable
from attrmill.streaming import incremental as E


def _new_path(spark, name: str) -> str:
    return table_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---- S: sources and sinks ---------------------------------------------------------------


@register(
    "sample_pages_read",
    "WITH " + SQL_USER_EVENTS + " SELECT CAST(sample_id AS VARCHAR) AS sample_id, attribute, value FROM user_events",
)
def q_sample_pages(spark, sf_dir):
    """Users as landed JSON pages, read and exploded."""
    path = _new_path(spark, "pages")
    sinks.write_sample_pages(A.user_events(spark, sf_dir), path)
    return RD.explode_characteristics(RD.read_samples(spark, path))


#: A part name with quotes, commas and line breaks where it has blanks, in Spark's and DuckDB's SQL.
ODD_NAME = "replace({}, ' ', concat('\", \"', chr(10)))"


@register(
    "incidence_read",
    "WITH " + SQL_BASKETS + f" SELECT CAST(sample_id AS VARCHAR) AS sample_id, {ODD_NAME.format('attribute')} AS attribute FROM baskets",
)
def q_incidence(spark, sf_dir):
    """Orders as ragged CSV records whose names hold quotes, commas and line breaks."""
    path = _new_path(spark, "incidence")
    sinks.write_incidence(A.baskets(spark, sf_dir, gathered=True).withColumn("attribute", F.expr(ODD_NAME.format("attribute"))), path)
    return RD.incidence_long(RD.read_incidence(spark, path)).select("sample_id", "attribute")


@register(
    "nested_value_counts_read",
    "WITH " + SQL_BASKETS + """ SELECT attribute, value, count(*) AS n FROM (
       SELECT attribute || ' "{' AS attribute, value FROM baskets
       UNION ALL SELECT 'order, clerk' AS attribute, o_orderpriority || '\\": {' || CAST(o_custkey AS VARCHAR) AS value FROM orders)
     GROUP BY 1, 2""",
)
def q_nested_values(spark, sf_dir):
    """Value counts as nested JSON with quotes, commas, braces and backslashes in names and values."""
    named = A.baskets(spark, sf_dir).select(F.concat("attribute", F.lit(' "{')).alias("attribute"), "value")
    orders = A.read_table(spark, sf_dir, "orders").select(
        F.lit("order, clerk").alias("attribute"), F.concat("o_orderpriority", F.lit('\\": {'), F.col("o_custkey").cast("string")).alias("value")
    )
    path = _new_path(spark, "values")
    sinks.write_value_counts(B.value_counts(named.unionByName(orders)), path)
    return RD.read_value_counts(spark, path)


SQL_LATEST = """
latest AS (SELECT user_id AS sample_id, event_type AS attribute, count(*) AS seen,
                  CAST(arg_max(value, (ts, event_id)) AS VARCHAR) AS value
           FROM events GROUP BY user_id, event_type HAVING count(*) > 1)"""


def _latest_events(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    last = F.max(F.struct("ts", "event_id", "value")).getField("value").cast("string")
    seen = ev.groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("attribute")).agg(F.count(F.lit(1)).alias("seen"), last.alias("value"))
    return seen.where("seen > 1")


@register(
    "upserted_samples",
    "WITH " + SQL_USER_EVENTS + "," + SQL_LATEST + """
     SELECT sample_id, attribute, coalesce(l.value, u.value) AS value, coalesce(l.seen, 1) AS seen
     FROM user_events u LEFT JOIN latest l USING (sample_id, attribute)""",
)
def q_upserted(spark, sf_dir):
    """A versioned table of first values takes the latest ones, with every key sent twice
    (the row with the smaller count must lose), and then once more."""
    table = VersionedTable(spark, _new_path(spark, "upserts"))
    table.create(A.user_events(spark, sf_dir).withColumn("seen", F.lit(1).cast("bigint")), ["sample_id"], buckets=16)
    late = _latest_events(spark, sf_dir).select("sample_id", "attribute", "value", "seen")
    sent = late.unionByName(late.withColumn("value", F.lit("stale")).withColumn("seen", F.lit(0).cast("bigint")))
    key = ["sample_id", "attribute"]
    table.upsert(sent, key, ["seen"])
    table.upsert(sent, key, ["seen"])
    table.vacuum()
    return table.read()


@register(
    "cluster_membership_rewritten",
    """SELECT p_brand AS name, CAST(CASE WHEN p_brand LIKE '%1' THEN p_size % 3 ELSE p_size % 5 END AS INTEGER) AS cluster_no,
              CAST(p_partkey AS VARCHAR) AS sample_id
       FROM part WHERE p_brand NOT LIKE '%2'""",
)
def q_rewritten(spark, sf_dir):
    """Parts grouped by size within their brand; brands that end in 1 are grouped anew, those
    that end in 2 lose their groups, all others stay."""
    part = A.read_table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").cast("string").alias("sample_id")
    )
    grouped = lambda k: part.select("name", (F.col("size") % k).cast("int").alias("cluster_no"), "sample_id")
    table = S.create_cluster_membership(grouped(5), _new_path(spark, "clusters"), buckets=16)
    S.rewrite_cluster_membership(table, grouped(3).where("name LIKE '%1'"), part.where("name LIKE '%1' OR name LIKE '%2'").select("name"))
    return table.read()


# ---- E: incremental state ---------------------------------------------------------------

BATCHES = 3


def _counts_over_batches(spark, sf_dir) -> str:
    """Orders whose part names arrive in three batches, a third of them twice, and one batch twice."""
    store = _new_path(spark, "counts")
    # written once: every batch reads its rows, none makes the baskets again
    rows = written(A.baskets(spark, sf_dir).withColumn("batch", F.pmod(F.xxhash64("sample_id", "attribute"), F.lit(BATCHES))), "batches")
    for k in range(BATCHES):
        batch = rows.where((F.col("batch") == k) | (F.col("batch") == k - 1) & (F.lit(k) == 1)).drop("batch")
        E.merge_counts_batch(batch, k, store)
        E.merge_counts_batch(batch, k, store)
    return store


@register("incremental_cooccurrence", "WITH " + SQL_BASKETS + "," + SQL_COEXIST + " SELECT attribute1, attribute2, totals AS n FROM coexist")
def q_incremental_cooccurrence(spark, sf_dir):
    """B4, B5 as state over batches that split the samples: equal to one batch."""
    return E.read_counts(spark, _counts_over_batches(spark, sf_dir), "coexist")


@register("incremental_value_counts", "WITH " + SQL_BASKETS + " SELECT attribute, value, count(*) AS n FROM baskets GROUP BY attribute, value")
def q_incremental_values(spark, sf_dir):
    """B2, B3 as state over the same batches, with the deltas folded."""
    store = _counts_over_batches(spark, sf_dir)
    E.compact_counts(E.counts_log(spark, store, "bigint"))
    return E.read_counts(spark, store, "values")


SQL_DECISIONS = """WITH dec AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS username, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pair_no,
         CASE event_type WHEN 'purchase' THEN 'SUGGESTED_MERGE' WHEN 'signup' THEN 'SUGGESTED_NOMERGE'
                         WHEN 'click' THEN 'SUGGESTED_REVERSEMERGE' WHEN 'view' THEN 'SKIPPED' END AS decision, ts
  FROM events WHERE event_type <> 'error')"""


@register("decision_log_appended", SQL_DECISIONS + " SELECT * FROM dec")
def q_decision_log(spark, sf_dir):
    """Q11: decisions appended in three batches; each batch is replayed, and the last sends all again."""
    d = A.decisions(spark, sf_dir)
    log = E.decision_log(spark, _new_path(spark, "decisions"), d.schema["ts"].dataType.simpleString())
    for k in range(BATCHES):
        batch = d.where(F.pmod(F.xxhash64("username"), F.lit(BATCHES)) <= k) if k == BATCHES - 1 else d.where(F.pmod(F.xxhash64("username"), F.lit(BATCHES)) == k)
        E.append_decisions_batch(batch, k, log)
        E.append_decisions_batch(batch, k, log)
    return E.read_decisions(log)


# ---- C8, S9, Q8, Q14, Q17, Q18: work and reports over the co-occurring pairs --------------

SQL_PAIRS = """
stored AS (SELECT attribute1, attribute2 FROM coexist WHERE totals % 3 = 0),
pair AS (SELECT c.attribute1 || ' § ' || c.attribute2 AS name, c.totals, CASE WHEN a.frequency > b.frequency THEN c.attribute1 ELSE c.attribute2 END AS good_attribute,
                CASE WHEN a.frequency > b.frequency THEN c.attribute2 ELSE c.attribute1 END AS bad_attribute,
                round(c.totals / least(a.frequency, b.frequency), 6) AS pseudo_confidence
         FROM coexist c JOIN attrs a ON a.attribute = c.attribute1 JOIN attrs b ON b.attribute = c.attribute2)"""


def _pairs(spark, sf_dir):
    """Co-occurring names as pairs: the share of the rarer name's orders stands for the confidence."""
    s = baskets_stats(spark, sf_dir)
    side = lambda n: s["attributes"].toDF(f"attribute{n}", f"f{n}")
    p = s["coexist"].join(side(1), "attribute1").join(side(2), "attribute2")
    first = F.col("f1") > F.col("f2")
    return p.select(
        F.concat_ws(" § ", "attribute1", "attribute2").alias("name"), "attribute1", "attribute2", "totals",
        F.when(first, F.col("attribute1")).otherwise(F.col("attribute2")).alias("good_attribute"),
        F.when(first, F.col("attribute2")).otherwise(F.col("attribute1")).alias("bad_attribute"),
        F.round(F.col("totals") / F.least("f1", "f2"), 6).alias("pseudo_confidence"),
    )


@register("pending_pairs", SQL_STATS + "," + SQL_PAIRS + " SELECT name, totals FROM pair WHERE totals % 3 <> 0")
def q_pending(spark, sf_dir):
    """Pairs that a feature table (here of every pair whose total divides by 3) does not hold yet."""
    p = _pairs(spark, sf_dir)
    return C.pending(p, p.where("totals % 3 = 0").select("name")).select("name", "totals")


@register(
    "run_audit",
    SQL_STATS + "," + SQL_PAIRS + """ SELECT count(*) AS total, count_if(totals % 3 = 0) AS already_computed,
       count_if(totals % 3 <> 0 AND pseudo_confidence > 0.1) AS newly_computed,
       count_if(totals % 3 <> 0 AND NOT pseudo_confidence > 0.1) AS missing FROM pair""",
)
def q_audit(spark, sf_dir):
    """Total, stored, computable and missing pairs of a run."""
    p = _pairs(spark, sf_dir)
    return sinks.run_audit(p, p.where("totals % 3 = 0"), p.where("pseudo_confidence > 0.1"))


@register(
    "pair_record",
    SQL_STATS + "," + SQL_PAIRS + """ SELECT p.name, p.good_attribute, p.bad_attribute, p.totals, p.pseudo_confidence,
       round(w.weight, 6) AS weight, CASE WHEN w.totals % 3 = 0 THEN w.totals END AS stored_total
     FROM pair p JOIN weights w ON p.name = w.attribute1 || ' § ' || w.attribute2""",
)
def q_pair_record(spark, sf_dir):
    """Q14: the wide record of every pair from its feature tables."""
    name = F.concat_ws(" § ", "attribute1", "attribute2").alias("name")
    weights = baskets_stats(spark, sf_dir)["weights"].select(name, F.round("weight", 6).alias("weight"))
    p = _pairs(spark, sf_dir)
    stored = p.where("totals % 3 = 0").select("name", F.col("totals").alias("stored_total"))
    return Q.pair_record(p.drop("attribute1", "attribute2"), weights, stored)


@register(
    "queue_related",
    SQL_STATS + "," + SQL_PAIRS + """,
     given AS (SELECT attribute FROM attrs ORDER BY frequency DESC, attribute LIMIT 3),
     near AS (SELECT attribute, floor((rank - 1) / 5) AS chunk FROM (
       SELECT dst AS attribute, row_number() OVER (ORDER BY round(sum(weight), 9) DESC, dst) AS rank FROM sym
       WHERE src IN (SELECT attribute FROM given) AND dst NOT IN (SELECT attribute FROM given) GROUP BY dst) WHERE rank <= 500),
     und AS (SELECT * FROM pair WHERE totals % 3 <> 0),
     hits AS (SELECT DISTINCT u.*, n.chunk FROM und u JOIN near n ON n.attribute IN (u.good_attribute, u.bad_attribute)),
     chosen AS (SELECT DISTINCT name, pseudo_confidence FROM hits WHERE chunk = (SELECT min(chunk) FROM hits))
     SELECT name, pseudo_confidence, CAST(row_number() OVER (ORDER BY pseudo_confidence DESC, name) AS INTEGER) AS rank
     FROM chosen ORDER BY rank LIMIT 200""",
)
def q_queue_related(spark, sf_dir):
    """Q8: the nearest attributes of the three most used ones, five at a time, until pairs are left to decide
    (pairs whose total divides by 3 count as decided)."""
    s = baskets_stats(spark, sf_dir)
    given = s["attributes"].orderBy(F.col("frequency").desc(), "attribute").limit(3).select("attribute")
    p = _pairs(spark, sf_dir)
    out = Q.queue_related(p, p.where("totals % 3 = 0").select("name", F.lit("SKIPPED").alias("decision")), s["edges"], given, key="name")
    return out.select("name", "pseudo_confidence", F.col("rank").cast("int"))


SQL_STAGES = SQL_DECISIONS + """,
spine AS (SELECT DISTINCT pair_no FROM dec),
stage AS (SELECT decision AS analysis, pair_no, max(ts) AS ts FROM dec GROUP BY 1, 2)"""


def _stages(spark, sf_dir):
    """Each kind of decision stands for an analysis that stamped the pairs it was taken on."""
    d = A.decisions(spark, sf_dir)
    stamped = d.groupBy("decision", "pair_no").agg(F.max("ts").alias("ts"))
    return d.select("pair_no").distinct(), {k: stamped.where(F.col("decision") == k) for k in A.EVENT_DECISIONS.values()}


@register(
    "feature_progress",
    SQL_STAGES + " SELECT analysis, count(ts) AS processed, round(count(ts) * 100.0 / (SELECT count(*) FROM spine), 2) AS percent FROM stage GROUP BY 1",
)
def q_progress(spark, sf_dir):
    """Q17: pairs that each analysis has processed, and their share of all pairs."""
    spine, stages = _stages(spark, sf_dir)
    return Q.feature_progress(spine, **stages)


@register(
    "last_updates",
    SQL_STAGES + " SELECT analysis, strftime(max(ts), '%d.%m.%Y') AS date, strftime(max(ts), '%H.%M') AS time FROM stage GROUP BY 1",
)
def q_last_updates(spark, sf_dir):
    """Q18: when each analysis last ran."""
    return Q.last_updates(**_stages(spark, sf_dir)[1])


@register("known_word_list", "SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> ''")
def q_word_list(spark, sf_dir):
    """The words of the part names as a word list with blank lines and repeats, read back."""
    path = _new_path(spark, "words")
    words = A.read_table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("value"))
    words.unionByName(words.select(F.concat(F.lit("  "), "value").alias("value"))).unionByName(words.select(F.lit("").alias("value")).distinct()).write.text(path)
    return RD.read_word_list(spark, path)
