"""Curation queue, decisions and reports (Q1-Q18).

`pairs` has at least (pair_no or name as key, name, good_attribute, bad_attribute,
good_freq, bad_freq, pseudo_confidence). `decisions` is the append-only log
(username, pair key, decision, ts). Queues are top-k reports (TakeOrderedAndProject
on one small result); per-curator variants rank within a window partitioned by
curator, so no curator's list passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrmill.operators import recommend as R

DECISION_TYPES = ["SUGGESTED_MERGE", "SUGGESTED_NOMERGE", "SUGGESTED_REVERSEMERGE", "SKIPPED"]
# Labels shown for the last decision.
DECISION_LABELS = {
    "SKIPPED": "Skip",
    "SUGGESTED_MERGE": "Merge",
    "SUGGESTED_NOMERGE": "Don't merge",
    "SUGGESTED_REVERSEMERGE": "Merge reverse",
}


def undecided(pairs: DataFrame, decisions: DataFrame, key: str = "pair_no") -> DataFrame:
    """Q1: pairs with no decision of any type by anyone."""
    return pairs.join(decisions.where(F.col("decision").isin(DECISION_TYPES)).select(key).distinct(), key, "left_anti")


def omit_prefix(pairs: DataFrame, prefix: str | None) -> DataFrame:
    """Q2: drop pairs whose good or bad attribute starts with the prefix."""
    if not prefix:
        return pairs
    return pairs.where(~F.col("good_attribute").startswith(prefix) & ~F.col("bad_attribute").startswith(prefix))


def _top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def smart_order() -> list[Column]:
    return [F.col("pseudo_confidence").desc(), F.col("name")]


def queue_smart(pairs: DataFrame, decisions: DataFrame, prefix: str | None = None, n: int = 200, key: str = "pair_no") -> DataFrame:
    """Q3: undecided pairs by pseudo confidence (desc), then name; first n."""
    return _top(omit_prefix(undecided(pairs, decisions, key), prefix), smart_order(), n)


def queue_max(pairs: DataFrame, decisions: DataFrame, prefix: str | None = None, n: int = 200, key: str = "pair_no") -> DataFrame:
    """Q4: by the smaller of the two attribute frequencies (desc), name as tie-break."""
    p = omit_prefix(undecided(pairs, decisions, key), prefix).withColumn("m", F.least("bad_freq", "good_freq"))
    return _top(p, [F.col("m").desc(), F.col("name")], n)


def queue_major(pairs: DataFrame, decisions: DataFrame, prefix: str | None = None, n: int = 200, key: str = "pair_no") -> DataFrame:
    """Q5: by the larger of the two attribute frequencies (desc), name as tie-break."""
    p = omit_prefix(undecided(pairs, decisions, key), prefix).withColumn("m", F.greatest("bad_freq", "good_freq"))
    return _top(p, [F.col("m").desc(), F.col("name")], n)


def _attr_df(pairs: DataFrame, attrs: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(attrs, DataFrame):
        return attrs.select(F.col(attrs.columns[0]).alias("attribute")).distinct()
    return pairs.sparkSession.createDataFrame([(a,) for a in dict.fromkeys(attrs)], "attribute string")


def touching(pairs: DataFrame, attrs: DataFrame) -> DataFrame:
    """Pairs whose good or bad attribute is in `attrs` (each pair once)."""
    a = attrs  # may hold all earlier merges of a curator: Spark checks its size before broadcasting it
    g = pairs.join(a.withColumnRenamed("attribute", "good_attribute"), "good_attribute", "left_semi")
    b = pairs.join(a.withColumnRenamed("attribute", "bad_attribute"), "bad_attribute", "left_semi")
    return g.unionByName(b).distinct()


def queue_my_attributes(pairs, decisions, attrs, n: int = 200, key: str = "pair_no") -> DataFrame:
    """Q6: undecided pairs touching the curator's attributes, smart order, first n."""
    return _top(touching(undecided(pairs, decisions, key), _attr_df(pairs, attrs)), smart_order(), n)


def pairs_left(pairs, decisions, attrs, key: str = "pair_no") -> DataFrame:
    """Q7: undecided pairs per given attribute (good or bad side, each pair once per attribute)."""
    a = _attr_df(pairs, attrs)
    und = undecided(pairs, decisions, key)
    sides = und.select(key, F.col("good_attribute").alias("attribute")).unionByName(
        und.select(key, F.col("bad_attribute").alias("attribute"))
    ).distinct()
    return a.join(sides, "attribute", "left").groupBy("attribute").agg(F.count(key).alias("pairs_left"))


def queue_related(pairs, decisions, edges, attrs, n: int = 200, chunk: int = 5, nearest: int = 500, key: str = "pair_no") -> DataFrame:
    """Q8: walk the `nearest` recommended attributes in chunks of `chunk`; the first chunk
    with undecided pairs gives the queue (smart order, first n). One job, no loop."""
    near = R.recommend(edges, _attr_df(pairs, attrs), n=nearest).select("attribute", F.floor((F.col("rank") - 1) / chunk).alias("chunk"))
    und = undecided(pairs, decisions, key)
    hits = und.join(F.broadcast(near.withColumnRenamed("attribute", "good_attribute")), "good_attribute").unionByName(
        und.join(F.broadcast(near.withColumnRenamed("attribute", "bad_attribute")), "bad_attribute"), allowMissingColumns=True
    )
    hits = hits.select(*und.columns, "chunk").distinct()
    first = hits.agg(F.min("chunk").alias("chunk"))
    chosen = hits.join(first, "chunk", "left_semi").drop("chunk").distinct()
    return _top(chosen, smart_order(), n)


def previous_attributes(pairs, decisions, good: bool = False, key: str = "pair_no") -> DataFrame:
    """Q10 for every curator: bad side of merges and good side of reverse merges
    (the opposite sides when good=True) -> (username, attribute)."""
    d = decisions.where(F.col("decision").isin("SUGGESTED_MERGE", "SUGGESTED_REVERSEMERGE")).join(
        pairs.select(key, "good_attribute", "bad_attribute"), key
    )
    merge_side, reverse_side = ("good_attribute", "bad_attribute") if good else ("bad_attribute", "good_attribute")
    attr = F.when(F.col("decision") == "SUGGESTED_MERGE", F.col(merge_side)).otherwise(F.col(reverse_side))
    return d.select("username", attr.alias("attribute")).distinct()


def queue_dynamic(pairs, decisions, attrs, username: str, n: int = 200, key: str = "pair_no") -> DataFrame:
    """Q9: Q6 over the given list plus the attributes of this curator's earlier merges (both sides)."""
    mine = decisions.where(F.col("username") == username)
    prev = previous_attributes(pairs, mine, False, key).unionByName(previous_attributes(pairs, mine, True, key))
    wanted = _attr_df(pairs, attrs).unionByName(prev.select("attribute")).distinct()
    return queue_my_attributes(pairs, decisions, wanted, n, key)


def record_decision(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """Q11: append decisions (an append-only log; the writer adds new files)."""
    return decisions.unionByName(new.select(*decisions.columns))


def last_decision(decisions: DataFrame, key: str = "pair_no") -> DataFrame:
    """Q12 for every (curator, pair): label of the newest decision."""
    labels = F.create_map(*[F.lit(x) for kv in DECISION_LABELS.items() for x in kv])
    last = decisions.groupBy("username", key).agg(F.max_by("decision", "ts").alias("decision"), F.max("ts").alias("ts"))
    return last.withColumn("last_decision", labels[F.col("decision")])


def profile_stats(decisions: DataFrame) -> DataFrame:
    """Q13 for every curator: decisions (skips not counted), merges, no-merges, reverse merges."""
    d = F.col("decision")
    return decisions.groupBy("username").agg(
        F.count_if(d.isin("SUGGESTED_MERGE", "SUGGESTED_NOMERGE", "SUGGESTED_REVERSEMERGE")).alias("all_curated"),
        F.count_if(d == "SUGGESTED_MERGE").alias("merges"),
        F.count_if(d == "SUGGESTED_NOMERGE").alias("no_merges"),
        F.count_if(d == "SUGGESTED_REVERSEMERGE").alias("reverse_merges"),
    )


def wipe_decisions(decisions: DataFrame, usernames: DataFrame) -> DataFrame:
    """Q15: the log without the given curators' decisions (written as a new version)."""
    return decisions.join(usernames.select("username"), "username", "left_anti")


def pair_record(pairs: DataFrame, *features: DataFrame, key: str = "name") -> DataFrame:
    """Q14: the wide record per pair: the spine left-joined with each feature table."""
    out = pairs
    for f in features:
        dup = [c for c in f.columns if c in out.columns and c != key]
        out = out.join(f.drop(*dup), key, "left")
    return out


def overview_counts(pairs: DataFrame, sample_attr: DataFrame) -> DataFrame:
    """Q16: number of pairs and of samples (one row; the second is a scalar subquery)."""
    samples = sample_attr.agg(F.countDistinct("sample_id")).scalar()
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).withColumn("samples", samples)


def feature_progress(spine: DataFrame, **stages: DataFrame) -> DataFrame:
    """Q17: per analysis stage, pairs processed (rows with a timestamp) and their percentage of all pairs."""
    total = spine.agg(F.count(F.lit(1))).scalar()
    parts = [
        t.agg(F.count_if(F.col("ts").isNotNull()).alias("processed")).select(F.lit(s).alias("analysis"), "processed")
        for s, t in stages.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pct = F.round(F.col("processed") * 100.0 / F.nullif(total, F.lit(0)), 2)
    return out.select("analysis", "processed", pct.alias("percent"))


def last_updates(**stages: DataFrame) -> DataFrame:
    """Q18: newest timestamp per analysis, shown as dd.MM.yyyy and HH.mm."""
    parts = [t.agg(F.max("ts").alias("ts")).select(F.lit(s).alias("analysis"), "ts") for s, t in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("analysis", F.date_format("ts", "dd.MM.yyyy").alias("date"), F.date_format("ts", "HH.mm").alias("time"))
