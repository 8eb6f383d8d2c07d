"""Incremental upkeep (extension; the reference only re-runs batches).

E1: a stream of sample rows (sample_id, attribute, value) keeps attribute, value and
co-occurrence counts current. The state is the set of attributes of every sample, held as a
table; a micro-batch adds to it what is new and appends the deltas of the counts that this
makes (B2-B5), so a sample may arrive in any number of batches and repeats count once. State,
deltas and batch id are committed by one mark, so a replay after a failure changes nothing.
Weights (B7) are global and stay a batch job over the counts.

E2: the decision log as a stream: appended exactly once (Q11), duplicates dropped, and the
newest decision per (curator, pair) and per-curator totals as aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.operators import stats as B
from attrmill.streaming.batch_log import BatchLog

#: The count tables and their keys.
COUNT_TABLES = {"attributes": ["attribute"], "values": ["attribute", "value"], "coexist": ["attribute1", "attribute2"]}
#: Batches after which the deltas are folded into one.
FOLD_AFTER = 50


def counts_log(spark: SparkSession, store: str, sample_id: str = "string") -> BatchLog:
    tables = {name: ", ".join(f"{k} string" for k in keys) + ", n bigint" for name, keys in COUNT_TABLES.items()}
    return BatchLog(spark, store, {"members": f"sample_id {sample_id}, attribute string", **tables})


def committed_batch(spark: SparkSession, store: str) -> int | None:
    """The newest batch whose tables are all complete (its mark is written last)."""
    return counts_log(spark, store).last_batch()


def _summed(deltas: DataFrame, name: str) -> DataFrame:
    return deltas.groupBy(*COUNT_TABLES[name]).agg(F.sum("n").cast("bigint").alias("n"))


def read_counts(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A count table as of the newest committed batch; None before the first one."""
    log = counts_log(spark, store)
    return _summed(log.read(name), name) if log.committed() else None


def merge_counts_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """foreachBatch body for E1: append what one micro-batch adds to members and counts.

    New are the (sample, attribute) that the state does not hold; their value is the one of the
    first batch that has them (within a batch the smallest). Pairs are counted among the new
    attributes of a sample and between them and the held ones, in blocks, so a hot sample is not
    one task. Rows without a sample or an attribute count nowhere. A batch reads the two key
    columns of the state once and writes only deltas, which are folded every FOLD_AFTER batches.
    """
    spark = batch.sparkSession
    log = counts_log(spark, store, batch.schema["sample_id"].dataType.simpleString())
    done = log.last_batch()
    if done is not None and batch_id <= done:
        return  # already merged (replay)
    # the batch's source is read once, though its rows meet the state twice
    rows = batch.where("sample_id IS NOT NULL AND attribute IS NOT NULL").groupBy("sample_id", "attribute").agg(F.min("value").alias("value")).persist()
    held = log.read("members").join(rows.select("sample_id").distinct(), "sample_id", "left_semi")
    new = rows.join(held, ["sample_id", "attribute"], "left_anti").persist()
    try:
        log.write("members", new.select("sample_id", "attribute"), batch_id)
        log.write("attributes", B.attribute_frequency(new).withColumnRenamed("frequency", "n"), batch_id)
        log.write("values", B.value_counts(new), batch_id)
        old = held.join(new.select("sample_id").distinct(), "sample_id", "left_semi")
        across = B.block_pairs(new.select("sample_id", "attribute"), old).groupBy("attribute1", "attribute2").agg(F.count(F.lit(1)).alias("n"))
        within = B.cooccurrence(new).withColumnRenamed("totals", "n")
        log.write("coexist", _summed(within.unionByName(across), "coexist"), batch_id)
    finally:
        new.unpersist()
        rows.unpersist()
    log.commit(batch_id)
    if len(log.committed()) > FOLD_AFTER:
        compact_counts(log)


def compact_counts(log: BatchLog) -> None:
    """Folds the deltas of all committed batches into one part; the counts stay the same."""
    log.compact({name: (lambda df, name=name: _summed(df, name)) for name in COUNT_TABLES})


def start_incremental_counts(stream: DataFrame, store: str, checkpoint: str, trigger_once: bool = True):
    """Start E1 on a streaming DataFrame of (sample_id, attribute, value)."""
    w = stream.writeStream.foreachBatch(lambda df, i: merge_counts_batch(df, i, store)).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


#: What makes a decision the same decision.
DECISION_KEY = ["username", "pair_no", "decision", "ts"]


def decision_log(spark: SparkSession, store: str, ts: str = "timestamp") -> BatchLog:
    """Q11: the log of decisions, in folders by day."""
    return BatchLog(spark, store, {"decisions": f"username string, pair_no bigint, decision string, ts {ts}, day date"}, {"decisions": ["day"]})


def append_decisions_batch(batch: DataFrame, batch_id: int, log: BatchLog) -> None:
    """Q11, foreachBatch body: append decisions exactly once.

    A replay of a committed batch writes nothing. A decision sent again, in this batch or after an
    earlier one, is left out; only the days of the batch are read for that. Nulls of the key are
    equal to each other (rows without a time lie in the folder of no day).
    """
    done = log.last_batch()
    if done is not None and batch_id <= done:
        return
    rows = batch.select(*DECISION_KEY).dropDuplicates().withColumn("day", F.to_date("ts"))
    days = rows.select(F.coalesce("day", F.lit("1000-01-01").cast("date")).alias("_day")).distinct()
    held = log.read("decisions").withColumn("_day", F.coalesce("day", F.lit("1000-01-01").cast("date"))).join(days, "_day", "left_semi")
    held = held.select(*[F.col(c).alias(f"_{c}") for c in DECISION_KEY])
    same = F.lit(True)
    for c in DECISION_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    log.write("decisions", rows.join(held, same, "left_anti").hint("rebalance", F.col("day")), batch_id)
    log.commit(batch_id)


def start_decision_log(stream: DataFrame, log: BatchLog, checkpoint: str, trigger_once: bool = True):
    """Q11 on a streaming DataFrame of (username, pair_no, decision, ts)."""
    w = stream.writeStream.foreachBatch(lambda df, i: append_decisions_batch(df, i, log)).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def read_decisions(log: BatchLog) -> DataFrame:
    return log.read("decisions").select(*DECISION_KEY)


def decision_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """E2 input: decisions from a streaming events source, duplicates dropped within the watermark."""
    from attrmill.sources.adapters import EVENT_DECISIONS

    mapping = F.create_map(*[F.lit(x) for kv in EVENT_DECISIONS.items() for x in kv])
    d = events.where(F.col("event_type") != "error").select(
        F.col("user_id").cast("string").alias("username"),
        F.get_json_object("props", "$.k").cast("bigint").alias("pair_no"),
        mapping[F.col("event_type")].alias("decision"),
        F.col("ts").cast("timestamp").alias("ts"),  # watermarks need TIMESTAMP (the file has TIMESTAMP_NTZ)
    )
    return d.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["username", "pair_no", "decision", "ts"])


def running_profile_stats(decisions: DataFrame) -> DataFrame:
    """Per-curator running totals (Q13) in update mode."""
    d = F.col("decision")
    return decisions.groupBy("username").agg(
        F.count_if(d.isin("SUGGESTED_MERGE", "SUGGESTED_NOMERGE", "SUGGESTED_REVERSEMERGE")).alias("all_curated"),
        F.count_if(d == "SUGGESTED_MERGE").alias("merges"),
        F.count_if(d == "SUGGESTED_NOMERGE").alias("no_merges"),
        F.count_if(d == "SUGGESTED_REVERSEMERGE").alias("reverse_merges"),
    )


def running_last_decision(decisions: DataFrame) -> DataFrame:
    """Newest decision per (curator, pair) (Q12) as a running max_by."""
    return decisions.groupBy("username", "pair_no").agg(F.max_by("decision", "ts").alias("decision"), F.max("ts").alias("ts"))
