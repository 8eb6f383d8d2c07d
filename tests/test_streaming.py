import os
import tempfile

from pyspark.sql import functions as F

from attrmill.operators import queue as Q
from attrmill.sources import adapters as A
from attrmill.streaming import incremental as E

from conftest import SF0001


def test_decision_stream_equals_batch(spark):
    schema = spark.read.parquet(os.path.join(SF0001, "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF0001)
    agg = E.running_profile_stats(E.decision_stream(stream, "100000 days"))
    name = "profile_stream_test"
    ckpt = tempfile.mkdtemp(prefix="attrmill-ckpt-", dir="/tmp")
    q = agg.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", ckpt).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.table(name).collect())
    want = sorted(Q.profile_stats(A.decisions(spark, SF0001)).collect())
    assert got == want


def test_incremental_counts_are_replay_safe(spark):
    store = tempfile.mkdtemp(prefix="attrmill-store-", dir="/tmp")
    batch = A.user_events(spark, SF0001)
    E.merge_counts_batch(batch, 0, store)
    E.merge_counts_batch(batch, 0, store)  # replay of the same batch id: no double count
    E.merge_counts_batch(batch, 1, store)  # a second batch with the same rows: a sample holds an attribute once
    got = E.read_counts(spark, store, "attributes")
    from attrmill.operators import stats as B

    want = B.attribute_frequency(batch).select("attribute", F.col("frequency").alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_failure_before_the_commit_changes_nothing(spark, monkeypatch):
    """The batch fails after its first tables are written; its retry counts it once."""
    store = tempfile.mkdtemp(prefix="attrmill-store-", dir="/tmp")
    schema = "sample_id long, attribute string, value string"
    first = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], schema)
    second = spark.createDataFrame([(2, "a", "x"), (2, "b", "z")], schema)
    E.merge_counts_batch(first, 0, store)
    with monkeypatch.context() as m:
        m.setattr(E.B, "cooccurrence", lambda df: df.select(F.raise_error(F.lit("lost")).alias("attribute1"), F.lit("").alias("attribute2"), F.lit(1).alias("totals")))
        try:
            E.merge_counts_batch(second, 1, store)
            raise AssertionError("the batch was meant to fail")
        except Exception as e:
            assert "lost" in str(e)
    assert E.committed_batch(spark, store) == 0
    assert sorted(map(tuple, E.read_counts(spark, store, "attributes").collect())) == [("a", 1), ("b", 1)]
    E.merge_counts_batch(second, 1, store)
    E.merge_counts_batch(second, 1, store)
    assert sorted(map(tuple, E.read_counts(spark, store, "attributes").collect())) == [("a", 2), ("b", 2)]
    assert sorted(map(tuple, E.read_counts(spark, store, "values").collect())) == [("a", "x", 2), ("b", "y", 1), ("b", "z", 1)]
    assert sorted(map(tuple, E.read_counts(spark, store, "coexist").collect())) == [("a", "b", 2)]


def test_samples_split_over_batches_equal_the_batch_result(spark):
    """Attributes of a sample in several batches, repeats within and across batches, a fold between."""
    import random

    from attrmill.operators import stats as B

    rng = random.Random(3)
    schema = "sample_id long, attribute string, value string"
    rows = [(s, f"a{a}", f"v{(s * a) % 5}" if a % 4 else None) for s in range(30) for a in range(rng.randrange(12))]
    batches = [[] for _ in range(4)]
    for r in rows:
        for k in rng.sample(range(4), rng.choice([1, 1, 2])):
            batches[k] += [r] * rng.choice([1, 1, 2])
    batches[2] += [(None, "a1", "x"), (5, None, "x")]
    store = tempfile.mkdtemp(prefix="attrmill-store-", dir="/tmp")
    for k, b in enumerate(batches):
        E.merge_counts_batch(spark.createDataFrame(b, schema), k, store)
        if k == 1:
            E.compact_counts(E.counts_log(spark, store, "bigint"))
    whole = spark.createDataFrame(rows, schema)
    for name, want in [("attributes", B.attribute_frequency(whole)), ("values", B.value_counts(whole)), ("coexist", B.cooccurrence(whole))]:
        assert sorted(map(tuple, E.read_counts(spark, store, name).collect())) == sorted(map(tuple, want.collect()))
    assert E.committed_batch(spark, store) == 3 and len(E.counts_log(spark, store).committed()) == 3


def _decision_rows(spark, rows):
    return spark.createDataFrame(rows, "username string, pair_no long, decision string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_decision_log_appends_exactly_once(spark):
    from datetime import datetime

    log = E.decision_log(spark, tempfile.mkdtemp(prefix="attrmill-log-", dir="/tmp"))
    assert E.read_decisions(log).collect() == []
    first = _decision_rows(spark, [("u", 1, "SKIPPED", "2024-01-01 10:00:00")] * 2 + [("u", None, "SKIPPED", None)])
    second = _decision_rows(spark, [("u", 1, "SKIPPED", "2024-01-01 10:00:00"), ("u", 1, "SUGGESTED_MERGE", "2024-01-02 09:00:00"), ("u", None, "SKIPPED", None)])
    for batch_id, batch in [(0, first), (0, first), (1, second), (0, second), (1, second)]:
        E.append_decisions_batch(batch, batch_id, log)
    got = sorted(map(tuple, E.read_decisions(log).collect()), key=str)
    want = [("u", 1, "SKIPPED", datetime(2024, 1, 1, 10)), ("u", 1, "SUGGESTED_MERGE", datetime(2024, 1, 2, 9)), ("u", None, "SKIPPED", None)]
    assert got == sorted(want, key=str)
    E.append_decisions_batch(_decision_rows(spark, []), 2, log)
    assert log.last_batch() == 2 and E.read_decisions(log).count() == 3


def test_decision_files_without_a_mark_are_not_read(spark, monkeypatch):
    import pytest

    log = E.decision_log(spark, tempfile.mkdtemp(prefix="attrmill-log-", dir="/tmp"))
    rows = _decision_rows(spark, [("u", 1, "SKIPPED", "2024-01-01 10:00:00")])
    with monkeypatch.context() as m:
        m.setattr(type(log), "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            E.append_decisions_batch(rows, 0, log)
    assert E.read_decisions(log).collect() == []
    E.append_decisions_batch(rows, 0, log)
    assert E.read_decisions(log).count() == 1


def test_decision_stream_into_the_log(spark):
    schema = spark.read.parquet(os.path.join(SF0001, "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF0001)
    root = tempfile.mkdtemp(prefix="attrmill-log-", dir="/tmp")
    log = E.decision_log(spark, root + "/log")
    for _ in range(2):  # the second run finds no new files
        E.start_decision_log(E.decision_stream(stream, "100000 days"), log, root + "/ckpt").awaitTermination()
    want = A.decisions(spark, SF0001).withColumn("ts", F.col("ts").cast("timestamp"))
    got = Q.last_decision(E.read_decisions(log)).collect()
    assert sorted(got, key=str) == sorted(Q.last_decision(want).collect(), key=str)
