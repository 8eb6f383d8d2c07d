import pytest
from pyspark.sql import functions as F

from attrmill.operators import samples as S
from attrmill.sources.versioned import VersionedTable

SCHEMA = "k string, n long, ts long"


def made(spark, tmp_path, rows, buckets=8):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame(rows, SCHEMA), ["k"], buckets)
    return t


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_replaces_adds_and_keeps(spark, tmp_path):
    t = made(spark, tmp_path, [("a", 1, 0), ("b", 2, 0), (None, 3, 0)])
    new = [("b", 20, 5), ("b", 21, 7), ("b", 22, 6), ("c", 30, 5), ("c", 31, 5), (None, 40, 1), (None, 40, 1)]
    assert t.upsert(spark.createDataFrame(new, SCHEMA), ["k"], ["ts"]) == 2
    assert rows_of(t.read()) == rows_of(spark.createDataFrame([("a", 1, 0), ("b", 21, 7), ("c", 31, 5), (None, 40, 1)], SCHEMA))
    assert rows_of(t.read(1)) == rows_of(spark.createDataFrame([("a", 1, 0), ("b", 2, 0), (None, 3, 0)], SCHEMA))


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = made(spark, tmp_path, [(f"k{i}", i, 0) for i in range(400)])
    before = t._mark(1)["writes"]
    t.upsert(spark.createDataFrame([("k7", -7, 1)], SCHEMA), ["k"], ["ts"])
    after = t._mark(2)["writes"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().agg(F.count("*"), F.sum("n")).first()[:] == (400, 400 * 399 // 2 - 14)


def test_repeating_an_upsert_changes_nothing(spark, tmp_path):
    t = made(spark, tmp_path, [("a", 1, 0)])
    new = spark.createDataFrame([("a", 2, 1), ("b", 3, 1)], SCHEMA)
    t.upsert(new, ["k"], ["ts"])
    first = rows_of(t.read())
    t.upsert(new, ["k"], ["ts"])
    assert rows_of(t.read()) == first


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    t = made(spark, tmp_path, [("a", 1, 0), ("b", 2, 0)])
    broken = spark.createDataFrame([("a", 5, 1)], SCHEMA).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken, ["k"], ["ts"])
    assert t.versions() == [1] and rows_of(t.read()) == [("a", 1, 0), ("b", 2, 0)]


def test_files_written_before_a_lost_commit_are_orphans(spark, tmp_path, monkeypatch):
    t = made(spark, tmp_path, [("a", 1, 0), ("b", 2, 0)])
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            t.upsert(spark.createDataFrame([("a", 5, 1)], SCHEMA), ["k"], ["ts"])
    assert rows_of(t.read()) == [("a", 1, 0), ("b", 2, 0)] and len(t._names("data")) == 2
    t.upsert(spark.createDataFrame([("a", 6, 1)], SCHEMA), ["k"], ["ts"])
    t.vacuum(keep=2)
    assert rows_of(t.read(1)) == [("a", 1, 0), ("b", 2, 0)] and len(t._names("data")) == 2
    t.vacuum()
    assert t.versions() == [2] and rows_of(t.read()) == [("a", 6, 1), ("b", 2, 0)]


def test_of_two_writers_one_fails(spark, tmp_path):
    t = made(spark, tmp_path, [("a", 1, 0)])
    t.upsert(spark.createDataFrame([("a", 2, 1)], SCHEMA), ["k"], ["ts"], base=1)
    with pytest.raises(RuntimeError, match="another job"):
        t.upsert(spark.createDataFrame([("a", 3, 1)], SCHEMA), ["k"], ["ts"], base=1)
    assert rows_of(t.read()) == [("a", 2, 1)] and not [n for n in t._names("versions") if n.startswith("draft")]


def test_deleting_all_rows_leaves_an_empty_table(spark, tmp_path):
    t = made(spark, tmp_path, [("a", 1, 0), ("a", 2, 0)])
    t.replace_groups(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",), ("a",)], "k string"))
    assert t.read().collect() == [] and t.read().columns == ["k", "n", "ts"]
    t.upsert(spark.createDataFrame([("z", 1, 1)], SCHEMA), ["k"], ["ts"])
    assert rows_of(t.read()) == [("z", 1, 1)]


def test_membership_rewrite_leaves_no_orphan_clusters(spark, tmp_path):
    schema = "name string, cluster_no int, sample_id string"
    first = [("p", 0, "1"), ("p", 1, "2"), ("p", 2, "3"), ("q", 0, "1"), ("q", 1, "9"), ("r", 0, "4")]
    t = S.create_cluster_membership(spark.createDataFrame(first, schema), str(tmp_path / "m"), buckets=4)
    new = spark.createDataFrame([("p", 0, "1"), ("p", 0, "2"), ("p", 0, "3")], schema)
    S.rewrite_cluster_membership(t, new, spark.createDataFrame([("p",), ("r",)], "name string"))
    assert rows_of(t.read()) == [("p", 0, "1"), ("p", 0, "2"), ("p", 0, "3"), ("q", 0, "1"), ("q", 1, "9")]
