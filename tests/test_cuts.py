"""Work that a query must not repeat: lineage cuts, and what a diagnosis computes per pair."""

from pyspark.sql import functions as F

from attrmill.operators import lexical as L
from attrmill.session import cut_lineage


def test_a_cut_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = cut_lineage(spark.range(0, 40, 1, 4).select(counted("id").alias("id")))
    assert sorted(r.id for r in rows.collect()) == list(range(40))
    assert seen.value == 40


def test_forms_are_computed_per_attribute_and_not_per_pair(spark):
    pairs = spark.createDataFrame([("the cat", "the cats", 93), ("the cat", "thecat", 92)], "attribute1 string, attribute2 string, levenshtein int")
    names = spark.createDataFrame([("the cat", 5), ("the cats", 2), ("thecat", 7)], "attribute string, frequency long")
    words = spark.createDataFrame([("cat",), ("the",)], "word string")
    diag = L.diagnose(pairs, names, words)
    plan = diag._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
    got = {r.attribute2: r for r in diag.collect()}
    assert got["the cats"].s_discrepancy and got["the cats"].good_attribute == "the cat"
    assert got["thecat"].only_space_discrepancy and got["thecat"].good_attribute == "thecat" and got["thecat"].bad_words == ["thecat"]


def test_break_numbers_read_pairs_and_edges_that_are_written(spark):
    from attrmill.catalog_features import q_pair_break_numbers

    plan = q_pair_break_numbers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_a_batch_reads_its_source_once(spark, tmp_path):
    from attrmill.streaming import incremental as E

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    counted = counted.asNondeterministic()  # else a filter on the column computes it once more
    rows = [(f"s{i}", f"a{k}", str(k)) for i in range(6) for k in range(i % 3 + 1)]
    source = spark.createDataFrame(rows, "sample_id string, attribute string, value string")
    for batch_id in (0, 1):
        E.merge_counts_batch(source.select(counted("sample_id").alias("sample_id"), "attribute", "value"), batch_id, str(tmp_path / "store"))
        assert seen.value == len(rows) * (batch_id + 1)
    counts = {(r.attribute1, r.attribute2): r.n for r in E.read_counts(spark, str(tmp_path / "store"), "coexist").collect()}
    assert counts == {("a0", "a1"): 4, ("a0", "a2"): 2, ("a1", "a2"): 2}
