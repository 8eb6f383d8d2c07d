from pyspark.sql import functions as F

from attrmill.operators import stats as B
from attrmill.sources import adapters as A

from conftest import SF0001


def test_weights_sum_to_one(spark):
    sa = A.baskets(spark, SF0001)
    s = B.build_statistics(sa)
    total = s["weights"].agg(F.sum("weight")).first()[0]
    assert abs(total - 1.0) < 1e-9


def test_independent_attributes_have_zero_diff(spark):
    # two attributes each in half of 4 samples, together in one: exp = 0.5*0.5*4 = 1 = totals
    sa = spark.createDataFrame(
        [(1, "a", None), (1, "b", None), (2, "a", None), (3, "b", None), (4, "c", None)],
        "sample_id long, attribute string, value string",
    )
    s = B.build_statistics(sa)
    row = s["weights"].where("attribute1 = 'a' and attribute2 = 'b'").first()
    assert row.totals == 1 and abs(row.diff) < 1e-12


def test_cooccurrence_merge_is_orientation_free(spark):
    sa = A.user_events(spark, SF0001)
    c = B.cooccurrence(sa)
    rev = c.select(F.col("attribute2").alias("attribute1"), F.col("attribute1").alias("attribute2"), "totals")
    merged = B.merge_partial_cooccurrence(rev)
    assert sorted(merged.collect()) == sorted(c.collect())


def test_attribute_called_na_survives(spark, tmp_path):
    from attrmill.sources import readers as RD

    p = tmp_path / "attributes.csv"
    p.write_text("attribute,frequency\nNA,3\nsex,5\n")
    got = {r.attribute for r in RD.read_attributes(spark, str(p)).collect()}
    assert got == {"NA", "sex"}


def test_block_pairs_equal_all_pairs(spark):
    """Samples below, at and far above the block size; repeated rows and null attributes."""
    from collections import Counter
    from itertools import combinations

    held = {s: [f"a{i:03d}" for i in range(s, s + m)] for s, m in [(1, 1), (2, 7), (3, 8), (4, 9), (5, 100)]}
    rows = [(s, a) for s, names in held.items() for a in names] * 2 + [(5, None)]
    base = spark.createDataFrame(rows, "sample_id long, attribute string").where("attribute is not null").distinct()
    got = Counter(map(tuple, B.block_pairs(base, block=8).collect()))
    want = Counter((s, *p) for s, names in held.items() for p in combinations(sorted(names), 2))
    assert got == want
    left, right = base.where("attribute <= 'a050'"), base.where("attribute > 'a050'")
    across = Counter(map(tuple, B.block_pairs(left, right, block=8).collect()))
    assert across == Counter({p: 1 for p in want if p[1] <= "a050" < p[2]})


def test_hot_sample_is_spread_over_tasks(spark):
    """One sample with 20,000 names among small ones: no task makes over 3 times the median of pairs."""
    hot = spark.range(20_000).select(F.lit(0).alias("sample_id"), F.concat(F.lit("n"), "id").alias("attribute"))
    small = spark.range(30_000).select((F.col("id") % 10_000 + 1).alias("sample_id"), F.concat(F.lit("n"), F.col("id") % 20_000).alias("attribute"))
    base = hot.unionByName(small).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = B.block_pairs(base).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    made = sorted(r.n for r in pairs)
    assert sum(made) >= 20_000 * 19_999 // 2
    assert len(made) > 1 and made[-1] <= 3 * made[len(made) // 2]
