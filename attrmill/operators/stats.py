"""Attribute, value and co-occurrence statistics.

Input is the long form ``sample_attr(sample_id, attribute, value)`` with one
row per (sample, attribute). Everything is a hash aggregate with map-side
partial aggregation; the only pair generation is a join of the blocks of each
sample, which spreads a hot sample over all tasks and whose output is
immediately partially aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strip_ids(sample_attr: DataFrame) -> DataFrame:
    """The attribute lists without their sample ids (a projection)."""
    return sample_attr.select("attribute")


def attribute_frequency(sample_attr: DataFrame) -> DataFrame:
    """B1: samples per attribute -> (attribute, frequency).

    Ordering (frequency desc, attribute desc) is applied by `ordered_attributes`
    only when a sorted file is written; the table itself is unordered.
    """
    return (
        sample_attr.select("sample_id", "attribute")
        .dropDuplicates()
        .groupBy("attribute")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def ordered_attributes(attributes: DataFrame) -> DataFrame:
    return attributes.orderBy(F.col("frequency").desc(), F.col("attribute").desc())


def value_counts(sample_attr: DataFrame) -> DataFrame:
    """B2: count per (attribute, value) -> attr_values(attribute, value, n)."""
    return (
        sample_attr.where(F.col("value").isNotNull())
        .groupBy("attribute", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_partial_value_counts(*parts: DataFrame) -> DataFrame:
    """Sum per-worker value counts (union + partial/final aggregate)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("attribute", "value").agg(F.sum("n").cast("bigint").alias("n"))


#: Attributes of a sample that are paired in one piece; a longer list is cut into blocks of about this
#: many, and every two blocks are joined by themselves.
BLOCK = 512


def block_pairs(left: DataFrame, right: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(sample_id, attribute1, attribute2): every two different attributes of a sample once, in order;
    with `right`, every attribute of `left` with every one of `right` (which hold different ones).

    A sample of m attributes falls into ceil(m / block) blocks by a hash of the attribute, and each
    attribute goes to the pairs of blocks that its own is in. The join key is (sample, block, block),
    so one sample of any size is spread over all tasks, at most about block^2 pairs a key.
    """
    self_join = right is None
    both = left if self_join else left.unionByName(right)
    large = both.groupBy("sample_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")

    def blocked(side: DataFrame) -> DataFrame:
        n = F.coalesce("blocks", F.lit(1))
        return side.select("sample_id", "attribute").join(large, "sample_id", "left").select(
            "sample_id", "attribute", n.alias("blocks"), F.pmod(F.xxhash64("attribute"), n).cast("int").alias("block")
        )

    # in a self-join the pair of blocks (i, j) is made for i <= j only
    upper = F.sequence("block", F.col("blocks") - 1) if self_join else F.sequence(F.lit(0), F.col("blocks") - 1)
    lower = F.sequence(F.lit(0), F.col("block")) if self_join else F.sequence(F.lit(0), F.col("blocks") - 1)
    a = blocked(left).select("sample_id", F.col("attribute").alias("a"), F.col("block").alias("i"), F.explode(upper).alias("j"))
    b = blocked(left if self_join else right).select("sample_id", F.col("attribute").alias("b"), F.col("block").alias("j"), F.explode(lower).alias("i"))
    pairs = a.join(b, ["sample_id", "i", "j"])
    if self_join:
        pairs = pairs.where("i < j OR a < b")
    return pairs.select("sample_id", F.least("a", "b").alias("attribute1"), F.greatest("a", "b").alias("attribute2"))


def cooccurrence(sample_attr: DataFrame) -> DataFrame:
    """Number of samples holding both attributes, attribute1 < attribute2.

    Pairs come from a join of the blocks of each sample (`block_pairs`), so a hot sample is no
    single task, and are counted by a partial and a final aggregate.
    """
    base = sample_attr.select("sample_id", "attribute").where("sample_id IS NOT NULL AND attribute IS NOT NULL").dropDuplicates()
    return block_pairs(base).groupBy("attribute1", "attribute2").agg(F.count(F.lit(1)).alias("totals"))


def merge_partial_cooccurrence(*parts: DataFrame) -> DataFrame:
    """Re-orient each pair alphabetically and sum partial counts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lo = F.least("attribute1", "attribute2")
    hi = F.greatest("attribute1", "attribute2")
    return (
        out.select(lo.alias("attribute1"), hi.alias("attribute2"), "totals")
        .groupBy("attribute1", "attribute2")
        .agg(F.sum("totals").cast("bigint").alias("totals"))
    )


def sample_total(sample_attr: DataFrame) -> DataFrame:
    """Number of samples N, as a table of one row (n_samples)."""
    return sample_attr.agg(F.countDistinct("sample_id").alias("n_samples"))


def cooccurrence_weights(coexist: DataFrame, attributes: DataFrame, total: DataFrame) -> DataFrame:
    """Expected co-occurrence under independence and its normalised excess.

    prob = frequency / N; exp = p1 * p2 * N; diff = totals - exp;
    weight = diff / sum(diff). Pairs whose attribute is missing from
    `attributes` are dropped by the inner joins (as intended, see B8).
    N (`total`, one row) and the total of diff are scalar subqueries of the plan, so
    nothing runs while the query is built.
    """
    n = total.select(F.col("n_samples").cast("double")).scalar()
    p1 = attributes.select(F.col("attribute").alias("attribute1"), (F.col("frequency") / n).alias("p1"), n.alias("n"))
    p2 = attributes.select(F.col("attribute").alias("attribute2"), (F.col("frequency") / n).alias("p2"))
    edges = (
        coexist.join(p1, "attribute1")
        .join(p2, "attribute2")
        .select(
            "attribute1",
            "attribute2",
            "totals",
            (F.col("p1") * F.col("p2") * F.col("n")).alias("exp"),
        )
        .withColumn("diff", F.col("totals") - F.col("exp"))
    )
    total_diff = edges.agg(F.sum("diff")).scalar()
    return edges.withColumn("weight", F.col("diff") / F.nullif(total_diff, F.lit(0.0)))


def dropped_pairs(coexist: DataFrame, weights: DataFrame) -> DataFrame:
    """Co-occurring pairs lost because an attribute has no frequency."""
    return coexist.join(weights.select("attribute1", "attribute2"), ["attribute1", "attribute2"], "left_anti")


def symmetric_edges(weights: DataFrame) -> DataFrame:
    """Undirected edge list as both directions (src, dst, totals, weight).

    Edges with a null total or weight are left out, as is an edge whose
    endpoint is not a known attribute (already ensured by B7's inner joins).
    """
    e = weights.where(F.col("totals").isNotNull() & F.col("weight").isNotNull())
    fwd = e.select(F.col("attribute1").alias("src"), F.col("attribute2").alias("dst"), "totals", "weight")
    bwd = e.select(F.col("attribute2").alias("src"), F.col("attribute1").alias("dst"), "totals", "weight")
    return fwd.unionByName(bwd)


def build_statistics(sample_attr: DataFrame) -> dict[str, DataFrame]:
    """S1->S2->{B1,B2,B4}->B7 as one set of lazily planned tables."""
    attributes = attribute_frequency(sample_attr)
    values = value_counts(sample_attr)
    coexist = cooccurrence(sample_attr)
    n = sample_total(sample_attr)
    weights = cooccurrence_weights(coexist, attributes, n)
    return {"attributes": attributes, "values": values, "coexist": coexist, "weights": weights, "n_samples": n}
