"""Co-occurrence graph features per pair.

The graph is the symmetric edge list (src, dst, weight) from B9. Per pair
(bad, good): degrees, direct edge weight (0 when absent), Jaccard coefficient
of the neighbourhoods, and the break number (node connectivity) with its
bounds. All neighbourhood work is joins keyed by (pair, neighbour), linear in
the sum of the two degrees per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrmill.plans import connectivity


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per attribute -> (attribute, degree)."""
    return edges.select("src", "dst").distinct().groupBy(F.col("src").alias("attribute")).agg(F.count(F.lit(1)).alias("degree"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("attribute")).distinct()


def pairs_missing_from_graph(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with an endpoint that is not a graph node, with the reason."""
    nodes = graph_nodes(edges)
    bad_in = nodes.select(F.col("attribute").alias("bad_attribute"), F.lit(True).alias("bad_in"))
    good_in = nodes.select(F.col("attribute").alias("good_attribute"), F.lit(True).alias("good_in"))
    p = pairs.join(bad_in, "bad_attribute", "left").join(good_in, "good_attribute", "left")
    missing = p.where(F.col("bad_in").isNull() | F.col("good_in").isNull())
    reason = (
        F.when(F.col("bad_in").isNull() & F.col("good_in").isNull(), "both missing")
        .when(F.col("bad_in").isNull(), "bad attribute missing")
        .otherwise("good attribute missing")
    )
    return missing.select(*pairs.columns, reason.alias("reason"))


def pairs_in_graph(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = graph_nodes(edges)
    return pairs.join(nodes.withColumnRenamed("attribute", "bad_attribute"), "bad_attribute", "left_semi").join(
        nodes.withColumnRenamed("attribute", "good_attribute"), "good_attribute", "left_semi"
    )


def neighbourhood_counts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Per pair: degree_bad, degree_good, common neighbours, adjacency and edge weight."""
    e = edges.select("src", "dst", "weight")
    keys = pairs.select("name", "bad_attribute", "good_attribute")
    nb = keys.join(e.withColumnRenamed("src", "bad_attribute"), "bad_attribute").select("name", F.col("dst").alias("nbr"))
    ng = keys.join(e.withColumnRenamed("src", "good_attribute"), "good_attribute").select("name", F.col("dst").alias("nbr"))
    db = nb.groupBy("name").agg(F.countDistinct("nbr").alias("degree_bad"))
    dg = ng.groupBy("name").agg(F.countDistinct("nbr").alias("degree_good"))
    common = nb.distinct().join(ng.distinct(), ["name", "nbr"]).groupBy("name").agg(F.count(F.lit(1)).alias("common"))
    direct = keys.join(
        e.withColumnRenamed("src", "bad_attribute").withColumnRenamed("dst", "good_attribute"),
        ["bad_attribute", "good_attribute"],
    ).groupBy("name").agg(F.first("weight").alias("edge_weight"))
    return (
        keys.join(db, "name", "left")
        .join(dg, "name", "left")
        .join(common, "name", "left")
        .join(direct, "name", "left")
        .select(
            "name",
            "bad_attribute",
            "good_attribute",
            F.coalesce("degree_bad", F.lit(0)).alias("degree_bad"),
            F.coalesce("degree_good", F.lit(0)).alias("degree_good"),
            F.coalesce("common", F.lit(0)).alias("common_neighbours"),
            F.col("edge_weight").isNotNull().alias("adjacent"),
            F.coalesce("edge_weight", F.lit(0.0)).alias("edge_weight"),
        )
    )


def graph_features(pairs: DataFrame, edges: DataFrame, exact_break_no: bool = True) -> DataFrame:
    """C1-C6 for the pairs whose endpoints are both in the graph (C7 excluded).

    Output: name, bad_attribute, good_attribute, edge_weight, jaccard_coefficient,
    degree_bad, degree_good, edge_total, break_no_lower, break_no_upper, break_no,
    break_no_exact, attribute_sim.
    """
    nc = neighbourhood_counts(pairs_in_graph(pairs, edges), edges)
    d1, d2, cm = F.col("degree_bad"), F.col("degree_good"), F.col("common_neighbours")
    union = d1 + d2 - cm
    out = nc.select(
        "name",
        "bad_attribute",
        "good_attribute",
        "edge_weight",
        F.when(union > 0, cm / union).otherwise(F.lit(0.0)).alias("jaccard_coefficient"),
        "degree_bad",
        "degree_good",
        (d1 + d2).alias("edge_total"),
        (F.col("adjacent").cast("int") + cm).alias("break_no_lower"),
        F.least(d1, d2).alias("break_no_upper"),
    )
    out = connectivity.break_numbers(out, edges) if exact_break_no else out.withColumn(
        "break_no", F.when(F.col("break_no_lower") == F.col("break_no_upper"), F.col("break_no_lower"))
    )
    out = out.withColumn("break_no_exact", F.col("break_no").isNotNull())
    return out.withColumn(
        "attribute_sim", F.when(F.col("edge_total") > 0, F.col("break_no") * 2.0 / F.col("edge_total"))
    )


def pending(pairs: DataFrame, feature_table: DataFrame | None, key: str = "name", recalculate: bool = False) -> DataFrame:
    """Pairs still to compute (anti-join on the feature table), unless recalculating all.

    The caller orders work by pseudo_confidence only when it writes; the set is unordered.
    """
    if recalculate or feature_table is None:
        return pairs
    return pairs.join(feature_table.select(key), key, "left_anti")
