"""Recommendation and suggestion.

All recommendation is a neighbourhood sum over the symmetric weighted edge
list: edges leaving the given attributes, minus the given attributes
themselves, summed per neighbour, top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrmill.session import written


def _given(edges: DataFrame, given: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(given, DataFrame):
        return given.select(F.col(given.columns[0]).alias("attribute")).distinct()
    spark = edges.sparkSession
    return spark.createDataFrame([(g,) for g in dict.fromkeys(given)], "attribute string")


def recommend(edges: DataFrame, given: Sequence[str] | DataFrame, n: int = 5) -> DataFrame:
    """Neighbours of the given attributes, not given themselves, by total weight.

    `edges` is the symmetric list (src, dst, weight). `given` is a short list
    (broadcast) or a one-column DataFrame, whose size Spark checks by itself.
    Output: (attribute, total_weight, rank) with rank 1..n.
    """
    g = _given(edges, given)
    if not isinstance(given, DataFrame):
        g = F.broadcast(g)
    near = (
        edges.join(g.withColumnRenamed("attribute", "src"), "src", "left_semi")
        .join(g.withColumnRenamed("attribute", "dst"), "dst", "left_anti")
        .groupBy(F.col("dst").alias("attribute"))
        .agg(F.sum("weight").alias("total_weight"))
    )
    # Top-k of one small group list: TakeOrderedAndProject, then rank.
    # Ranking uses the total rounded to 9 places so that float summation order
    # (which differs between runs and engines) cannot reorder near-ties.
    key = F.round("total_weight", 9)
    top = near.orderBy(key.desc(), F.col("attribute")).limit(n)
    w = Window.orderBy(key.desc(), F.col("attribute"))
    return top.withColumn("rank", F.row_number().over(w))


def known_attributes(attributes: DataFrame) -> DataFrame:
    """The set of all attribute names."""
    return attributes.select("attribute").distinct()


#: Joined rows (sample, held attribute, neighbour) that one task sums up and ranks.
ROWS_A_TASK = 4_000_000


def batch_recommend(sample_attr: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """R1 for every sample at once -> (sample_id, attribute, total_weight, rank).

    The samples are dealt out by their id once, over as many tasks as the joined rows need. The
    edge list is a written table, so Spark knows its size: where it is small enough to be sent to
    all tasks, join, sums, removal of the own attributes and ranking follow without another
    shuffle; else sums are shuffled by (sample, neighbour). An attribute is its own neighbour
    with a mark, so the sample's own attributes are known from the sums themselves.
    """
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst", "weight"), "edges")
    own = written(sample_attr.select("sample_id", "attribute").dropDuplicates(), "own")
    degrees = edges.groupBy(F.col("src").alias("attribute")).agg(F.count(F.lit(1)).alias("degree"))
    held = own.groupBy("attribute").agg(F.count(F.lit(1)).alias("held"))
    rows = held.join(degrees, "attribute").agg(F.sum(F.col("held") * (F.col("degree") + 1))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))

    # a sample without an id has no own attributes that could be told apart
    marked = edges.select(F.col("src").alias("attribute"), "dst", "weight", F.lit(False).alias("mine")).unionByName(
        degrees.select("attribute", F.col("attribute").alias("dst"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("mine"))
    )
    marked = written(marked, "marked_edges")
    cand = (
        own.repartition(tasks, "sample_id")
        .join(marked, "attribute")
        .groupBy("sample_id", F.col("dst").alias("attribute"))
        .agg(F.sum("weight").alias("total_weight"), F.max("mine").alias("mine"), F.min("mine").alias("only_mine"))
        .where("NOT only_mine AND (NOT mine OR sample_id IS NULL)")
        .drop("mine", "only_mine")
    )
    w = Window.partitionBy("sample_id").orderBy(F.round("total_weight", 9).desc(), F.col("attribute"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def did_you_mean(queries: DataFrame, vocabulary: DataFrame, n: int = 3, cutoff=(3, 5)) -> DataFrame:
    """Per query name: known=true if in the vocabulary; else up to n closest names
    with ratio 2*LCS/(|a|+|b|) >= cutoff (default 0.6), best first, ties to the larger name.

    Candidates come from the exact signature join on shared letters (no cross join);
    the top n per query come from a window over that query's candidates.
    Output: (query, known, suggestions ARRAY<STRING>; null when nothing is close).
    """
    from attrmill.plans.similarity_join import ratio_cutoff_pairs

    q = queries.select(F.col(queries.columns[0]).alias("query")).distinct()
    voc = vocabulary.select(F.col(vocabulary.columns[0]).alias("word")).distinct()
    hits = q.join(voc.withColumnRenamed("word", "query"), "query", "left_semi")
    misses = q.join(hits, "query", "left_anti")
    cand = ratio_cutoff_pairs(misses, voc, *cutoff)
    score = F.lit(2.0) * F.col("lcs") / (F.length("query") + F.length("word"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("word").desc())
    top = (
        cand.withColumn("score", score)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .groupBy("query")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("suggestions"))
    )
    known = hits.select("query", F.lit(True).alias("known"))
    return (
        q.join(known, "query", "left")
        .join(top, "query", "left")
        .select("query", F.coalesce("known", F.lit(False)).alias("known"), "suggestions")
    )
