"""Adapter views: give the driver's tables the shapes the curation operators consume.

Each adapter reads whole tables (column-pruned parquet scans) and returns the
long form ``sample_attr(sample_id, attribute, value)`` or ``attr_values`` or
``decisions``. The same definitions are written in SQL in
the ``attrmill.catalog*`` modules so that DuckDB can check every query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def baskets(spark: SparkSession, sf_dir: str, gathered: bool = False) -> DataFrame:
    """Orders as samples, part names as attributes, first line's quantity as value.

    One row per (order, part name); the value is the quantity of the line with the
    smallest (l_linenumber, l_quantity), as l_linenumber is not unique per order. ``gathered``
    deals the lines out by order, for callers that gather each sample: one shuffle serves both.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    first = F.min(F.struct("l_linenumber", "l_quantity"))
    lines = li.join(part, li.l_partkey == part.p_partkey)
    return (
        (lines.repartition("l_orderkey") if gathered else lines)
        .groupBy(F.col("l_orderkey").alias("sample_id"), F.col("p_name").alias("attribute"))
        .agg(first.getField("l_quantity").cast("string").alias("value"))
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as samples, event types as attributes, value of the earliest such event."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    first = F.min(F.struct("ts", "event_id", "value"))
    return ev.groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("attribute")).agg(
        first.getField("value").cast("string").alias("value")
    )


WORD_PATTERN = r"\p{L}+"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples, each distinct word (run of letters) as attribute.

    Whole texts are tokenised; the word is kept in its original case.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(
        F.col("doc_id").alias("sample_id"),
        F.explode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0)).alias("attribute"),
    )
    return words.distinct().withColumn("value", F.lit(None).cast("string"))


#: Spellings of a part name, by part number: as SQL that Spark and DuckDB read alike.
NAME_STYLES = [
    "p_name",
    "concat(split_part(p_name, ' ', 1), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(split_part(p_name, ' ', 2), 2))",
    "concat(upper(substring(p_name, 1, 1)), substring(replace(p_name, ' ', '_'), 2))",
    "concat(p_name, 's')",
    "concat(p_name, ' ', CAST(p_partkey % 3 AS STRING))",
    "upper(p_name)",
    "concat('the ', p_name)",
    "replace(p_name, ' ', '')",
    "concat(upper(substring(p_name, 1, 1)), substring(p_name, 2), 's')",
]
STYLED_NAME = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(NAME_STYLES)) + " END"


def styled_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, part names in the spelling of the part's number as attributes: names that
    differ by case, camel case, spaces, special characters, plurals, numbers and stop words."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_partkey")
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(STYLED_NAME).alias("attribute"))
    return li.join(part, "l_partkey").select("sample_id", "attribute").distinct()


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the part names, lower case: the word list of a curator's own dictionary."""
    return read_table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as samples, each distinct word as attribute: a sparse graph, as few items share words."""
    items = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("sample_id"), F.explode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0)).alias("attribute")
    )
    return items.distinct().withColumn("value", F.lit(None).cast("string"))


# Columns unpivoted by `column_values`: (table, column, kind).
COLUMN_VALUE_SOURCES = [
    ("lineitem", "l_quantity", "number"),
    ("lineitem", "l_extendedprice", "number"),
    ("orders", "o_totalprice", "number"),
    ("part", "p_retailprice", "number"),
    ("customer", "c_acctbal", "number"),
    ("supplier", "s_acctbal", "number"),
    ("lineitem", "l_shipdate", "date"),
    ("orders", "o_orderdate", "date"),
    ("customer", "c_name", "string"),
    ("supplier", "s_name", "string"),
    ("part", "p_name", "string"),
    ("part", "p_brand", "string"),
    ("part", "p_type", "string"),
    ("nation", "n_name", "string"),
    ("region", "r_name", "string"),
]


def _as_text(col: str, kind: str):
    c = F.col(col)
    if kind == "number":
        return c.cast("decimal(18,2)").cast("string")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    return c


def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts ``attr_values(attribute, value, n)`` of chosen columns.

    attribute = 'table.column'; numbers are printed with two decimals and dates as
    yyyy-MM-dd, so that the text form is the same in every engine. Each table is scanned once
    and its columns are unpivoted; one aggregation (partial where scanned) counts them all.
    """
    parts = []
    for table in dict.fromkeys(t for t, _, _ in COLUMN_VALUE_SOURCES):
        cols = [(c, kind) for t, c, kind in COLUMN_VALUE_SOURCES if t == table]
        cells = [F.struct(F.lit(f"{table}.{c}").alias("attribute"), _as_text(c, kind).alias("value")) for c, kind in cols]
        df = read_table(spark, sf_dir, table).select(*[c for c, _ in cols])
        parts.append(df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


# Fixed mapping of event types to curator decisions (adapter convention).
EVENT_DECISIONS = {
    "purchase": "SUGGESTED_MERGE",
    "signup": "SUGGESTED_NOMERGE",
    "click": "SUGGESTED_REVERSEMERGE",
    "view": "SKIPPED",
}


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curator decision log from `events`: user -> pair number k of props, typed by event."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "props")
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_DECISIONS.items() for x in kv])
    return ev.where(F.col("event_type") != "error").select(
        F.col("user_id").cast("string").alias("username"),
        F.get_json_object("props", "$.k").cast("bigint").alias("pair_no"),
        mapping[F.col("event_type")].alias("decision"),
        F.col("ts"),
    )
