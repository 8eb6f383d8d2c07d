"""Sinks (S7-S9): table writes, idempotent upsert by key, and the run audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet output, optionally partitioned (e.g. cluster tables by pair)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def upsert_by_key(old: DataFrame, new: DataFrame, key: list[str] | str) -> DataFrame:
    """Merge without duplicates: every new row, plus old rows whose key is not in `new`.

    Write the result to a new versioned path (never overwrite the input in place).
    """
    keys = [key] if isinstance(key, str) else key
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def run_audit(pairs: DataFrame, feature_table: DataFrame | None, computable: DataFrame, key: str = "name") -> DataFrame:
    """Total pairs, already computed, newly computable and missing (not computable) in one pass."""
    p = pairs.select(key).distinct()
    if feature_table is not None:
        p = p.join(feature_table.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    else:
        p = p.withColumn("_done", F.lit(None).cast("boolean"))
    p = p.join(computable.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    done = F.col("_done").isNotNull()
    ok = F.col("_ok").isNotNull()
    return p.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("already_computed"),
        F.count_if(~done & ok).alias("newly_computed"),
        F.count_if(~done & ~ok).alias("missing"),
    )


def write_sample_pages(sample_attr: DataFrame, path: str, page_size: int = 100) -> None:
    """The samples as landed API pages (what S1 reads): one JSON document a file, about `page_size`
    samples each. A sample is one JSON object, so its attributes are gathered; a page is a row."""
    value = F.array(F.struct(F.col("value").alias("text")))
    samples = sample_attr.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", value.alias("v")))).alias("characteristics"))
    pages = F.ceil(sample_attr.agg(F.countDistinct("sample_id")).scalar() / page_size)
    paged = samples.withColumn("page", F.pmod(F.xxhash64("sample_id"), pages)).groupBy("page").agg(
        F.collect_list(F.struct(F.col("sample_id").cast("string").alias("accession"), "characteristics")).alias("samples")
    )
    doc = F.to_json(F.struct(F.struct("samples").alias("_embedded")))
    paged.select("page", doc.alias("value")).write.partitionBy("page").text(path)


def _quoted(c):
    needs = c.contains('"') | c.contains(",") | c.contains("\n") | c.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_incidence(sample_attr: DataFrame, path: str) -> None:
    """Ragged CSV records 'sample_id,attribute,attribute,...' (what S3 reads)."""
    lists = sample_attr.groupBy("sample_id").agg(F.array_sort(F.collect_list("attribute")).alias("names"))
    cells = F.transform(F.concat(F.array(F.col("sample_id").cast("string")), "names"), _quoted)
    lists.select(F.array_join(cells, ",").alias("value")).write.text(path)


def write_value_counts(values: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Nested {attribute: {value: n}} JSON (what S5 reads), in files of about `rows_per_file` values;
    an attribute of many values goes on in several files. Each file is one JSON object on many lines."""
    files = F.greatest(F.ceil(values.agg(F.count(F.lit(1))).scalar() / rows_per_file), F.lit(1))
    rows = values.withColumn("file", F.pmod(F.xxhash64("attribute", "value"), files))
    in_file = Window.partitionBy("file").orderBy("attribute", "value")
    literal = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    before, after = F.lag("attribute").over(in_file), F.lead("attribute").over(in_file)
    opened = F.concat(literal(F.col("attribute")), F.lit(": {"))
    head = F.when(before.isNull(), F.concat(F.lit("{"), opened)).when(before != F.col("attribute"), F.concat(F.lit("}, "), opened)).otherwise(", ")
    line = F.concat(head, literal(F.col("value")), F.lit(": "), F.col("n").cast("string"), F.when(after.isNull(), "}}").otherwise(""))
    lines = rows.select("file", "attribute", "value", line.alias("line"))
    lines.repartition("file").sortWithinPartitions("file", "attribute", "value").select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
