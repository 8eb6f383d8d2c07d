"""Sources (S1-S6): landed sample pages, the ragged incidence file, the statistic
CSVs, nested value counts and word lists. All readers use explicit schemas (no
inference pass) and leave parallelism to the file splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrmill.sources.splits import quoted_records

SAMPLE_PAGE_SCHEMA = (
    "_embedded STRUCT<samples: ARRAY<STRUCT<accession: STRING, "
    "characteristics: MAP<STRING, ARRAY<STRUCT<text: STRING>>>>>>"
)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages (one JSON document per file) -> (sample_id, characteristics)."""
    pages = spark.read.schema(SAMPLE_PAGE_SCHEMA).json(path, multiLine=True)
    s = pages.select(F.explode("_embedded.samples").alias("s"))
    return s.select(F.col("s.accession").alias("sample_id"), F.col("s.characteristics").alias("characteristics"))


def explode_characteristics(samples: DataFrame) -> DataFrame:
    """One row per (sample, attribute) with the text of the first value only."""
    kv = samples.select("sample_id", F.explode("characteristics").alias("attribute", "vals"))
    return kv.select("sample_id", "attribute", F.get(F.col("vals"), 0).getField("text").alias("value"))


# A cell after its comma: quoted (doubled quotes inside) or plain. Possessive, so that long cells
# take no stack and no second look.
_CELL = r',("[^"]*+(?:""[^"]*+)*+"[^,"]*+|[^,]*+)'


def csv_cells(record):
    """The cells of one CSV record as an array, without their quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), 1)
    return F.transform(
        cells, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    )


def read_incidence(spark: SparkSession, path: str) -> DataFrame:
    """S3: ragged 'sample_id,attr,attr,...' records -> (sample_id, attributes ARRAY<STRING>).

    Quoted cells may hold commas, quotes and line breaks; a file is read by all its splits
    (see `splits`). Records end with LF or CR LF; empty ones are skipped.
    """
    records = quoted_records(spark, path, "\n").select(F.regexp_replace("record", r"\r$", "").alias("record"))
    cells = records.where(F.length("record") > 0).select(csv_cells(F.col("record")).alias("cells"))
    return cells.select(F.get("cells", F.lit(0)).alias("sample_id"), F.slice("cells", F.lit(2), F.size("cells")).alias("attributes"))


def incidence_long(incidence: DataFrame) -> DataFrame:
    return incidence.select("sample_id", F.explode("attributes").alias("attribute")).withColumn("value", F.lit(None).cast("string"))


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # nullValue is set to a string that cannot occur so that an attribute named "NA" stays a name.
    return spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("mode", "FAILFAST").csv(path)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attributes.csv -> (attribute, frequency)."""
    return _csv(spark, path, "attribute STRING, frequency BIGINT")


def read_coexist(spark: SparkSession, path: str) -> DataFrame:
    """Coexistences.csv -> (attribute1, attribute2, totals)."""
    return _csv(spark, path, "attribute1 STRING, attribute2 STRING, totals BIGINT")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """coexistencesProb.csv -> (attribute1, attribute2, totals, exp, diff, weight)."""
    return _csv(spark, path, "attribute1 STRING, attribute2 STRING, totals BIGINT, exp DOUBLE, diff DOUBLE, weight DOUBLE")


# What stands between two commas outside strings: the start of an attribute's object, or of its
# last entry, or both, and closing braces.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_OPENING = rf"^[\s{{}}]*({_STRING})\s*:\s*\{{"
_ENTRY = rf"({_STRING})\s*:\s*(-?\d+)[\s}}]*$"


def _json_string(literal):
    return F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))


def read_value_counts(spark: SparkSession, path: str) -> DataFrame:
    """Nested {attribute: {value: count}} JSON -> attr_values(attribute, value, n).

    One object may fill a file of any size: it is cut at the commas outside its strings by all
    splits of the file, and the attribute of an entry is the last one opened before it, carried
    from split to split by one row each.
    """
    records = quoted_records(spark, path, ",", F.regexp_replace("value", r"\\.", ""))
    opened = F.regexp_extract("record", _OPENING, 1)
    entries = records.select(
        "file", "start", "at", F.when(opened != "", opened).alias("opened"),
        F.regexp_extract("record", _ENTRY, 1).alias("value"), F.regexp_extract("record", _ENTRY, 2).alias("n"),
    )
    splits = entries.groupBy("file", "start").agg(F.expr("max_by(opened, at) FILTER (WHERE opened IS NOT NULL)").alias("last"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "start", F.last("last", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("file", "start").orderBy("at")
    named = entries.withColumn("opened", F.last("opened", ignorenulls=True).over(so_far)).join(carried, ["file", "start"])
    return named.where("value != ''").select(
        _json_string(F.coalesce("opened", "carried")).alias("attribute"), _json_string(F.col("value")).alias("value"), F.col("n").cast("bigint").alias("n")
    )


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One term per line, blanks ignored -> distinct (word)."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where(F.length("word") > 0).distinct()
