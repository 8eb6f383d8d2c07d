"""Training-corpus pipeline over `documents`: five stages, each one operator.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; each result is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.llm import bpe, decontaminate, ngram_jaccard, secrets, toxicity
from attrmill.llm.catalog import tokenizer_path
from attrmill.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.character_model(docs)
    rules = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")), model)
    return toxicity.drop_toxic(docs, rules, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the row with the smallest doc_id (of repeated
    rows one); documents without words or without an id are no copies and stay."""
    members = ngram_jaccard.join_components(docs)
    drop = members.filter("n_shingles > 0 and doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    return kept.dropDuplicates()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    text = F.col("text").cast("binary").alias("_text")
    marked = decontaminate.mark_occurrences(docs.select(*docs.columns, text), table(spark, sf_dir, "benchmark"))
    return marked.filter("_hits is null").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of all documents."""
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", encode),
]

#: Learned scores, connected components and BPE have no SQL form; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, name)
    return docs
