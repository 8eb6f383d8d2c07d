"""Registered queries of the corpus operators: each applies its operator, with
production parameters, to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.llm import bpe, decontaminate, html_text, language_id, line_dedup, merkle, ngram_jaccard, quality, secrets
from attrmill.llm import token_files, toxicity, warc, whitening
from attrmill.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = language_id.predict(docs, model)
    return out.select(F.col("doc_id").cast(kind), held_out.alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join_components(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, files)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.character_model(docs)
    rules = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, rules, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = warc.write_archives(table(spark, sf_dir, "pages"), least=0)
    return warc.read_archives(spark, places).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = (
        op1_language_id, op2_ngram_jaccard_join, op3_decontamination, op4_secret_scan, op5_quality_rules,
        op6_html_extraction, op7_bpe, op8_token_files, op9_toxicity, op10_warc,
        op11_merkle_manifest, op12_embedding_whitening, op13_line_dedup,
    )
    return {f.__name__: f for f in fns}


def _sql_field(field: str) -> str:
    text = f"CAST({field} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 by its definition: a shift register over the bytes (decimal digits here) with the reversed polynomial.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(c)::BIGINT for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

_SQL_PARENTS = "[sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')) for i in range((len(nodes) + 2) // 3)]"

_SQL_MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN ({_SQL_CRC}) % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents),
lv AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, {_SQL_PARENTS} FROM lv WHERE len(nodes) > 1),
subs AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM lv WHERE len(nodes) = 1),
tl AS (
  SELECT 0 AS level, list(subroot ORDER BY spos) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, {_SQL_PARENTS} FROM tl WHERE len(nodes) > 1),
steps AS (
  SELECT d.doc_id, 0 AS part, lv.level, d.pos // CAST(pow(3, lv.level) AS BIGINT) AS p, lv.nodes
  FROM leaves d JOIN lv ON lv.source IS NOT DISTINCT FROM d.source WHERE len(lv.nodes) > 1
  UNION ALL
  SELECT d.doc_id, 1, tl.level, s.spos // CAST(pow(3, tl.level) AS BIGINT), tl.nodes
  FROM leaves d JOIN subs s ON s.source IS NOT DISTINCT FROM d.source, tl WHERE len(tl.nodes) > 1),
sided AS (
  SELECT doc_id, part, level, array_to_string(nodes[p - p % 3 + 1 : p], '') AS before,
         array_to_string(nodes[p + 2 : p - p % 3 + 3], '') AS after FROM steps),
paths AS (
  SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY part, level)) AS proof,
         list([before, after] ORDER BY part, level) AS path FROM sided GROUP BY doc_id),
out AS (
  SELECT d.doc_id, d.leaf, s.subroot, (SELECT nodes[1] FROM tl WHERE len(nodes) = 1) AS root,
         coalesce(x.proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend([d.changed, ''], coalesce(x.path, [])), lambda a, b: [sha256(b[1] || a[1] || b[2]), ''])[1] AS folded_root
  FROM leaves d JOIN subs s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN paths x ON x.doc_id = d.doc_id)
SELECT *, folded_root = root AS verified FROM out"""

_SQL_LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
found AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS lost FROM keyed k LEFT JOIN found f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count_if(lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """Twins of the operators that SQL expresses (see tests/llm for brute-force versions of all)."""
    return {"op11_merkle_manifest": _SQL_MERKLE, "op13_line_dedup": _SQL_LINE_DEDUP}
