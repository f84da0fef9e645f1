"""The driver's queries over the operators of this subpackage: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.llm import fingerprint, html_text, langid, ngram_join, packing, quality, rules, sharding, spm, substring
from planewise.llm.common import fold, small_batches

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_table(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract_text(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "removed")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return done.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), removed.alias("n_removed"), "removed_spans")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spm.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), compare=True)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "chunks", "exact")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.train(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: All pairs of documents by shared shingles, and the closure of their links.
_NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words
), sizes AS (
  SELECT doc_id, count(g) AS n FROM words LEFT JOIN grams USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * n_both >= 85 * (s.n + t.n - n_both)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT doc_id, n::BIGINT AS n_shingles, min(other)::BIGINT AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""

#: The leaf of a document is its shallowest directory cell that fits the limit.
_SHARD_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), cells AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS b, count(*) AS r FROM d, range(0, 40) t(depth) GROUP BY 1, 2
), leaf AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(depth) AS depth FROM d JOIN cells c ON c.prefix = d.h >> (60 - c.depth) WHERE c.b <= {SHARD_BYTES} GROUP BY 1, 2, 3
)
SELECT doc_id, n_bytes, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(prefix), leaf.depth::INTEGER, '0') END AS shard_id, leaf.depth::INTEGER AS depth, b AS shard_bytes, r::BIGINT AS shard_rows, false AS oversize
FROM leaf JOIN cells ON cells.depth = leaf.depth AND cells.prefix = leaf.h >> (60 - leaf.depth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": _NGRAM_SQL, "op9_sharding": _SHARD_SQL}
