"""Tables the queries start from: the driver's Parquet files, read as tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import bits
from planewise.operators import elements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pos, u): the float32 elements of ``embeddings``."""
    return elements.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def emb_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, us): the same, a vector a row."""
    return elements.patterns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def emb_rect_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return emb_arrays(spark, sf_dir).withColumn("us", F.transform("us", lambda u: F.when(bits.sign(u, bits.SPECS["float32"]) == 0, u).otherwise(zero)))


def emb_snapshot_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = lambda pos: (F.col("vec_id") * 64 + pos) % 20 == 0
    return emb_arrays(spark, sf_dir).withColumn("us", F.transform("us", lambda u, pos: F.when(changed(pos), u.bitwiseXOR(F.lit(1).cast("long"))).otherwise(u)))


def emb_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative elements made zero: a tensor pruned by half."""
    return emb(spark, sf_dir).withColumn("u", F.when(bits.sign(F.col("u"), bits.SPECS["float32"]) == 0, F.col("u")).otherwise(F.lit(0).cast("long")))


def emb_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next checkpoint: every 20th element has its lowest bit flipped."""
    changed = (F.col("vec_id") * 64 + F.col("pos")) % 20 == 0
    return emb(spark, sf_dir).withColumn("u", F.when(changed, F.col("u").bitwiseXOR(F.lit(1).cast("long"))).otherwise(F.col("u")))


def docs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, raw): texts as opaque byte tensors."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").cast("binary").alias("raw"))


def docs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, dtype, raw): the base checkpoint."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.lit("U8").alias("dtype"), F.col("text").cast("binary").alias("raw"))


def docs_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, dtype, raw): a fine-tuned checkpoint with copied, changed, longer, added and dropped tensors."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = d.where("doc_id % 50 != 0").select(F.col("doc_id").alias("name"), F.expr("CASE WHEN doc_id % 10 = 3 THEN concat('~', substr(text, 2)) WHEN doc_id % 10 = 7 THEN concat(text, '!') ELSE text END").alias("text"))
    new = d.where("doc_id % 100 = 5").select((F.col("doc_id") + 1000000).alias("name"), "text")
    return kept.union(new).select("name", F.lit("U8").alias("dtype"), F.col("text").cast("binary").alias("raw"))


def described(tensors: DataFrame) -> DataFrame:
    """(name, dtype, length, digest): the index of a checkpoint without its payload."""
    return tensors.select("name", "dtype", F.octet_length("raw").cast("long").alias("length"), F.sha2("raw", 256).alias("digest"))


def docs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, name, kind, ref, frame_len): documents deduplicated; a frame's stored length is its text's."""
    from planewise.operators import container

    raw = docs_raw(spark, sf_dir)
    kinds = container.dedup(raw)
    lengths = raw.select("ordinal", F.octet_length("raw").cast("long").alias("n"))
    return kinds.join(lengths, "ordinal").select("ordinal", F.concat(F.lit("tensor."), F.col("ordinal").cast("string")).alias("name"), "kind", "ref", F.when(F.col("kind") == "FRAME", F.col("n")).otherwise(F.lit(0)).cast("long").alias("frame_len"))


#: DuckDB fragments of the same fixtures.
EMB = "(SELECT vec_id, p - 1 AS pos, (embedding[p]::FLOAT::BIT)::INTEGER::BIGINT & 4294967295 AS u FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"
EMB_RECT = f"(SELECT vec_id, pos, CASE WHEN u >> 31 = 0 THEN u ELSE 0 END AS u FROM {EMB})"
EMB_SNAPSHOT = f"(SELECT vec_id, pos, CASE WHEN (vec_id * 64 + pos) % 20 = 0 THEN xor(u, 1) ELSE u END AS u FROM {EMB})"
DOCS_TARGET = """(SELECT doc_id AS name, CASE WHEN doc_id % 10 = 3 THEN '~' || substr(text, 2) WHEN doc_id % 10 = 7 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 50 <> 0
 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 100 = 5)"""
DOCS_INDEX = """(SELECT doc_id AS ordinal, 'tensor.' || doc_id AS name, CASE WHEN first = doc_id THEN 'FRAME' ELSE 'REF' END AS kind, CASE WHEN first <> doc_id THEN first END AS ref, CASE WHEN first = doc_id THEN strlen(text) ELSE 0 END::BIGINT AS frame_len
 FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents))"""
