"""The relational side of a checkpoint container: tied tensors, references, offsets, contiguity, look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planewise.operators.ordered import exclusive_sums


def fingerprint(raw: Column, size: int = 512) -> list[Column]:
    """Length and digests of the head, middle and tail: candidates for equality, never the proof."""
    length = F.octet_length(raw)
    part = lambda at: F.md5(F.substr(raw, at.cast("int"), F.lit(size)))
    return [length.alias("length"), part(F.lit(1)).alias("head"), part(F.floor(length / 2) + 1).alias("middle"), part(F.greatest(F.lit(1), length - size + 1)).alias("tail")]


def dedup(tensors: DataFrame) -> DataFrame:
    """(ordinal, digest, kind, ref): the first of equal tensors is a FRAME, the others are REFs to it.

    ``tensors`` has (ordinal, raw binary). Equality is by SHA-256 of all bytes and their length; the smallest ordinal
    comes from a pre-aggregated group, so a digest of very many tensors meets nowhere as rows but in the join, which Spark can split.
    """
    keyed = tensors.select("ordinal", F.sha2("raw", 256).alias("digest"), F.octet_length("raw").alias("length"))
    first = keyed.groupBy("digest", "length").agg(F.min("ordinal").alias("first"))
    kind = F.when(F.col("first") == F.col("ordinal"), "FRAME").otherwise("REF")
    return keyed.join(first, ["digest", "length"]).select("ordinal", "digest", kind.alias("kind"), F.when(F.col("first") != F.col("ordinal"), F.col("first")).alias("ref"))


def resolve(index: DataFrame) -> DataFrame:
    """Index rows with the frame their bytes are in: a REF has that of the row it refers to."""
    frames = index.where("kind = 'FRAME'").select(F.col("ordinal").alias("source"), F.col("frame_offset").alias("o"), F.col("frame_len").alias("n"))
    source = F.coalesce("ref", "ordinal")
    return index.withColumn("source", source).join(frames, "source", "left").select("ordinal", "kind", "source", F.col("o").alias("frame_offset"), F.col("n").alias("frame_len"))


def frame_offsets(frames: DataFrame, order: str = "ordinal", length: str = "frame_len") -> DataFrame:
    """Adds ``frame_offset``, the running sum of the lengths before."""
    return exclusive_sums(frames, order, {"frame_offset": length})


def contiguity(index: DataFrame, data_len: Column | None = None) -> DataFrame:
    """(ckpt_id, tensors, data_len, contiguous): whether tensors tile the data exactly; rows have (ckpt_id, begin, end)."""
    w = Window.partitionBy("ckpt_id").orderBy("begin", "end")
    steps = index.withColumn("ok", F.col("begin") == F.lag("end", 1, 0).over(w))
    return steps.groupBy("ckpt_id").agg(F.count("*").alias("tensors"), F.max("end").alias("data_len"), F.bool_and("ok").alias("contiguous"))


def best_of(candidates: DataFrame, *keys: str) -> DataFrame:
    """The smallest candidate (codec, size, priority) of each key, ties to the lowest priority."""
    return candidates.groupBy(*keys).agg(F.min_by(F.struct("codec", "size"), F.struct("size", "priority")).alias("best")).select(*keys, "best.codec", "best.size")


def store_guard(comp_len: Column, orig_len: Column) -> Column:
    """Compressed only if strictly smaller."""
    return F.when(comp_len < orig_len, F.lit("CODED")).otherwise(F.lit("STORE"))
