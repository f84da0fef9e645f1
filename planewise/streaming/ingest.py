"""Checkpoints that keep arriving, as Structured Streaming queries over the batch operators.

An extension: the coded tables and statistics are those of the batch operators, fed by a stream of files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from planewise.operators import coding

TENSORS = "ckpt_id string, ts timestamp, ordinal long, name string, dtype string, raw binary"


def tensor_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of tensors (``TENSORS``) that land in a folder."""
    return spark.readStream.schema(TENSORS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def encode_stream(tensors: DataFrame, target: str, checkpoint: str, *, level: int = 3, effort: str = "balanced") -> StreamingQuery:
    """Code every tensor as it arrives; exactly once by the file sink's log.  A map without state or shuffle."""
    frames = coding.encode(tensors, level=level, effort=effort)
    return frames.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("ckpt_id").trigger(availableNow=True).start()


def plane_counts(tensors: DataFrame, width: int = 4, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(start, plane, byte, n): byte histograms of windows of arrival; late tensors up to the watermark count."""

    def kernel(row: dict) -> tuple:
        raw = row["raw"] or b""
        counts = [np.bincount(np.frombuffer(raw, np.uint8, len(raw) // width * width)[j::width], minlength=256) for j in range(width)]
        return ([{"plane": j, "byte": int(b), "n": int(n[b])} for j, n in enumerate(counts) for b in np.flatnonzero(n)],)

    each = coding.map_rows(tensors.select("ts", "raw"), "counts array<struct<plane:int,byte:int,n:bigint>>", kernel, ("raw",))
    flat = each.select("ts", F.inline("counts"))
    counted = flat.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "plane", "byte").agg(F.sum("n").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "plane", "byte", "n")


def seen_once(tensors: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tensors whose bytes have not arrived within the watermark before: tied weights across a stream of checkpoints."""
    keyed = tensors.withColumn("digest", F.sha2("raw", 256))
    return keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["digest"])


__all__ = ["TENSORS", "encode_stream", "plane_counts", "seen_once", "tensor_stream"]
