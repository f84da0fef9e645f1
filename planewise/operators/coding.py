"""Tensor tables coded and decoded by kernels that Spark maps over rows.

A row is one tensor or one chunk of it; rows are independent, so tasks need no shuffle and a lost one
is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from planewise.functions import codec

#: Rows of one Arrow batch that are coded before results go out; payloads are large, so few.
_ROWS = 64


#: Rows and bytes of an Arrow batch that a worker holds.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's 10,000 rows a batch, of whatever size, for sessions that still have them: rows here are tensors."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    held = spark.conf.get(size).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def map_rows(df: DataFrame, added: str, kernel: Callable[[dict], tuple], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``added`` (DDL) that ``kernel`` makes of each row."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    new = T.StructType.fromDDL(added).fields
    kinds = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in kept] + [f.name for f in new]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                made = [kernel(row) for row in part.to_pylist()]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[f.name] for f in kept), *cols], names=names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(tensors: DataFrame, *, level: int = 3, effort: str = "balanced", auto: bool = True) -> DataFrame:
    """(…, raw, dtype) to (…, dtype, codec, orig_len, comp_len, payload)."""

    def kernel(row: dict) -> tuple:
        frame = codec.compress(row["raw"] or b"", dtype=row["dtype"], level=level, effort=effort, auto=auto)
        return codec.info(frame)["kind"], len(row["raw"] or b""), len(frame), frame

    return map_rows(tensors, "codec string, orig_len long, comp_len long, payload binary", kernel, ("raw",))


def decode(frames: DataFrame) -> DataFrame:
    """(…, payload) to (…, raw); a damaged payload fails the query."""
    return map_rows(frames, "raw binary", lambda row: (codec.decompress(row["payload"]),), ("payload",))


def quarantine(frames: DataFrame) -> DataFrame:
    """(…, payload) to (…, payload, error): null where the payload decodes; for reading what is sound of a damaged store."""

    def kernel(row: dict) -> tuple:
        try:
            codec.decompress(row["payload"])
        except ValueError as e:
            return (str(e),)
        return (None,)

    kept = map_rows(frames, "error string", lambda row: (kernel(row)[0] or "",))
    return kept.withColumn("error", F.nullif("error", F.lit("")))


def chunks(tensors: DataFrame, size: int = 16 << 20) -> DataFrame:
    """(…, raw) to (…, chunk_no, raw): rows of at most ``size`` bytes (a multiple of every element width)."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length("raw") - 1), F.lit(size))
    cut = tensors.select(*(c for c in tensors.columns if c != "raw"), F.posexplode(starts).alias("chunk_no", "at"), "raw")
    return cut.withColumn("raw", F.substr("raw", (F.col("at") + 1).cast("int"), F.lit(size))).drop("at")


def join_chunks(parts: DataFrame, *keys: str) -> DataFrame:
    """The inverse of ``chunks``."""
    joined = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "raw"))).alias("parts"))
    # spelt and unspelt: linear in the bytes, where a running concatenation copies them again for each chunk
    return joined.select(*keys, F.unhex(F.concat_ws("", F.transform("parts", lambda x: F.hex(x["raw"])))).alias("raw"))


def encode_delta(pairs: DataFrame, *, level: int = 3) -> DataFrame:
    """(…, raw, base, dtype) to (…, kind, payload): COPY, or the smaller of DELTA and FULL; ``base`` is null where the base has no such tensor."""

    def kernel(row: dict) -> tuple:
        raw, base = row["raw"] or b"", row["base"]
        if base == raw:
            return "COPY", b""
        full = codec.compress(raw, dtype=row["dtype"], level=level)
        if base is not None and len(base) == len(raw):
            d = codec.delta_compress(raw, base, dtype=row["dtype"], level=level)
            if len(d) < len(full):
                return "DELTA", d
        return "FULL", full

    return map_rows(pairs, "kind string, payload binary", kernel, ("raw", "base"))


def decode_delta(records: DataFrame) -> DataFrame:
    """(…, kind, payload, base) to (…, raw)."""

    def kernel(row: dict) -> tuple:
        if row["kind"] == "COPY":
            return (row["base"],)
        return (codec.delta_decompress(row["payload"], row["base"]) if row["kind"] == "DELTA" else codec.decompress(row["payload"]),)

    return map_rows(records, "raw binary", kernel, ("payload", "base"))


def size_summary(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys..., tensors, original_bytes, compressed_bytes, ratio, saved_pct)."""
    orig, comp = F.sum("orig_len"), F.sum("comp_len")
    return frames.groupBy(*keys).agg(F.count("*").alias("tensors"), orig.alias("original_bytes"), comp.alias("compressed_bytes"), F.round(orig / comp, 4).alias("ratio"), F.round(100 * (1 - comp / orig), 2).alias("saved_pct"))
