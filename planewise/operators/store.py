"""Checkpoints as two tables in a folder: ``frames`` with the payloads and ``index`` without them.

Writing is one map over the tensors: each row is coded where it is read, and digests alone are compared afterwards.  Bytes that
a task has coded before are not coded again; of frames coded by several tasks the index names one.
Reading filters the index first, and only frames it names are read and decoded.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import checkpoint, codec
from planewise.operators import coding

_FRAMES = "ordinal long, name string, dtype string, orig_len long, digest string, codec string, comp_len long, payload binary"
#: Names up to which the frames they need are found by the scan's own filter, not by a join.
PUSHED = 1000
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that goes at the end of the program; on one machine (tests) a temporary one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="planewise-")
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/planewise-{name}-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return folder


@atexit.register
def _clean() -> None:
    for spark, folder in _made:
        try:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # the session's JVM may be gone before us
            return


def write(tensors: DataFrame, folder: str, *, level: int = 3, effort: str = "balanced") -> None:
    """(ordinal, name, dtype, raw) to ``folder/frames`` and ``folder/index``.

    The index has (ordinal, name, dtype, kind, ref, source, codec, orig_len, comp_len, digest): a REF is equal, by SHA-256 and length,
    to the FRAME of the smallest ordinal; ``source`` is the row of ``frames`` that holds the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made: list[list] = [[] for _ in range(5)]
                for dtype, raw in zip(part[2].to_pylist(), part[3], strict=True):
                    data = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                    key = hashlib.sha256(data).digest()
                    kind, payload = None, None
                    if key not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(key)
                        payload = codec.compress(data, dtype=checkpoint.codec_dtype(dtype), level=level, effort=effort)
                        kind = codec.info(payload)["kind"]
                    for col, v in zip(made, (len(data), key.hex(), kind, len(payload) if payload else None, payload), strict=True):
                        col.append(v)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["ordinal", "name", "dtype", "orig_len", "digest", "codec", "comp_len", "payload"])

    spark = tensors.sparkSession
    coding.bounded_batches(spark)
    rows = tensors.select(F.col("ordinal").cast("long").alias("ordinal"), "name", F.upper("dtype").alias("dtype"), "raw")
    rows.mapInArrow(run, _FRAMES).write.parquet(f"{folder}/frames")
    coded = spark.read.schema(_FRAMES).parquet(f"{folder}/frames")
    small = coded.select("ordinal", "name", "dtype", "orig_len", "digest", "codec", "comp_len")
    held = F.col("codec").isNotNull()
    first = small.groupBy("digest", "orig_len").agg(F.min("ordinal").alias("first"), F.min(F.when(held, F.struct("ordinal", "codec", "comp_len"))).alias("frame"))
    same = small.select("ordinal", "name", "dtype", "orig_len", "digest").join(first, ["digest", "orig_len"])
    frame = F.col("first") == F.col("ordinal")
    index = same.select(
        "ordinal", "name", "dtype", F.when(frame, "FRAME").otherwise("REF").alias("kind"), F.when(~frame, F.col("first")).alias("ref"), F.col("frame.ordinal").alias("source"),
        F.when(frame, F.col("frame.codec")).otherwise("ref").alias("codec"), "orig_len", F.when(frame, F.col("frame.comp_len")).otherwise(F.lit(0)).alias("comp_len"), "digest",
    )
    index.write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """(ordinal, name, raw), of all tensors or those named: the index is filtered in its scan, and so are the frames where names are few."""
    wanted = index(spark, folder)
    frames = spark.read.schema(_FRAMES).parquet(f"{folder}/frames").where("payload IS NOT NULL")
    if names is not None:
        wanted = wanted.where(F.col("name").isin(names))
        if len(names) <= PUSHED:
            sources = [r.source for r in wanted.select("source").distinct().limit(PUSHED + 1).collect()]
            if len(sources) <= PUSHED:
                frames = frames.where(F.col("ordinal").isin(sources))
    frames = frames.select(F.col("ordinal").alias("source"), "payload")
    return coding.decode(wanted.select("ordinal", "name", "source").join(frames, "source")).select("ordinal", "name", "raw")
