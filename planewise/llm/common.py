"""Session-level helpers the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: documents are long, and a task holds a few batches at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds; for sessions that still have Spark's default of 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_tuned: list[bool] = []


def _libc():
    """glibc's allocator controls, where there are any."""
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def trimmed(kernel: Callable) -> Callable:
    """An Arrow kernel that gives freed memory back: workers live on between tasks and would keep it.

    Large arrays get mappings of their own, and the heap is trimmed when a partition is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        if libc is not None and not _tuned:
            libc.mallopt(-8, 2)  # M_ARENA_MAX
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
            _tuned.append(True)
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="planewise-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_made: list[tuple[SparkSession, str]] = []
_collected = [0.0]
_EVERY_S = 10


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


@atexit.register
def _clean() -> None:
    """What ``written`` made goes when the driver's program ends: until then, results may still read it."""
    for spark, folder in _made:
        try:
            _delete(spark, folder)
        except Exception:  # the session's JVM may be gone before us
            return


#: While a table is written, partitions of a shuffle that Spark may coalesce reach this size, whatever the number of cores: fewer, larger files.
_COALESCE = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # a staged table's last join may be split by skew, too
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


@contextmanager
def _coalesced(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _COALESCE}
    for k, v in _COALESCE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _may_coalesce(spark: SparkSession) -> bool:
    return all(spark.conf.get(f"spark.sql.adaptive.{k}").lower() == "true" for k in ("enabled", "coalescePartitions.enabled"))


#: Bytes of a staged table that go to one file, and its files at least: Spark splits a skewed partition by the tasks that wrote to it.
_FILE_BYTES, _LEAST_FILES = 16 << 20, 8


@contextmanager
def _staged(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` in as few partitions as its size asks for, where Spark may not coalesce.

    All tasks of its plan run as they are and leave their rows on the executors' disks; only then the size is known.
    """
    level = df.storageLevel
    ours = not (level.useDisk or level.useMemory)
    if ours:
        df.persist(StorageLevel.DISK_ONLY)
    try:
        df.count()
        size = int(str(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        yield df.coalesce(max(_LEAST_FILES, -(-size // _FILE_BYTES)))
    finally:
        if ours:
            df.unpersist()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    Files are few: each one makes the JVM spawn about six processes in a local folder, and until such a process has started its
    program it counts for as much memory as the JVM.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/planewise-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    with _coalesced(spark), nullcontext(df) if _may_coalesce(spark) else _staged(df) as rows:
        rows.write.option("compression", "zstd").parquet(path)
    # the shuffles behind it are done with: unreachable plans let Spark's cleaner delete their files
    if time.monotonic() - _collected[0] > _EVERY_S:
        gc.collect()
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that nothing will read again."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pairs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as (doc_id long, text string); other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: str, folds: int):
    """crc32 of the id as decimal text, modulo the number of folds; a null id counts as 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(folds))
