"""Sharding by extendible hashing.

A row's place is a 60-bit hash of its key.  The directory is indexed by leading bits: a bucket over
the byte limit is split on the next bit, others are left alone, until each shard fits.  Bytes are
summed per directory cell by Spark (pre-aggregated before the shuffle), ``step`` bits at a time, and only
the cells still too large are looked at more closely in the next round.

Rows that share all 60 bits cannot be split by them; such a bucket is split by a second hash, of
the row's own text, in the same way.  What remains over the limit are rows equal in both, or one row larger
than the limit: ``oversize`` marks their shard.

Contract: a null key or text hashes as a value of its own and null text has no bytes; repeated rows stay
together; the shards of a table do not depend on its partitions; an empty table gives an empty result.
Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import remove, written

BITS = 60
LIMIT = 16 << 20


def _hash60(c: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 digest as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("\x00null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({h}, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col(h), F.lit(BITS) - depth)


def directory(sizes: DataFrame, limit: int, step: int = 8) -> DataFrame:
    """(prefix, depth, bytes, rows): the leaves of the directory for rows (h, bytes)."""
    leaves = None
    open_ = sizes.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    depth = 0
    while True:
        # sums at depth + step, then at each depth above it from those below
        deep = min(BITS, depth + step)
        cells = written(open_.groupBy(_prefix("h", deep).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "cells")
        levels = None
        for d in range(depth, deep + 1):
            level = cells.groupBy(F.expr(f"shiftright(cell, {deep - d})").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).withColumn("depth", F.lit(d))
            levels = level if levels is None else levels.union(level)
        levels = written(levels, "levels")
        remove(cells)
        big = levels.where(F.col("bytes") > limit).select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("depth"))
        parent = levels.withColumn("up", F.expr("shiftright(prefix, 1)"))
        # a leaf fits (or has no bits left) and its parent does not; the first round's root has no parent
        top = levels.where(F.col("depth") == depth) if depth == 0 else levels.where("false")
        split = parent.where(F.col("depth") > depth).join(big, ["up", "depth"], "left_semi").select(*levels.columns)
        ends = top.union(split).where((F.col("bytes") <= limit) | (F.col("depth") == BITS)).select("prefix", "depth", "bytes", "rows")
        leaves = ends if leaves is None else leaves.union(ends)
        still = levels.where((F.col("depth") == deep) & (F.col("bytes") > limit)).select(F.col("prefix").alias("cell"))
        if deep == BITS or not still.limit(1).count():
            return leaves
        open_ = open_.join(still, _prefix("h", deep) == F.col("cell"), "left_semi")
        depth = deep


def _assigned(rows: DataFrame, leaves: DataFrame, h: str, names: list[str]) -> DataFrame:
    """Rows with their leaf: joined at each depth that occurs, all of them in one equi-join on (depth, prefix)."""
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    places = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(h, d).alias("prefix")) for d in depths))) if depths else F.explode(F.array().cast("array<struct<depth:int,prefix:long>>"))
    wide = rows.withColumn("place", places).withColumns({"depth": F.col("place.depth"), "prefix": F.col("place.prefix")}).drop("place")
    return wide.join(leaves, ["depth", "prefix"]).select(*rows.columns, *names)


def shard_documents(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard_id, depth, shard_bytes, shard_rows, oversize) of every row; ``shard_id`` spells the prefix bits, then those of the second hash after a dot."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(key_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), _hash60(F.col(key_col)).alias("h"), _hash60(text).alias("h2"))
    sizes = rows.select("h", "bytes", F.lit(1).cast("long").alias("rows"))
    leaves = directory(sizes, limit)
    leaves = leaves.select("prefix", "depth", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    placed = _assigned(rows, leaves, "h", ["prefix", "depth", "shard_bytes", "shard_rows"])
    spelled = lambda p, d: F.when(F.col(d) == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(p).cast("string"), 10, 2), F.col(d), F.lit("0")))
    fits = placed.where(F.col("shard_bytes") <= limit).select("doc_id", "bytes", spelled("prefix", "depth").alias("shard_id"), "depth", "shard_bytes", "shard_rows")
    full = leaves.where(F.col("shard_bytes") > limit)
    if full.limit(1).count():  # keys alike in all bits
        hot = placed.where(F.col("shard_bytes") > limit).select("doc_id", "bytes", "h", "h2", F.expr(f"shiftright(h, 0)").alias("first"))
        second = directory(hot.select(F.col("h2").alias("h"), "bytes", F.lit(1).cast("long").alias("rows")), limit)
        second = second.select("prefix", "depth", F.col("bytes").alias("b2"), F.col("rows").alias("r2"))
        again = _assigned(hot, second, "h2", ["prefix", "depth", "b2", "r2"])
        # several such keys may share a leaf of the second hash; each is then a shard of its own
        sums = again.groupBy("first", "prefix", "depth").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
        again = again.drop("b2", "r2").join(sums, ["first", "prefix", "depth"])
        name = F.concat(F.lpad(F.conv(F.col("first").cast("string"), 10, 2), F.lit(BITS), F.lit("0")), F.lit("."), spelled("prefix", "depth"))
        fits = fits.union(again.select("doc_id", "bytes", name, F.lit(BITS) + F.col("depth"), "shard_bytes", "shard_rows"))
    return fits.select("doc_id", F.col("bytes").alias("n_bytes"), "shard_id", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"))
