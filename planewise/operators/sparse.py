"""Sparse coding: a bitmap of the non-zero places and the dense values.

Zero means all bits zero, so -0.0 is not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planewise.functions.bits import packed_byte

WIDTHS = (1, 2, 4, 8)
THRESHOLD = 0.10


def sparsity(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys..., total, zeros, share)."""
    zeros = F.sum((F.col("u") == 0).cast("long"))
    return elements.groupBy(*keys).agg(F.count("*").alias("total"), zeros.alias("zeros"), (zeros / F.count("*")).alias("share"))


def gate(elements: DataFrame, *keys: str, threshold: float = THRESHOLD) -> DataFrame:
    """Exact: (keys..., total, zeros, share, fires)."""
    return sparsity(elements, *keys).withColumn("fires", F.col("share") >= threshold)


def bitmap(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys..., byte_no, byte): bit 7 - i of a byte is set if element i of its eight is not zero."""
    return elements.groupBy(*keys, F.floor(F.col("pos") / 8).cast("long").alias("byte_no")).agg(packed_byte((F.col("u") != 0).cast("int"), F.col("pos")).alias("byte"))


def dense_values(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys..., rank, u): the non-zero patterns in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    return elements.where("u != 0").select(*keys, rank.cast("long").alias("rank"), "u")


def encode_arrays(us: Column) -> tuple[Column, Column]:
    """(bitmap bytes, dense values) of an array of patterns, inside the row."""
    byte = lambda i: F.aggregate(F.slice(us, i * 8 + 1, F.lit(8)), F.struct(F.lit(0).cast("long").alias("byte"), F.lit(7).alias("bit")), lambda a, u: F.struct((a["byte"] + F.when(u != 0, F.call_function("shiftleft", F.lit(1).cast("long"), a["bit"])).otherwise(F.lit(0))).alias("byte"), (a["bit"] - 1).alias("bit")), lambda a: a["byte"])
    count = F.ceil(F.size(us) / 8).cast("int")
    bitmap_ = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), byte)).otherwise(F.array().cast("array<bigint>"))
    return bitmap_, F.filter(us, lambda u: u != 0)


def decode_arrays(bitmap_: Column, dense: Column, size: Column) -> Column:
    """The inverse of ``encode_arrays``: places of set bits take the dense values in order, the others zero; one sort inside the row, no window."""
    flag = lambda i: F.call_function("shiftright", F.get(bitmap_, (i / 8).cast("int")), F.lit(7) - F.pmod(i, F.lit(8))).bitwiseAND(F.lit(1))
    at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0).cast("long")
    full = F.zip_with(F.filter(at, lambda i: flag(i) == 1), dense, lambda i, u: F.struct(i.alias("i"), u.alias("u")))
    empty = F.transform(F.filter(at, lambda i: flag(i) == 0), lambda i: F.struct(i.alias("i"), zero.alias("u")))
    return F.transform(F.array_sort(F.concat(full, empty)), lambda x: x["u"])


def decode(bitmap_: DataFrame, dense: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """(keys..., pos, u) from the bitmap, the dense values and the number of elements (keys..., size)."""
    bits = bitmap_.select(*keys, "byte_no", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    flags = bits.select(*keys, (F.col("byte_no") * 8 + F.col("i")).alias("pos"), F.call_function("shiftright", F.col("byte"), F.lit(7) - F.col("i")).bitwiseAND(F.lit(1)).alias("flag"))
    flags = flags.join(sizes, list(keys)).where("pos < size").drop("size")
    rank = F.sum("flag").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    placed = flags.withColumn("rank", F.when(F.col("flag") == 1, F.coalesce(rank, F.lit(0))))
    return placed.join(dense, [*keys, "rank"], "left").select(*keys, "pos", F.coalesce("u", F.lit(0)).cast("long").alias("u"))
