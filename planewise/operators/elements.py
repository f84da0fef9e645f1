"""Element views of tables: one row an element, ``u`` its bit pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.functions import bits


def from_vectors(df: DataFrame, key: str, vectors: str) -> DataFrame:
    """(key, pos, u) of a column of float32 arrays."""
    return df.select(key, F.posexplode(bits.f32_array_bits(F.col(vectors))).alias("pos", "u")).select(key, F.col("pos").cast("long").alias("pos"), "u")


def patterns(df: DataFrame, key: str, vectors: str) -> DataFrame:
    """(key, us): the patterns of each array of float32 in one row, which stays one row in what follows."""
    return df.select(key, bits.f32_array_bits(F.col(vectors)).alias("us"))


def split(us: Column, width: int) -> Column:
    """The byte planes of an array of patterns: an array of ``width`` arrays."""
    def plane(j: int) -> Column:
        return F.transform(us, lambda u: F.shiftrightunsigned(u, 8 * j).bitwiseAND(F.lit(255)))

    return F.array(*map(plane, range(width)))


def join(planes_: Column) -> Column:
    """The inverse of ``split``, inside the row."""
    def one(i: Column) -> Column:
        return F.aggregate(F.reverse(F.transform(planes_, lambda p: F.get(p, i))), F.lit(0).cast("long"), lambda u, byte: F.shiftleft(u, 8).bitwiseOR(byte))

    n = F.size(F.get(planes_, F.lit(0)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def planes(df: DataFrame, u: str, width: int, *keep: str) -> DataFrame:
    """(keep..., plane, byte): each pattern split into its byte planes."""
    return df.select(*keep, F.posexplode(bits.byte_planes(F.col(u), width)).alias("plane", "byte"))


def columns_as_tensors(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(tensor, u) of several columns in one scan."""
    each = F.array(*(F.struct(F.lit(name).alias("tensor"), u.alias("u")) for name, u in columns.items()))
    return df.select(F.inline(each)).where(F.col("u").isNotNull())
