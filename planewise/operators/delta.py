"""Deltas: element-wise XOR of two tensors, and the relation of two checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def xor(current: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., u): the patterns that differ in, by a positional equi-join."""
    other = reference.select(*keys, F.col("u").alias("r"))
    return current.join(other, keys).select(*keys, F.col("u").bitwiseXOR(F.col("r")).alias("u"))


def xor_arrays(current: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """(keys..., us): arrays of patterns XORed place by place; tensors or chunks are joined, never their elements.

    Arrays of unlike length are no pair (the gate of the delta codec) and are left out.
    """
    other = reference.select(*keys, F.col("us").alias("rs"))
    joined = current.join(other, list(keys)).where(F.size("us") == F.size("rs"))
    return joined.select(*keys, F.zip_with("us", "rs", lambda a, b: a.bitwiseXOR(b)).alias("us"))


def classify(target: DataFrame, base: DataFrame) -> DataFrame:
    """(name, kind, length): COPY if name, type and bytes are equal, DELTA if name, type and length are, else FULL.

    Both tables have (name, dtype, length, digest): the index decides, no payload is moved.
    """
    other = base.select("name", F.col("dtype").alias("bd"), F.col("length").alias("bl"), F.col("digest").alias("bh"))
    same = (F.col("dtype") == F.col("bd")) & (F.col("length") == F.col("bl"))
    kind = F.when(same & (F.col("digest") == F.col("bh")), "COPY").when(same, "DELTA").otherwise("FULL")
    return target.join(other, "name", "left").select("name", kind.alias("kind"), "length")


def dropped(target: DataFrame, base: DataFrame) -> DataFrame:
    """Tensors of the base that the target no longer has."""
    return base.join(target.select("name"), "name", "left_anti")


def added(target: DataFrame, base: DataFrame) -> DataFrame:
    return target.join(base.select("name"), "name", "left_anti")
