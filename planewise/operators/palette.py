"""Palette coding: a codebook of distinct patterns and a dense index into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planewise.functions.bits import unsigned_key

MOST = 256


def gate(elements: DataFrame, *keys: str, most: int = MOST) -> DataFrame:
    """(keys..., total, distinct, fires): few enough distinct patterns for a palette.

    Counted by grouping, which combines on the map side and has no distinct expansion.
    """
    distinct = elements.groupBy(*keys, "u").agg(F.count("*").alias("n"))
    return distinct.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values")).withColumn("fires", F.col("distinct_values") <= most)


def codebook(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys..., u, n, idx): patterns numbered from 0 in unsigned order."""
    distinct = elements.groupBy(*keys, "u").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return distinct.withColumn("idx", F.dense_rank().over(by.orderBy(unsigned_key(F.col("u")))) - 1)


def books(book: DataFrame, *keys: str) -> DataFrame:
    """(keys..., us): the codebook of each tensor as one array in the order of ``idx``; at most 256 patterns by the gate."""
    return book.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "u"))).alias("e")).select(*keys, F.transform("e", lambda x: x["u"]).alias("book"))


def encode(elements: DataFrame, book: DataFrame, *keys: str) -> DataFrame:
    """Elements with ``idx`` for ``u``, looked up in their tensor's codebook.

    One row a tensor is joined, which Spark broadcasts under its own size check (2 KiB a tensor), so elements do not move.
    """
    return elements.join(books(book, *keys), list(keys)).withColumn("idx", (F.array_position("book", F.col("u")) - 1).cast("int")).where("idx >= 0").drop("u", "book")


def decode(indexed: DataFrame, book: DataFrame, *keys: str) -> DataFrame:
    return indexed.join(books(book, *keys), list(keys)).withColumn("u", F.get("book", F.col("idx"))).drop("idx", "book")
