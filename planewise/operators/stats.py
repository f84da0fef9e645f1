"""Histograms, entropies and coder models as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, *keys: str) -> DataFrame:
    """(keys..., total, symbols, bits): order-0 entropy in bits a symbol from a histogram with column ``n``.

    One aggregate: H = log2(N) - sum(n log2 n) / N.
    """
    n = F.col("n").cast("double")
    return hist.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("symbols"), (F.log2(F.sum("n")) - F.sum(n * F.log2(n)) / F.sum("n")).alias("bits"))


def joint_histogram(df: DataFrame, partition: list[str], order: list[str], symbol: str) -> DataFrame:
    """(prev, cur, n): pairs of neighbours; the context before a partition's first element is 0."""
    prev = F.lag(symbol, 1, 0).over(Window.partitionBy(*partition).orderBy(*order))
    return df.select(prev.alias("prev"), F.col(symbol).alias("cur")).groupBy("prev", "cur").agg(F.count("*").alias("n"))


def conditional_entropy(joint: DataFrame) -> DataFrame:
    """(total, contexts, bits): order-1 entropy in bits a symbol."""
    n = F.col("n").cast("double")
    rows = joint.groupBy("prev").agg(F.sum("n").alias("c"), F.sum(n * F.log2(n)).alias("s"))
    c = F.col("c").cast("double")
    return rows.agg(F.sum("c").alias("total"), F.count("*").alias("contexts"), (F.sum(c * F.log2(c) - F.col("s")) / F.sum("c")).alias("bits"))


def segment(pos: Column, length: Column, count: int = 4) -> Column:
    """Which of ``count`` segments a place is in; segment s starts at floor(length * s / count)."""
    return F.floor((pos * count + (count - 1)) / length).cast("long") if count == 1 else sum((pos >= F.floor(length * s / count)).cast("long") for s in range(1, count))


def frequencies(hist: DataFrame, symbol: str, *keys: str, bits: int = 14) -> DataFrame:
    """(keys..., symbol, n, freq): counts scaled to a sum of 2**bits.

    At least 1 each; what rounding leaves over (or lacks) goes to the largest bin, ties to the smallest symbol.
    """
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = 1 << bits
    scaled = hist.withColumn("f", F.greatest(F.lit(1), F.floor(F.col("n") * total / F.sum("n").over(by))).cast("long"))
    first = F.row_number().over(by.orderBy(F.desc("f"), F.desc("n"), symbol)) == 1
    rest = F.lit(total) - F.sum("f").over(by)
    return scaled.select(*keys, symbol, "n", (F.col("f") + F.when(first, rest).otherwise(0)).cast("long").alias("freq"))


def cumulative(freqs: DataFrame, symbol: str, *keys: str) -> DataFrame:
    """Adds ``cum``: the sum of the frequencies of smaller symbols."""
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(symbol).rowsBetween(Window.unboundedPreceding, 0)
    return freqs.withColumn("cum", F.sum("freq").over(by) - F.col("freq"))
