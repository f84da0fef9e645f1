"""Running sums over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


LEAST, MOST = 256, 1 << 16


def exclusive_sums(df: DataFrame, order: str, sums: dict[str, str], buckets: int | None = None, per_bucket: int = 1_000_000) -> DataFrame:
    """Adds for each ``{new: column}`` the sum of the column over rows of smaller ``order`` (a unique whole number).

    Two levels: equal ranges of the order are summed (``buckets``, or one range for ``per_bucket`` rows, but from ``LEAST`` to ``MOST`` of them,
    whose running sums are cheap), and each range runs on from there by itself.
    """
    edges = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("rows"))
    ranges = F.lit(buckets) if buckets else F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(F.col("rows") / per_bucket)))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / ranges))
    placed = df.join(F.broadcast(edges), how="cross").withColumn("bucket", F.floor((F.col(order) - F.col("lo")) / width).cast("long")).drop("lo", "hi", "rows")
    totals = placed.groupBy("bucket").agg(*(F.sum(c).alias(f"{new}_all") for new, c in sums.items()))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("bucket", *(F.coalesce(F.sum(f"{new}_all").over(before), F.lit(0)).alias(f"{new}_base") for new in sums))
    inside = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(bases), "bucket")  # at most MOST rows
    for new, c in sums.items():
        out = out.withColumn(new, (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{new}_base")).cast("long"))
    return out.drop("bucket", *(f"{new}_base" for new in sums))
