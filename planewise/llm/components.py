"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import remove, trimmed, written

_LOCAL_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node) that connect what the edges of a bounded number of rows connect."""
    held: list[pa.RecordBatch] = []

    def solve() -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = parent[x]
            return x

        for b in held:
            for u, v in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                a, z = root(u), root(v)
                if a != z:
                    parent[max(a, z)] = min(a, z)
        held.clear()
        stars = [(x, root(x)) for x in list(parent)]
        stars = [(x, r) for x, r in stars if x != r]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in stars], np.int64)), pa.array(np.array([r for _, r in stars], np.int64))], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _LOCAL_EDGES:
            yield from solve()
    if held:
        yield from solve()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the smallest of its component, with that smallest node.

    A union-find over blocks of at most ``_LOCAL_EDGES`` edges leaves a forest of each. The forests of
    several blocks are joined by alternating large-star and small-star until nothing changes; each
    round is a written table.
    """
    given = written(edges.select("u", "v").where("u != v"), "edges")
    blocks = -(-given.count() // _LOCAL_EDGES) or 1
    dealt = given.repartition(blocks, "u") if blocks > 1 else given.repartition(1)
    now = written(dealt.mapInArrow(trimmed(_forest), "u long, v long"), "edges")
    remove(given)
    if blocks == 1:
        return now
    sums = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    mark = sums(now)
    while mark[0]:
        new = written(_small_star(_large_star(now)), "edges")
        last, mark = mark, sums(new)
        remove(now)
        now = new
        if mark == last:
            break
    return now
