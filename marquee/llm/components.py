"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60  # each round shortens paths by half or more, so this is an alarm and not a limit
ONE_TASK = 50_000  # links that one task joins; more take rounds of shuffles


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        kinds = None

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def known(x):
            root.setdefault(x, x)
            return find(x)

        for batch in batches:
            kinds = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((known(u), known(v)))
                root[b] = a
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), kinds), pa.array([find(x) for x in root], kinds)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(links: DataFrame, one_task: int | None = None) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``: the smallest node that can be reached.

    Up to ``one_task`` distinct links are joined by one task; the rounds that follow are for any number of them.

    Large star: every node's larger neighbours are tied to its smallest neighbour. Small star: every node and its smaller
    neighbours are tied to the smallest of them. Both keep the components, and shorten all paths until only stars are left.
    Node counts per step are those of the links; nothing is collected. Each round is a stored table.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = size(edges)
    if before.n <= (ONE_TASK if one_task is None else one_task):
        return _in_one_task(edges)
    for _ in range(ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stored(small, "components")
        now = size(after)
        if now == before:
            break
        edges, before = after, now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    members = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
