"""Connected components over an edge table: a local union-find in each partition, then large-star / small-star rounds.

Every round is joins and partial aggregates over edges; no group of edges is gathered in one task, so a hub with a third
of all edges is only a skewed join key. The labels are the smallest node ids.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stash, trimmed


def _local_union_find(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def forest():
        pairs = [(x, find(x)) for x in parent if find(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
            parent.setdefault(x, find(x))
            parent.setdefault(y, find(y))
        if len(parent) > 1_000_000:  # bounded memory: what is known so far goes out as a forest
            yield forest()
    yield forest()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node that has an edge. Self loops and null ends are ignored; an empty edge table gives
    an empty result."""
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    e = stash(e.mapInArrow(trimmed(_local_union_find), "u long, v long").distinct(), "edges")
    while True:
        # a forest of stars: each node has one parent, and no parent has one
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        many = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0")
        if many.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node points at its smaller neighbours; they and the node go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, e = e, stash(small, "edges")
        discard(old)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
