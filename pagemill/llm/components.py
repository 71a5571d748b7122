"""Connected components of a distributed edge table (union-find grouping at scale).

Every partition first runs a union-find over its own edges, which leaves at most
one edge per node it saw; alternating large-star and small-star rounds then join
the partitions' forests. Minima are aggregated map-side, hot nodes only meet in
joins that adaptive execution can split, and the driver only learns each round
whether all components are stars.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, stored


def _forest(batches):
    """Edges of a partition to (node, root) edges of its union-find forest, flushed when it holds many nodes."""
    schema = arrow_schema("u long, v long")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        parent.clear()
        return batch(schema, [p[0] for p in pairs], [p[1] for p in pairs])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 1_000_000:
            yield flush()
    yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges``' two long columns; component is its smallest node.

    Nodes without an edge to another node are not returned. Nulls and loops are
    ignored, repeated edges are harmless, an empty table gives an empty result.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    e = e.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = stored(e.mapInArrow(_forest, "u long, v long"), "edges")
    if not e.take(1):
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are tables of their own: the join can split a hot node only if neither side is aggregated in its stage
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")), "minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "stars")
        # stars: every node has one centre, and no centre has one itself
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up")).distinct())
        if not roles.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").take(1):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
