"""Connected components of an edge table by alternating large and small stars, as written tables; nothing goes to the driver but two sums."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _joined(batches):
    """Union-find over all edges of one task."""
    parent: dict[bytes, bytes] = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    own = [(x, root(x)) for x in parent]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, y in own if x != y], pa.binary()), pa.array([y for x, y in own if x != y], pa.binary())], ["node", "label"])


def components(tables: Tables, edges: DataFrame, rounds: int = 60, small: int = 200_000) -> DataFrame:
    """edges(a, b) -> (node, label): label is the smallest node that can be reached; nodes that are their own label are left out. Loops and
    repeated edges are allowed. A table of at most `small` edges, by count, is settled in one task; a larger one by rounds of stars."""
    ab = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ab = tables.save(ab, "edges")
    if ab.count() <= small:
        return ab.coalesce(1).mapInArrow(_joined, "node binary, label binary")
    before = None
    for _ in range(rounds):
        both = ab.select(F.col("a").alias("u"), F.col("b").alias("v")).union(ab.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each edge now goes from a larger to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        after = tables.save(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        tables.drop(ab)
        ab = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return ab.select(F.col("b").alias("node"), F.col("a").alias("label"))
