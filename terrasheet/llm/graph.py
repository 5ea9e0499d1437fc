"""Connected components of links, on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rounds after which components must be settled: their number grows with the logarithm of the longest path. Else an error.
ROUNDS = 60


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links (a, b) as a forest of depth one: (node, least node that its links reach)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.array([x for x in parent if parent[x] != x], np.int64)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.array([root(x) for x in part.tolist()], np.int64))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a long, b long) whose component isn't their own id: the least id reachable.

    Each partition's links become a forest by union-find; then nodes take their neighbours' least node, first all their
    larger neighbours (large star), then themselves and their smaller neighbours (small star), until nothing changes.
    Each round is written to the shared folder, so that the plan doesn't grow.
    """
    edges = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(union_find, "a long, b long").distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.toDF("node", "component")
        before = state
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = stored(small.select("e.u", "e.m").where("u <> m").distinct().toDF("a", "b"), "links")
    raise RuntimeError(f"components still change after {ROUNDS} rounds")
