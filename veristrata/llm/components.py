"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links (16 bytes each) that one task may unite; beyond, rounds over partitioned tables give the same components.
ONE_TASK = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its larger (or smaller) neighbours to the smallest node that it knows."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(low, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links of one task; the smallest node names a component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(links: DataFrame, name: str = "components", most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it can reach.

    Every round's edges are written to the shared folder; the driver gets a count and a checksum per round. The
    number of edges never grows. Null ends and links of a node with itself are left out.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def state(e: DataFrame) -> tuple:
        return tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    if before[0] <= one_task:
        return materialize(edges.coalesce(1).mapInArrow(_unite, "node long, component long"), name)
    for _ in range(most_rounds):
        edges = materialize(_star(_star(edges, True), False), name)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
