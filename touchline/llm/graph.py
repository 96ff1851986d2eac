"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import lookup_join, written

#: Nodes whose edges a task contracts at a time, about: bounds its dictionary, whatever the size of a partition.
FOREST = 200_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars with the same components: per FOREST nodes every node once, with the smallest it reaches there."""
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        while (up := parent.get(n, n)) != n:
            parent[n] = parent.get(up, up)
            n = up
        return n

    def stars() -> pa.RecordBatch:
        roots = [find(n) for n in parent]
        return pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array(roots, pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, two = find(u), find(v)
            if one != two:
                parent[max(one, two)] = min(one, two)
        if len(parent) >= FOREST:
            yield stars()
            parent.clear()
    yield stars()


def _contracted(edges: DataFrame, name: str) -> DataFrame:
    """Each partition's edges as stars. Written, as a recomputed partition may cut other stars from the same edges."""
    return written(edges.select("u", "v").mapInArrow(_forests, "u long, v long"), name)


def _unsettled(edges: DataFrame) -> DataFrame:
    """(node, least, kids): nodes with a smaller neighbour, the least, that have a second one or larger ones (kids)."""
    one, none = F.lit(1), F.lit(0)
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("up"), none.alias("kid")),
        F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up"), one.alias("kid")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.sum("kid").alias("kids"))
    return nodes.where("least IS NOT NULL AND (kids > 0 OR least < most)").select("node", "least", "kids")


def _large_star(edges: DataFrame, unsettled: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (or the node)."""
    least = unsettled.where("kids > 0").withColumnRenamed("node", "v")
    return lookup_join(edges, least, "v", "kids", "left").select("u", F.coalesce("least", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. Edges come as u > v, contracted: a node has as many as there are stars at most."""
    grouped = edges.groupBy("u").agg(F.collect_set("v").alias("near")).withColumn("least", F.array_min("near"))
    least = F.col("least")
    pairs = F.transform("near", lambda v: F.struct(F.when(v == least, F.col("u")).otherwise(v).alias("u"), least.alias("v")))
    return grouped.select(F.inline(pairs))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: longs); the root is a component's smallest node.

    Rounds shrink every component towards a star, in a number that grows with the logarithm of
    its size. Each step of a round is a written table of few exchanges: the driver holds plans, threads and
    task records of what a round exchanges and broadcasts, and of its rows it sees whether any are left to settle.
    """
    current = _contracted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while not (unsettled := written(_unsettled(current), "unsettled")).isEmpty():
        current = written(_small_star(_contracted(_large_star(current, unsettled), "large-stars")), "stars")
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return current.select(F.inline(ends)).groupBy("node").agg(F.min("root").alias("root"))
