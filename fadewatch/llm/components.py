"""Connected components of a graph of links, by joins and small forests inside tasks."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Nodes of a forest that a task keeps before it passes it on.
FOREST = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is named by its smallest node.

    A round links every larger neighbour of a node to the smallest neighbour (large star), then brings the edges of a node
    together by its larger end and links what they connect to its smallest node (small star and more). A task makes such
    forests of its edges before it sends any, so a node with very many links reaches another task once from each. Edges
    only move to smaller nodes and never become more; the rounds end when no node has two smaller neighbours or one on
    either side.
    """
    given = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    edges = staged(_small_star(given))
    while not _ends(edges).filter("up > 1 OR up > 0 AND down > 0").isEmpty():
        edges = staged(_small_star(_large_star(edges)))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select("u", "u").distinct())


def _ends(edges: DataFrame) -> DataFrame:
    """(node, low, up, down): the smallest of a node and its neighbours; whether and how often it is a larger or a smaller end."""
    both = edges.select(F.col("v").alias("node"), F.col("u").alias("low"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("u", "u", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.min("low").alias("low"), F.sum("up").alias("up"), F.max("down").alias("down"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    return edges.join(_ends(edges).select(F.col("node").alias("u"), "low"), "u").select("v", F.col("low").alias("u"))


def _small_star(edges: DataFrame) -> DataFrame:
    """What the edges of a node's larger end connect is linked to its smallest node."""
    return _forests(_forests(edges).repartition("v").sortWithinPartitions("v"))


def _forests(edges: DataFrame) -> DataFrame:
    """The edges of a task as stars around the smallest nodes; edges of one ``v`` that follow each other are in one forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        last = None

        def find(k: int) -> int:
            while (up := top.setdefault(k, k)) != k:
                top[k] = top[up]
                k = up
            return k

        def stars() -> pa.RecordBatch:
            rows = [(k, root) for k in list(top) if (root := find(k)) != k]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["v", "u"])

        for batch in batches:
            for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(top) > FOREST and v != last:
                    yield stars()
                    top.clear()
                last = v
                a, b = find(v), find(u)
                if a != b:
                    top[max(a, b)] = min(a, b)
        if top:
            yield stars()

    return edges.select("v", "u").mapInArrow(run, "v bigint, u bigint")
