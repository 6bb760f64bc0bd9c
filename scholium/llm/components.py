"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut


def forest(i: np.ndarray, j: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Roots after the links i-j are added to parent, the roots so far; a root is the least place of its tree."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's links (a, b) -> (u, v): each node of them with the least that it reaches by them, if that is another."""
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if sum(len(a) for a, _ in links):
        ends = [np.concatenate(x) for x in zip(*links)]
        nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
        root = forest(place[: len(ends[0])], place[len(ends[0]) :], np.arange(len(nodes)))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node that each node of an edge reaches.

    Self-loops and repeated or reversed edges are allowed, nulls are dropped, no edges give no rows. Each partition's edges are
    first drawn together to stars, which shortens paths and leaves an edge for each of its nodes at most. Rounds then go on
    until every node has one edge, to a node that has none; they grow with the logarithm of the longest path. Each is two grouped minima, combined before the shuffle,
    and two joins of the edges with one row a node: a hub's edges go to one partition of such a join, which Spark streams
    past that one row and, as any skewed join, splits among tasks. Every round is checkpointed.
    """
    links = edges.dropna(subset=["a", "b"]).where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    stars = cut(links.mapInArrow(_contracted, "u long, v long").distinct())
    while True:
        twice = stars.groupBy("u").count().where("count > 1").select("u")
        inner = stars.select(F.col("v").alias("u")).distinct().join(stars.select("u"), "u", "left_semi")
        if twice.unionAll(inner).isEmpty():
            break
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
