"""Connected components of an edge table, by alternating stars.

Every round hooks each vertex to smaller neighbours (large star, small star)
until nothing changes; both are joins and grouped minima, so a vertex of any
degree is handled by partial aggregation. The rounds grow with the logarithm of
the longest chain. Each round is kept in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import cut


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for all vertices that aren't smallest themselves."""
    vertices, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    root = np.arange(len(vertices))
    while True:
        # hook the larger root to the smaller, then shorten all paths
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if np.array_equal(low, high):
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(root, shorter := root[root]):
            root = shorter
    own = root != np.arange(len(vertices))
    return vertices[own], vertices[root[own]]


def _contract(edges: DataFrame) -> DataFrame:
    """A spanning star per component of each partition's edges; the components stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(``vertex``, ``component``) for every vertex of ``edges`` (longs ``a``, ``b``): the smallest vertex reachable."""
    larger = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    state = cut(_contract(edges.select(*larger).where("a <> b")).distinct())
    while True:
        # large star: all larger neighbours of a vertex go to its smallest neighbour (or itself)
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: all smaller neighbours of a vertex, and it, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        following = cut(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        if following.count() == state.count() and following.exceptAll(state).isEmpty():
            break
        state = following
    return state.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
