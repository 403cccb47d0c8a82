"""Approximate nearest neighbours by a permutation index.

Some vectors are pivots. A vector is represented by its nearest pivots in
order of distance, and posted in the inverted file of each of them with its
place in that order. A query goes through the files of its own pivots and
ranks what it finds by the footrule, the sum of differences of places, where a
pivot that one of both lacks counts as the last place. The best by footrule are
reranked by exact distance: a share of the block, and all that are so close by
footrule that only distances tell them apart.

Vectors are dealt into blocks of bounded size by a hash of the row, queries
into blocks too, and every pair of blocks is one group: it holds its part of
all inverted files and returns each query's nearest of the block, so no group
and no output grows beyond its blocks. Pivots are chosen to lie far apart from a
bounded sample, the distinct vectors with the least hashes; every row is indexed.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components takes no part, nor does one whose length isn't the most common one,
nor a null id; rows with the query's id are its own; of repeated query rows the
one with the least hash asks; repeated candidates rank one after the other, ties
go to the smaller id; without a valid row the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabaudit.llm.common import col

#: Pivots, the nearest of them that represent a vector, and the share of a block that is reranked.
PIVOTS, NEAREST, RERANKED, LEAST_RERANKED = 256, 96, 0.1, 100
#: Reranked besides: all whose footrule is below this share of the block's mean, as in a dense cluster.
CLOSE = 0.5
#: Distinct vectors sampled for each pivot.
SAMPLED = 4
#: Rows of a block of the index, and of queries.
BLOCK, QUERY_BLOCK = 8192, 1024


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def representation(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each vector in order; ties to the smaller number."""
    squares = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T  # the vector's own square changes no order
    return np.argsort(squares, axis=1, kind="stable")[:, :nearest]


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of the sample, each the farthest from those before it, so that no cluster gets many."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class InvertedFiles:
    """Per pivot the vectors that it represents, with its place in their order."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        n, self.nearest = order.shape
        pivot = order.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.begins = np.searchsorted(pivot[by_pivot], np.arange(pivots + 1))
        self.rows, self.places = by_pivot // self.nearest, (by_pivot % self.nearest).astype(np.int32)
        self.size = n

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of all vectors to one with this order of pivots."""
        last = self.nearest
        # without a common pivot, both sides' places count in full; a common one takes that back
        found = np.full(self.size, 2 * (last * (last + 1) // 2), np.int32)
        for place, pivot in enumerate(order):
            a, b = self.begins[pivot], self.begins[pivot + 1]
            there = self.places[a:b]
            found[self.rows[a:b]] += np.abs(there - place) - (last - place) - (last - there)
        return found


def valid(vector: Column) -> Column:
    """Whether a vector can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST, reranked: float = RERANKED, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the nearest found for rows where ``queries`` (of column ``id``) holds."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vector = col(vector_column).cast("array<double>")
    usable = table.select(col(id_column).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    common = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return empty
    dimension, rows = common
    usable = usable.where(F.size("vector") == dimension)
    # distinct vectors: copies of one would be one pivot many times
    sample = usable.groupBy(F.xxhash64("vector").alias("order")).agg(F.first("vector").alias("vector")).orderBy("order").limit(SAMPLED * pivots).collect()
    points = spread(np.array([r["vector"] for r in sample], np.float64), pivots)
    keep = min(nearest, len(points))
    asked = usable.where(queries).groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    n_asked = asked.count()
    if not n_asked:
        return empty
    blocks, query_blocks = -(-rows // block), -(-n_asked // query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = usable.select(F.lit(False).alias("asks"), "id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("part"), every(query_blocks).alias("query_part"))
    asking = asked.select(F.lit(True).alias("asks"), "id", "vector", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query_part"), every(blocks).alias("part"))
    cells = indexed.unionByName(asking)

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, vectors = group.column("id").to_numpy(), _matrix(group.column("vector"), dimension)
        own = np.flatnonzero(~asks)
        out: list[tuple[np.ndarray, ...]] = []
        if len(own):
            # equal vectors are one entry, so that copies don't crowd others out of the rerank
            entries, entry = np.unique(vectors[own], axis=0, return_inverse=True)
            by_entry = own[np.argsort(entry.ravel(), kind="stable")]
            begins = np.searchsorted(np.sort(entry.ravel()), np.arange(len(entries) + 1))
            files = InvertedFiles(representation(entries, points, keep), len(points))
            depth = max(LEAST_RERANKED, k, math.ceil(reranked * len(entries)))
            held, by_id = np.diff(begins), np.argsort(ids[own], kind="stable")
            sorted_ids = ids[own][by_id]
            which = np.flatnonzero(asks)
            for i, order in zip(which, representation(vectors[which], points, keep)):
                # entries that hold rows of the query's id alone take no place
                mine = by_id[np.searchsorted(sorted_ids, ids[i]) : np.searchsorted(sorted_ids, ids[i], "right")]
                others = np.flatnonzero(np.bincount(entry.ravel()[mine], minlength=len(entries)) < held)
                if not len(others):
                    continue
                footrule, reach = files.footrule(order)[others], min(depth, len(others))
                close = footrule < CLOSE * footrule.mean()
                close[np.argpartition(footrule.astype(np.int64) * len(entries) + np.arange(len(others)), reach - 1)[:reach]] = True
                best = others[close]
                score = np.sqrt(((entries[best] - vectors[i]) ** 2).sum(axis=1))
                last = min(k, len(score)) - 1
                order = np.flatnonzero(score <= np.partition(score, last)[last])  # the rows of the nearest k entries hold the nearest k rows
                best, score = best[order], score[order]
                low, n = begins[best], held[best]
                rows = by_entry[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.repeat(score, n)
                other = ids[rows] != ids[i]
                rows, score = rows[other], score[other]
                nearest_rows = np.lexsort((ids[rows], score))[:k]
                out.append((np.full(len(nearest_rows), ids[i]), ids[rows[nearest_rows]], score[nearest_rows]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    found = cells.groupBy("part", "query_part").applyInArrow(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
