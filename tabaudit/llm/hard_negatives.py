"""Hard negatives by Kronecker-packed products.

Rows hold vectors of integers. A row's score is its inner product with an
anchor. An anchor's positives are its best other rows of the same label; a
hard negative of a positive is a row of another label whose score lies within
a band below the positive's.

Several candidates' components are biased until none is negative and laid side
by side into fields of one wide integer, so that one product with an anchor's
component, also biased, serves them all; fields are wide enough for the sum
over all components, so they never carry into each other and unpack to exact
scores. Where a field has 26 bits or fewer, wide integers of 53 bits are the
whole numbers of a double, and a matrix product does the work; wider ones are
Python integers that hold a whole block.

Candidates are worked in the tasks that read them, in blocks; anchors are kept
as a table in the shared folder, of which each task reads a slice at a time.
Only the best of each block and anchor are shuffled, and merged per anchor, so
neither a label nor an anchor gathers more rows than blocks times the number
wanted. The first pass finds the positives, the second their negatives.

Defined cases: a row with a null id, label or vector, or with a null or
non-finite component takes no part, nor does one whose vector isn't of the most
common length (ties: the shorter); rows of the anchor's id are its own and
neither positive nor negative; of repeated anchor rows the one with the least
hash asks; other repeated rows count one by one; without a valid row the
result is empty. Scores that might not fit 64 bits are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabaudit.llm.common import col, open_store, schema_of, shared_folder

POSITIVES, NEGATIVES = 5, 10
#: The band of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Candidates of a block, anchors of a slice, and anchors of a file.
BLOCK, SLICE, ANCHOR_FILE = 1 << 14, 128, 1 << 16
#: Bits of the whole numbers that a double holds exactly.
_EXACT = 53


class Packed:
    """The vectors of a block in fields of wide integers; no component may exceed ``bias`` in size."""

    def __init__(self, vectors: np.ndarray, bias: int) -> None:
        self.n, self.dimension = vectors.shape
        self.bias = bias
        self.sums = vectors.sum(axis=1)
        self.bits = max(1, (self.dimension * 4 * bias * bias).bit_length())
        self.fields = _EXACT // self.bits
        raised = vectors + bias
        if self.fields:
            raised = np.concatenate([raised, np.zeros((-self.n % self.fields, self.dimension), np.int64)])
            parts = raised.reshape(-1, self.fields, self.dimension)
            self.wide = (parts << (self.bits * np.arange(self.fields))[None, :, None]).sum(axis=1).astype(np.float64).T.copy()
        else:
            self.columns = [int.from_bytes(c.astype("<u8").tobytes(), "little") for c in raised.T]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of all anchors (rows) with all vectors of the block (columns)."""
        raised = anchors + self.bias
        if self.fields:
            total = (raised.astype(np.float64) @ self.wide).astype(np.int64)
            fields = [(total >> (self.bits * f)) & ((1 << self.bits) - 1) for f in range(self.fields)]
            unpacked = np.stack(fields, axis=2).reshape(len(anchors), -1)[:, : self.n]
        else:
            sums = [sum(a * c for a, c in zip(row, self.columns)) for row in raised.tolist()]
            unpacked = np.stack([np.frombuffer(s.to_bytes(8 * self.n + 8, "little"), "<u8", self.n) for s in sums]).view(np.int64)
        taken = self.bias * (anchors.sum(axis=1)[:, None] + self.sums[None, :]) + self.dimension * self.bias**2
        return unpacked - taken


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties by place."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def within(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score of a negative for a positive of this score."""
    return -(-low * score // 100), high * score // 100


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _slices(folder: str, size: int) -> Iterator[pa.RecordBatch]:
    """The stored anchors, some at a time."""
    store, root = open_store(folder)
    for file in sorted(f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            yield from pq.ParquetFile(source).iter_batches(size)


def _scored(dimension: int, bias: int, folder: str, block: int, pick: Callable, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``pick(ids, labels, scores, anchors, place)`` for every block of candidates and every anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))
            ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            packed = Packed(_matrix(rows.column("vector").combine_chunks(), dimension), bias)
            for anchors in _slices(folder, SLICE):
                scores = packed.scores(_matrix(anchors.column("vector"), dimension))
                found = [part for i in range(len(scores)) for part in pick(ids, labels, scores[i], anchors, i)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names=names)

    return work


def _store(df: DataFrame, name: str, rows: int) -> str:
    path = shared_folder(df.sparkSession, name)
    df.repartition(max(1, -(-rows // ANCHOR_FILE))).write.parquet(path)
    return path


def mine(table: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """Negatives of each positive of the rows where ``anchors`` (of column ``id``) holds.

    Returns ``anchor_id``, ``positive_rank``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score``, ``negative_score``.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_rank int, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    vector = col(vector_column).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = table.select(col(id_column).cast("long").alias("id"), col(label_column).cast("long").alias("label"), vector.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    largest = F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("largest")
    # a row for each length of vectors
    common = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), largest).orderBy(F.desc("rows"), "n").first()
    if common is None:
        return empty
    dimension, bias = common["n"], math.floor(SCALE * common["largest"]) + 1 if common["largest"] < 2.0**40 else 1 << 48
    if dimension * bias * bias >= 1 << 62:
        raise ValueError(f"scores of vectors with components of {common['largest']:g} may exceed 64 bits")
    whole = rows.where(F.size("vector") == dimension).select("id", "label", F.transform("vector", lambda x: F.floor(x * SCALE)).alias("vector"))
    asking = whole.where(anchors).groupBy("id").agg(F.min_by(F.struct("label", "vector"), F.xxhash64("label", "vector")).alias("own")).select("id", "own.*")
    n_asking = asking.count()
    if not n_asking:
        return empty
    asked = _store(asking, "anchors", n_asking)

    def positive(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, asks: pa.RecordBatch, i: int) -> list[tuple[np.ndarray, ...]]:
        own = asks.column("id")[i].as_py()
        same = np.flatnonzero((labels == asks.column("label")[i].as_py()) & (ids != own))
        top = same[best(scores[same], positives)]
        return [(np.full(len(top), own), ids[top], scores[top])] if len(top) else []

    by_block = whole.mapInArrow(_scored(dimension, bias, asked, block, positive, ["anchor_id", "id", "score"]), schema_of("anchor_id long, id long, score long"))
    ranked = by_block.withColumn("rank", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= positives)
    banded = ranked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    banded = spark.read.parquet(asked).join(banded, F.col("id") == F.col("anchor_id")).select("anchor_id", "label", "vector", "positives")
    paired = _store(banded, "positives", n_asking)

    def negative(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, asks: pa.RecordBatch, i: int) -> list[tuple[np.ndarray, ...]]:
        own = asks.column("anchor_id")[i].as_py()
        wanted = [(p["rank"], p["id"], p["score"], *within(p["score"], low, high)) for p in asks.column("positives")[i].as_py()]
        least, most = min(w[3] for w in wanted), max(w[4] for w in wanted)
        other = np.flatnonzero((scores >= least) & (scores <= most) & (labels != asks.column("label")[i].as_py()) & (ids != own))
        other = other[np.argsort(-scores[other], kind="stable")]
        falling, out = -scores[other], []
        for rank, positive_id, score, floor, top in wanted:
            begin = np.searchsorted(falling, -top)
            end = min(np.searchsorted(falling, -floor, "right"), begin + negatives)
            if begin < end:
                n, chosen = end - begin, other[begin:end]
                out.append((np.full(n, own), np.full(n, rank), np.full(n, positive_id), np.full(n, score), ids[chosen], scores[chosen]))
        return out

    names = ["anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = whole.mapInArrow(_scored(dimension, bias, paired, block, negative, names), schema_of(", ".join(f"{n} long" for n in names)))
    order = W.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    chosen = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.select("anchor_id", F.col("positive_rank").cast("int").alias("positive_rank"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
