"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit fingerprint of its three-word shingles; fingerprints
that differ in at most three bits are linked, and linked documents form groups.

* Equal fingerprints are one vertex, so copies cost nothing further.
* Distances of 64-bit fingerprints crowd around 32, so pivot distances alone
  can't separate pairs without comparing all of them. Which fingerprints meet
  is therefore decided by blocks: of five blocks two are equal in any linked
  pair, which gives ten keys of 25 or 26 bits, and only keys that two distinct
  fingerprints share go on.
* Where fingerprints meet, the pivot table decides: distances to many fixed
  reference fingerprints are precomputed, pairs whose largest difference of
  coordinates exceeds the limit are discarded (triangle inequality, so no link
  is lost), and the survivors are verified by their differing bits.
* A key that very many fingerprints share is split: they are dealt into chunks
  and every pair of chunks is one task-sized cell. Cells return a spanning
  forest, never pairs.

Defined cases: a null text is an empty one; texts without words have
fingerprint zero and are linked like any other; texts of fewer words than a
shingle hash as a whole; a null id names a group only if there is no
other; equal rows are returned once each; no
row, no result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.llm.common import col, cut, fresh, slices
from tabaudit.llm.components import connected_components, forest

SHINGLE, SEED, MOST_BITS = 3, 42, 3
SLICE_BYTES = 4 << 20
#: Blocks of a fingerprint: (first bit, bits).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIVOTS = 16
#: Fingerprints in a chunk of a shared key.
CHUNK = 4096
_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.random.default_rng(7).integers(0, 1 << 63, (count, 2), dtype=np.uint64) @ np.array([1, 2], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text, as unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()  # splits at blanks and 09-0D
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(flat, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    begins = [0, *ends[: len(words) - shingle]]
    hashes = np.fromiter((xxh64_intdigest(flat[a : b - 1], seed) for a, b in zip(begins, ends[shingle - 1 :])), np.uint64, len(begins))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have; memory is bounded whatever their number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, seed: int = SEED, tag: Column | None = None) -> DataFrame:
    """(``id``, ``tag``, ``fingerprint``) of every row; the fingerprint as signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(found.view(np.int64))], names=["id", "tag", "fingerprint"])

    rows = docs.select(col(id_column).cast("long").alias("id"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"), col(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, tag long, fingerprint long")


def links_within(prints: np.ndarray, table: np.ndarray, most: int, others: np.ndarray | None = None, other_table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within ``prints``, or between them and ``others``, as their fingerprints.

    ``table`` has the pivot distances. Rows are compared in order of the first
    pivot, so each meets only those within the limit there; the largest
    coordinate difference discards, the differing bits verify.
    """
    own = others is None
    if own:
        others, other_table = prints, table
    order = np.argsort(other_table[:, 0], kind="stable")
    first = other_table[order, 0]
    low, high = np.searchsorted(first, table[:, 0] - most), np.searchsorted(first, table[:, 0] + most, "right")
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(others)))
    for at in range(0, len(prints), step):
        n = (high - low)[at : at + step]
        i = np.repeat(np.arange(at, min(at + step, len(prints))), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at : at + step], n)]
        if own:
            i, j = i[keep := i < j], j[keep]
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - other_table[j, p]) <= most
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(prints[i] ^ others[j]) <= most
        left.append(prints[i[near]])
        right.append(others[j[near]])
    return np.concatenate(left) if left else prints[:0], np.concatenate(right) if right else prints[:0]


def _cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the cells, whose rows follow each other."""
    reference = pivots()

    def edges(prints: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = np.bitwise_count(prints[:, None] ^ reference[None, :]).astype(np.int8)
        if side.any() and not side.all():
            a, b = links_within(prints[~side], table[~side], most, prints[side], table[side])
        else:
            a, b = links_within(prints, table, most)
        return forest(a.view(np.int64), b.view(np.int64))

    held: list[tuple[np.ndarray, ...]] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(c) for c in zip(*held)]
        key, cell, prints, side = rows
        borders = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
        begins, ends = np.r_[0, borders], np.r_[borders, len(key)]
        out = [edges(prints[a:b].view(np.uint64), side[a:b]) for a, b in zip(begins, ends) if b - a > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell, prints = (batch.column(c).to_numpy() for c in ("key", "cell", "fingerprint"))
        side = batch.column("second").to_numpy(zero_copy_only=False)
        if held and last != (key[0], cell[0]):
            yield from flush()
            held = []
        # what belongs to the last cell of the batch waits for the next one
        begin = len(key) - 1 - int(np.argmax(np.r_[(key[::-1] != key[-1]) | (cell[::-1] != cell[-1]), True])) + 1
        if begin > 0:
            held.append((key[:begin], cell[:begin], prints[:begin], side[:begin]))
            yield from flush()
            held = []
        held.append((key[begin:], cell[begin:], prints[begin:], side[begin:]))
        last = key[-1], cell[-1]
    if held:
        yield from flush()


def linked(prints: DataFrame, most: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct ``fingerprint`` values within ``most`` bits."""
    mask = lambda first, bits: F.shiftright("fingerprint", first).bitwiseAND(F.lit((1 << bits) - 1))
    pairs = list(itertools.combinations(BLOCKS, 2))
    keys = [mask(*a) + mask(*b) * (1 << a[1]) + F.lit(n << 40) for n, (a, b) in enumerate(pairs)]
    keyed = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key")
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("fingerprint"), chunks)
    # chunk i meets every chunk j: cell (smaller, larger); in its cells a row stands on the first or the second side
    cells = met.select("key", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    cell = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    dealt = cells.select("key", cell.alias("cell"), "fingerprint", (F.col("own") > F.col("other")).alias("second"))
    placed = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return placed.mapInArrow(lambda b: _cells(b, most), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MOST_BITS, tag: Column | None = None) -> DataFrame:
    """(``id``, ``tag``, ``fingerprint``, ``component``) of every row of ``docs``.

    ``fingerprint`` is a signed 64-bit number, ``component`` the smallest id
    that links reach, null where all of a group are null. ``tag`` is a number
    of the caller's for each row.
    """
    found = cut(fingerprints(docs, id_column, text_column, tag=tag))
    vertices = cut(found.groupBy("fingerprint").agg(F.min("id").alias("least")))
    groups = connected_components(linked(vertices.select("fingerprint"), most)).withColumnRenamed("vertex", "fingerprint")
    joined = vertices.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    named = joined.join(least, "component").select("fingerprint", F.col("component").alias("group"), F.col("smallest").alias("component"))
    return found.join(named, "fingerprint").select("id", "tag", "fingerprint", "component", "group")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MOST_BITS) -> DataFrame:
    """``docs`` without all rows but one of each group: the one with the smallest id.

    Rows that share this id are told apart by a hash of their columns; of equal
    rows one stays. Null ids are the largest.
    """
    hashed = F.xxhash64(*[col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    place, key, tag, chosen_tag = fresh(docs, "place_in_group", "kept_id", "row_tag", "kept_tag")
    first = W.partitionBy("group").orderBy(F.col("id").asc_nulls_last(), "tag")
    chosen = near_duplicates(docs, id_column, text_column, most, hashed).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    tagged = docs.withColumn(tag, hashed)
    same = col(id_column).cast("long").eqNullSafe(F.col(key)) & (F.col(tag) == F.col(chosen_tag))
    kept = tagged.join(chosen.select(F.col("id").alias(key), F.col("tag").alias(chosen_tag)), same, "left_semi")
    return kept.dropDuplicates([id_column, tag]).drop(tag)
