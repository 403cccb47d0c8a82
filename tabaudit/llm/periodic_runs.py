"""Periodic runs of words: stretches that repeat with a period, found by descending common prefixes.

A run is a stretch of words with smallest period q, at least twice as long as
q, that no neighbouring word continues. If it begins at s and is L words long,
the suffixes at s and s + q share exactly L - q words, no fewer than q. So the
suffixes of a text are sorted by doubled ranks, and the suffix classes are
united by descending length of their common prefix: each class holds its
positions in order, and two positions that become neighbours at a distance
within that length seed a run. Any other position between them would give a
shorter period, so neighbours are enough and periods come out smallest; a seed
whose words just before differ is the run's begin.

A run of at least m words has a common prefix of m / 2 or more, so uniting
stops there, and texts without two equal strings of so many words aren't
sorted at all. Each row is worked alone in the task that reads it: nothing is
shuffled, whatever repeats. Memory grows with the longest text, by about 100
bytes a word.

Defined cases: a null or blank text has no words, no run and an empty rest;
repeated rows and ids are worked one by one, null ids too; other columns are
ignored; no row, no result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabaudit.llm.common import col, schema_of, slices

#: Words of the shortest run.
MIN_LENGTH = 12
#: Bytes of text that are sorted at once.
SLICE_BYTES = 4 << 20
RESULT = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

#: Gives (start, period) for ids and word counts: from that word on the text repeats its own period; period 0 leaves it.
Rewrite = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it a new key begins."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    return order, np.r_[True, found[1:] != found[:-1]] if len(found) else np.zeros(0, bool)


def repeated(words: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Owners in which some string of ``length`` words stands twice."""
    n = len(words) - length + 1
    if n < 2:
        return np.zeros(0, owner.dtype)
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(length):
            key = key * np.uint64(0xFF51AFD7ED558CCD) + mixed[k : k + n]
    inside = np.flatnonzero(owner[:n] == owner[length - 1 :])
    key = np.sort(key[inside]), key[inside]
    twice = np.unique(key[0][1:][key[0][1:] == key[0][:-1]])  # equal hashes: equal strings are among them
    return np.unique(owner[inside[np.isin(key[1], twice)]]) if len(twice) else np.zeros(0, owner.dtype)


def suffix_order(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all owners in order, and the ranks by their first 1, 2, 4, ... words.

    Ranks are the places where their groups begin; each round sorts only the
    groups that still hold several suffixes, by the rank that lies as many
    words further as are known already.
    """
    n = len(words)
    rank = np.empty(n, np.int64)
    order, begins = _dense(owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    levels, known = [rank.copy()], 1
    several = ~(begins & np.r_[begins[1:], True])
    while several.any():
        at = np.flatnonzero(several)
        held = order[at]
        further = held + known
        there = np.minimum(further, n - 1)
        after = np.where((further < n) & (owner[there] == owner[held]), rank[there] + 1, 0)
        by, begins = _dense(rank[held] * (n + 1) + after)
        order[at] = held[by]
        rank = rank.copy()
        rank[order[at]] = np.maximum.accumulate(np.where(begins, at, 0))
        several[at] = ~(begins & np.r_[begins[1:], True])
        known *= 2
        levels.append(rank)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the next one in order."""
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(left), np.int64)
    n = len(order)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        same = (left < n) & (right < n)
        same[same] = rank[left[same]] == rank[right[same]]
        step = same.astype(np.int64) << k
        shared, left, right = shared + step, left + step, right + step
    return shared


def seeds(left: np.ndarray, right: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """(position, distance, common prefix) of neighbours within their common prefix, classes united from the longest on."""
    by = np.argsort(-shared, kind="stable")
    edges = zip(left[by].tolist(), right[by].tolist(), shared[by].tolist())
    classes = {p: [p] for p in np.unique(np.r_[left, right]).tolist()}
    found: list[tuple[int, int, int]] = []
    for i, j, length in edges:
        large, small = classes[i], classes[j]
        if len(large) < len(small):
            large, small = small, large
        last = len(small) - 1
        before = -1
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at and large[at - 1] != before and p - large[at - 1] <= length:
                found.append((large[at - 1], p - large[at - 1], length))
            if at < len(large):
                follows = large[at]
                if follows - p <= length and (k == last or small[k + 1] > follows):
                    found.append((p, follows - p, length))
                large.insert(at, p)
            else:
                large.append(p)
            classes[p] = large
            before = p
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(words: np.ndarray, owner: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(begin, length, period) of all runs, by begin and period; ``words`` are numbers, ``owner`` ascends."""
    least = max(1, -(-min_length // 2))
    wanted = np.isin(owner, repeated(words, owner, least))
    where = np.flatnonzero(wanted)
    if not len(where):
        return np.zeros((0, 3), np.int64)
    words, owner = words[where], owner[where]
    order, levels = suffix_order(words, owner)
    shared = common_prefixes(order, levels)
    ends = np.r_[np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)]
    first, found = levels[0], [np.zeros((0, 3), np.int64)]
    for low, high in zip(np.r_[0, ends[:-1]], ends):  # the suffixes of one owner lie together, as its words do
        long = np.flatnonzero(shared[low : high - 1] >= least) + low
        seed = seeds(order[long], order[long + 1], shared[long])
        before = seed[:, 0] - 1
        begins = (seed[:, 0] == low) | (first[before] != first[before + seed[:, 1]])
        found.append(seed[begins & (seed[:, 1] + seed[:, 2] >= min_length)])
    start, period, shared = np.concatenate(found).T
    length = period + shared
    by = np.lexsort((period, start))
    return np.stack([where[start[by]], length[by], period[by]], axis=1)


def _lists(kind: pa.DataType, counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values).cast(pa.list_(kind))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: ``id``, ``n_words``, its ``runs`` by start and period, and ``collapsed``.

    ``collapsed`` has the words joined by one blank, without those that any
    run holds after its first period.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = pc.fill_null(batch.column("text"), "")
            parts = pc.ascii_split_whitespace(texts)
            flat, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            flat = flat.filter(pa.array(full))
            bounds = np.r_[0, np.cumsum(full)][ends]
            counts = np.diff(bounds)
            coded = flat.dictionary_encode()
            words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            if rewrite is not None:
                start, period = rewrite(batch.column("id"), counts)
                place = np.arange(len(words)) - bounds[owner]
                moved = (period[owner] > 0) & (place >= start[owner])
                a, p = start[owner[moved]], period[owner[moved]]
                source = np.arange(len(words))
                source[moved] = bounds[owner[moved]] + a + (place[moved] - a) % p
                words = words[source]
            runs = runs_of(words, owner, min_length)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            texts_kept = coded.dictionary.take(pa.array(words[kept]))
            sizes = np.bincount(owner[kept], minlength=len(counts))
            joined = pc.binary_join(_lists(pa.string(), sizes, texts_kept), " ")
            held = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
            values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[held]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(kind))
            listed = _lists(kind, np.bincount(held, minlength=len(counts)), values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts.astype(np.int64)), listed, joined], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(col(id_column).cast("long").alias("id"), col(text_column).alias("text"))
    return rows.mapInArrow(work, schema_of(RESULT))
