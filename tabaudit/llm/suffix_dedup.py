"""Exact removal of repeated 100-byte strings, by suffix arrays of content shards.

A byte goes if a string of ``window`` bytes covers it that also starts
earlier: in a document with a smaller id, or earlier in the same one. Ids may
repeat; equal ids are in order of a digest of their texts, nulls come last.

1. Equal texts are one document, the first; of the others every byte goes (if
   they are as long as a window).
2. Texts get places in one long virtual sequence, by prefix sums. Each window
   is represented by its anchor, the 32-byte string in it with the least
   hash, the first of equals. Equal windows have equal anchors at equal
   offsets, so anchors that occur once are done.
3. Occurrences of the other anchors, with the bytes of the windows that they
   represent, are dealt to shards by the anchor. A shard sorts the suffixes
   that start at its anchors, and the reversed prefixes that end there, by
   Larsson-Sadakane refinement: groups that are equal so far are sorted by what
   follows, single ones leave. With the common prefixes of neighbours in both
   arrays, a window at offset ``o`` is known by its class of ``window - o`` bytes
   to the right and ``o`` to the left; all but the first of a class are marked.
4. An anchor that very many places share is cut into several shards; windows
   that are first in theirs are merged across shards by binary search in the
   sorted digests of windows.

Sorting the suffixes of anchors alone, about one in 35, is what keeps this
within a few sorts of the repeated text; a common prefix of sampled suffixes is
compared outright, since Kasai's step from a suffix to the next needs all of
them.

Defined cases: a null text is empty; texts shorter than the window stay; equal
rows count as one after the other; no row, no result; other columns are
ignored. Texts are shuffled once, by a key of id and digest; where rows repeat,
one of each is kept before that, by partial aggregation and a shuffle more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabaudit.llm.common import col, cut

WINDOW, GRAM = 100, 32
#: Occurrences of an anchor in one shard, and occurrences sorted at a time.
SHARD = 32_768
BATCH = 16_384
#: Windows hashed at a time; positions within fit below the hash in a number.
STEP = 1 << 17
_POSITION_BITS = 20
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes (a power of two) of ``data``."""
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
    h, length, factor = table[data], 1, 0x9E3779B97F4A7C15
    while length < gram:
        h = h[:-length] * np.uint64(factor) + h[length:]
        factor = factor * factor % (1 << 64)
        length *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values that follow each other."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie in ``data`` from ``offsets[i]`` to ``offsets[i + 1]``.

    Returns text number, hash, position in the text, and how far the first and
    the last window that it represents start before it.
    """
    width, out = window - gram + 1, []
    starts, ends = offsets[:-1], offsets[1:]
    for begin in range(int(offsets[0]), int(offsets[-1]) - window + 1, STEP):
        part = data[begin : min(begin + STEP + window - 1, int(offsets[-1]))]
        hashes = gram_hashes(part, gram)
        ranked = (hashes >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_least(ranked, width) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        # the text of each window, and whether the window ends in it
        first, last = np.searchsorted(offsets, [begin, begin + len(at) - 1], "right") - 1
        border = np.clip(np.r_[starts[first : last + 1], ends[last]] - begin, 0, len(at))
        text = np.repeat(np.arange(first, last + 1), np.diff(border))
        valid = np.flatnonzero(np.arange(begin, begin + len(at)) + window <= ends[text])
        if not len(valid):
            continue
        where, owner = at[valid], text[valid]
        change = np.flatnonzero((np.diff(where) != 0) | (np.diff(valid) != 1) | (np.diff(owner) != 0)) + 1
        low, high = valid[np.r_[0, change]], valid[np.r_[change - 1, len(valid) - 1]]
        place = where[np.r_[0, change]]
        own = owner[np.r_[0, change]]
        out.append((own, hashes[place].view(np.int64), place + begin - starts[own], place - low, place - high))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, base = batch.column("key").to_numpy(), batch.column("base").to_numpy()
        data, offsets = _bytes_of(batch.column("bytes"))
        if not len(key):
            continue
        text, hashes, position, before, until = anchors(data, offsets)
        packed = (base[text] + position) << 14 | before << 7 | (before - until)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(packed), pa.array(key[text])], names=["hash", "place", "key"])


def _repeated(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """Rows whose hash occurs again, from rows in order of hash and place; with the shard of a long run."""
    held: list[np.ndarray] = []  # rows of the run that isn't over: at most those of one shard
    count, run = 0, None

    def out(rows: np.ndarray, at: int, hot: bool) -> pa.RecordBatch:
        cell = (at + np.arange(len(rows))) // shard if hot else np.zeros(len(rows), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(cell), pa.array(np.full(len(rows), hot))], names=["hash", "place", "key", "cell", "hot"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("hash", "place", "key")], axis=1)
        if not len(rows):
            continue
        borders = np.flatnonzero(np.diff(rows[:, 0])) + 1
        begins, ends = np.r_[0, borders], np.r_[borders, len(rows)]
        if rows[0, 0] != run:
            if held and 1 < count <= shard:
                yield out(np.concatenate(held), 0, False)
            held, count = [], 0
        else:  # the run of the batch before goes on
            own, begins, ends = rows[: ends[0]], begins[1:], ends[1:]
            count += len(own)
            held.append(own)
            if count > shard:
                kept = np.concatenate(held)
                yield out(kept, count - len(kept), True)
                held = []
            if not len(begins):
                continue
            if held and 1 < count <= shard:
                yield out(np.concatenate(held), 0, False)
            held, count = [], 0
        # runs that begin and end here, then the last one, which may go on
        n = (ends - begins)[:-1]
        inner = np.repeat(n, n)
        body = rows[begins[0] : begins[-1]]
        if len(body):
            cold = body[(inner > 1) & (inner <= shard)]
            if len(cold):
                yield out(cold, 0, False)
            for a, b in zip(begins[:-1][n > shard], ends[:-1][n > shard]):
                yield out(rows[a:b], 0, True)
        run, held, count = rows[-1, 0], [rows[begins[-1] :]], len(rows) - begins[-1]
        if count > shard:
            yield out(held[0], 0, True)
            held = []
    if held and 1 < count <= shard:
        yield out(np.concatenate(held), 0, False)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the windows that each repeated anchor represents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, base = batch.column("key").to_numpy(), batch.column("base").to_numpy()
        data, offsets = _bytes_of(batch.column("bytes"))
        wanted = batch.column("anchors")
        row = np.repeat(np.arange(len(key)), np.diff(wanted.offsets.to_numpy()))
        rows = wanted.flatten()
        place = rows.field("place").to_numpy()
        position = (place >> 14) - base[row]
        own = (position >= 0) & (position < np.diff(offsets)[row])  # not of another text with this key
        row, position, place = row[own], position[own], place[own]
        begin = offsets[:-1][row] + position - (place >> 7 & 127)
        length = (place & 127) + WINDOW
        ends = np.cumsum(length)
        flat = data[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        segments = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(flat)])
        mask = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [rows.field(c).filter(mask) for c in ("hash", "place", "cell", "hot")] + [pa.array(key[row]), segments],
            names=["hash", "place", "cell", "hot", "key", "segment"],
        )


def refined_order(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of rows by group and then by the words (columns) that follow.

    Larsson-Sadakane: rows that are equal so far form a group; groups of
    several rows are sorted by what follows, single rows are in place.
    """
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    rank[order] = np.cumsum(np.r_[0, np.diff(group[order]) != 0])
    for column in words.T:
        counts = np.bincount(rank[order])
        sizes = np.repeat(counts, counts)
        # ranks are the numbers of groups in order; rows of larger groups are sorted anew
        unsorted = np.flatnonzero(sizes > 1)
        if not len(unsorted):
            break
        rows = order[unsorted]
        order[unsorted] = rows[np.lexsort((column[rows], rank[rows]))]
        same = (np.diff(rank[order]) == 0) & (np.diff(column[order].view(np.int64)) == 0)
        single = np.r_[True, ~same]
        rank = rank.copy()
        rank[order] = np.cumsum(single) - 1
    return order


def common_prefixes(group: np.ndarray, letters: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before it; -1 across groups."""
    if not len(order):
        return np.zeros(0, np.int64)
    differ = letters[order[1:]] != letters[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])
    shared[group[order[1:]] != group[order[:-1]]] = -1
    return np.r_[-1, shared]


def _matrix(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of bytes from ``begin`` on, forwards or backwards, padded with zeros."""
    at = np.arange(width)
    index = begin[:, None] + step * at[None, :]
    inside = at[None, :] < length[:, None]
    return np.where(inside, data[np.where(inside, index, 0)], 0).astype(np.uint8) if len(data) else np.zeros((len(begin), width), np.uint8)


def later_windows(group: np.ndarray, place: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Which windows (row, offset of the anchor) of a shard aren't the first of their kind.

    Rows must be in order of their place; ``place`` is packed as by
    :func:`_find_anchors`.
    """
    reach = window - gram
    most = place >> 7 & 127
    least = most - (place & 127)
    begins = offsets[:-1] + most
    right = _matrix(data, begins, offsets[1:] - begins, -(-window // 8) * 8, 1)
    left = _matrix(data, begins - 1, most, -(-max(reach, 1) // 8) * 8, -1)
    classes = []
    for letters in (right, left):
        order = refined_order(group, np.ascontiguousarray(letters).view(">u8").astype(np.uint64))
        classes.append((order, common_prefixes(group, letters, order)))
    later = np.zeros((len(group), reach + 1), bool)
    number = np.empty((2, len(group)), np.int64)
    for o in range(reach + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) < 2:
            continue
        for side, length in ((0, window - o), (1, o)):
            order, shared = classes[side]
            number[side, order] = np.cumsum(shared < length)
        kind = number[0, rows] * (len(group) + 1) + number[1, rows]
        _, first = np.unique(kind, return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False
        later[rows[again], o] = True
    return later


def _runs(later: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, number of starts) of marked windows that follow each other."""
    edges = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    return row, (place[row] >> 14) - (high - 1), high - low


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked starts, and for shared anchors the digests of windows that are first in their shard."""
    held: list[pa.RecordBatch] = []
    names = ["key", "start", "n", "digest"]

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        place = table.column("place").to_numpy()
        table = table.take(pa.array(np.argsort(place, kind="stable")))
        hashes, place, key, cell, hot = (table.column(c).to_numpy() for c in ("hash", "place", "key", "cell", "hot"))
        data, offsets = _bytes_of(table.column("segment").combine_chunks())
        _, group = np.unique(np.stack([hashes, cell], axis=1), axis=0, return_inverse=True)
        later = later_windows(group.ravel(), place, data, offsets)
        row, start, n = _runs(later, place)
        yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(start), pa.array(n), pa.nulls(len(row), pa.binary())], names=names)
        if not hot.any():
            return
        most, least = place >> 7 & 127, (place >> 7 & 127) - (place & 127)
        for r in np.flatnonzero(hot):
            own = [o for o in range(least[r], most[r] + 1) if not later[r, o]]
            at = [int(offsets[r] + most[r] - o) for o in own]
            digests = [hashlib.blake2b(data[a : a + WINDOW].tobytes(), digest_size=16).digest() for a in at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key[r])), pa.array([int(place[r] >> 14) - o for o in own], pa.int64()), pa.array(np.ones(len(own), np.int64)), pa.array(digests, pa.binary())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH:
            continue
        table = pa.Table.from_batches(held)
        # the last group may go on
        same = (table.column("hash").to_numpy() == batch.column("hash")[-1].as_py()) & (table.column("cell").to_numpy() == batch.column("cell")[-1].as_py())
        done = len(same) - int(same.sum())
        if done:
            yield from flush(table.slice(0, done))
        held = table.slice(done).combine_chunks().to_batches()
    if held:
        yield from flush(pa.Table.from_batches(held))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks as they are, and windows that one shard found first but another has earlier.

    Rows are in order of digest and start.
    """
    last = None
    for batch in batches:
        first = pc.is_valid(batch.column("digest"))
        yield batch.filter(pc.invert(first)).select(["key", "start", "n"])
        own = batch.filter(first)
        if not own.num_rows:
            continue
        kinds = np.array([d.hex() for d in own.column("digest").to_pylist()])
        # binary search finds where each kind begins in the sorted digests of all shards
        later = np.searchsorted(kinds, kinds, "left") < np.arange(len(kinds))
        if last is not None:
            later |= kinds == last
        last = kinds[-1]
        yield own.filter(pa.array(later)).select(["key", "start", "n"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: bytes, removed bytes, removed runs, digest of the rest, and the runs."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        bases = batch.column("base").to_numpy()
        data, offsets = _bytes_of(batch.column("bytes"))
        marks, out = batch.column("marks"), []
        marked = marks.is_valid().to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            low = high = np.zeros(0, np.int64)
            if marked[i]:
                rows = marks[i].values
                low = rows.field("start").to_numpy() - bases[i]
                high = low + rows.field("n").to_numpy() - 1 + WINDOW
                own = (low >= 0) & (low < len(text))
                low, high = low[own], high[own]
            if len(low):
                order = np.argsort(low)
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.r_[True, low[1:] > high[:-1]]
                low, high = low[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(high) - 1]]
            kept = hashlib.sha256()
            for a, b in zip(np.r_[0, high], np.r_[low, len(text)]):
                kept.update(text[a:b].tobytes())
            out.append((bases[i], len(text), int((high - low).sum()), len(low), kept.hexdigest(), [{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())]))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span))], names=["base", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _based(texts: DataFrame) -> DataFrame:
    """``base`` of each text (``unknown``, ``id``, ``digest``, ``n_bytes``): bytes of all before it, in this order, and one for each."""
    order = ["unknown", "id", "digest"]
    rows = cut(texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    within = rows.withColumn("upto", F.sum(F.col("n_bytes") + 1).over(W.partitionBy("part").orderBy("place")))
    # a row for each partition
    sums = rows.groupBy("part").agg(F.sum(F.col("n_bytes") + 1).alias("n"))
    bases = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(F.broadcast(bases), "part").select(*order, (F.col("before") + F.col("upto") - F.col("n_bytes") - 1).alias("base"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard: int = SHARD) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``removed`` spans in bytes."""
    raw = F.coalesce(F.encode(col(text_column), "UTF-8"), F.lit(b""))
    rows = docs.select(F.coalesce(col(id_column).cast("long"), F.lit(0)).alias("id"), col(id_column).isNull().alias("unknown"), F.unhex(F.sha1(raw)).alias("digest"), raw.alias("bytes"))
    order = ["unknown", "id", "digest"]
    counts = cut(rows.groupBy(*order).agg(F.count("*").alias("copies"), F.first(F.octet_length("bytes")).cast("long").alias("n_bytes")))
    first = counts.groupBy("digest").agg(F.min(F.struct("unknown", "id")).alias("first"), F.first("n_bytes").alias("n_bytes"))
    key = F.xxhash64(*order)
    based = cut(_based(first.select("first.unknown", "first.id", "digest", "n_bytes")).withColumn("key", key))
    wanted = based.select("key", "base", *[F.col(c).alias(f"wanted_{c}") for c in order])
    if not counts.where("copies > 1").isEmpty():
        # one row of those that are equal, wherever they stand
        rows = rows.groupBy(*order).agg(F.first("bytes").alias("bytes"))
    # joined by the key alone, by which the texts stay dealt; what it is made of is compared besides
    equal = reduce(and_, [(F.col(c) >= F.col(f"wanted_{c}")) & (F.col(c) <= F.col(f"wanted_{c}")) for c in order])
    texts = rows.withColumn("key", key).join(wanted, "key").where(equal).select("key", "base", "bytes")

    found = texts.mapInArrow(_find_anchors, "hash long, place long, key long")
    again = found.repartition("hash").sortWithinPartitions("hash", "place").mapInArrow(lambda b: _repeated(b, shard), "hash long, place long, key long, cell long, hot boolean")
    per_text = again.groupBy("key").agg(F.collect_list(F.struct("hash", "place", "cell", "hot")).alias("anchors"))
    segments = texts.join(per_text, "key").select("key", "base", "bytes", "anchors").mapInArrow(_cut_out, "hash long, place long, cell long, hot boolean, key long, segment binary")
    marked = segments.repartition("hash", "cell").sortWithinPartitions("hash", "cell").mapInArrow(_mark, "key long, start long, n long, digest binary")
    route = F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.xxhash64("digest"))
    merged = marked.repartition(route).sortWithinPartitions("digest", "start").mapInArrow(_merge, "key long, start long, n long")
    marks = merged.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    results = texts.join(marks, "key", "left").select("base", "bytes", "marks").mapInArrow(_remove, "base long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")

    # back to all rows: the first of a text as found, its copies as a whole
    per_digest = results.join(based.select("base", "digest", F.col("id").alias("first_id"), F.col("unknown").alias("first_unknown")), "base").drop("base")
    listed = counts.select("unknown", "id", "digest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    whole = (F.col("n_bytes") >= WINDOW) & ~((F.col("copy") == 1) & (F.col("id") == F.col("first_id")) & (F.col("unknown") == F.col("first_unknown")))
    pick = lambda name, other: F.when(whole, other).otherwise(F.col(name)).alias(name)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return listed.join(per_digest, "digest").select(
        F.when(~F.col("unknown"), F.col("id")).alias("id"), "n_bytes", pick("n_removed", F.col("n_bytes")), pick("n_spans", F.lit(1).cast("long")),
        pick("kept_sha256", F.lit(_EMPTY_SHA)), pick("removed", everything),
    )
