"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at many places of a 64-bit ring; a row belongs to the shard
of the next place clockwise of its own hash. A shard holds at most its bound;
what overflows continues clockwise, shard by shard, to the first with room.
With bounds that add up to the number of rows and differ by one at most, every
shard ends with exactly its bound.

The rows of an arc are alike to the ring, so only the arcs' counts decide: the
counts (one per arc, ``shards x places``) are laid out once, and each row finds
its shard from its rank in the arc. Expressions of Spark only, no Python code
touches rows.

Defined cases: null ids and null texts hash like any other value; equal rows
are told apart by their rank only, so a group of copies spreads over shards
when it overflows; no row, no result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import col
from tabaudit.llm.ranking import with_global_rank

PLACES = 64
_HALF, _FULL = 1 << 63, 1 << 64
#: The ring is looked up by its top bits: an arc is cut where a cell ends.
_CELL_BITS = 12


def ring(shards: int, places: int) -> list[tuple[int, int]]:
    """Places (position, shard) in clockwise order, as signed 64-bit numbers."""
    found = {}
    for shard in range(shards):
        for place in range(places):
            digest = hashlib.sha256(f"shard {shard} place {place}".encode()).digest()
            found[int.from_bytes(digest[:8], "big") - _HALF] = shard
    return sorted(found.items())


def lay_out(counts: list[int], firsts: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (first rank, end rank, shard, first slot) that keep every shard within its bound.

    ``counts`` has the rows of each arc in the order of the ring, ``firsts``
    the place that each arc meets first. First each arc's rows go there, while
    there is room. Then what overflowed goes on to the next places, one place
    further for all arcs at a time, so a row moves no further than it must.
    """
    free, used, runs, waiting, begin = list(bounds), [0] * len(bounds), [], [], 0
    for first, n in zip(firsts, counts):
        waiting.append((first, begin, begin + n))
        begin += n
    for step in range(len(owners)):
        later = []
        for first, begin, end in waiting:
            shard = owners[(first + step) % len(owners)]
            take = min(free[shard], end - begin)
            if take:
                runs.append((begin, begin + take, shard, used[shard]))
                free[shard] -= take
                used[shard] += take
            if begin + take < end:
                later.append((first, begin + take, end))
        waiting = later
    if waiting:
        raise ValueError("the bounds hold fewer rows than there are")
    return runs


def pieces_of(positions: list[int]) -> list[tuple[int, int, int, int]]:
    """The ring as pieces (cell, first, last, arc), each within one cell of the look-up.

    Arc i ends with place i; one arc more begins behind the last place and
    meets the first one.
    """
    width = _FULL >> _CELL_BITS
    starts = sorted({*range(-_HALF, _HALF, width), *(p + 1 for p in positions if p + 1 < _HALF)})
    ends = [s - 1 for s in starts[1:]] + [_HALF - 1]
    return [((s + _HALF) >> (64 - _CELL_BITS), s, e, bisect.bisect_left(positions, s)) for s, e in zip(starts, ends)]


def bounded_ring(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", places: int = PLACES) -> DataFrame:
    """Shard and slot of every row.

    Returns the id as ``id``, ``size`` (bytes of the text plus one),
    ``text_crc32``, ``shard`` and ``slot``, gapless from 0 in each shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.encode(col(text_column), "UTF-8"), F.lit(b""))
    rows = docs.select(
        col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.coalesce(col(id_column).cast("string"), F.lit("null"))).alias("position"),
    )
    ranked = with_global_rank(rows, ["position", "id", "text_crc32", "size"], "rank")
    nodes = ring(shards, places)
    owners = [s for _, s in nodes]
    cell_of = F.shiftright("position", 64 - _CELL_BITS) + F.lit(1 << (_CELL_BITS - 1))
    # the ring has a fixed number of pieces, whatever the table's size
    pieces = F.broadcast(spark.createDataFrame(pieces_of([p for p, _ in nodes]), "cell long, first long, last long, arc int"))
    arcs = ranked.select("position").join(pieces, (cell_of == F.col("cell")) & F.col("position").between(F.col("first"), F.col("last")))
    counts = [0] * (len(nodes) + 1)
    for arc, n in arcs.groupBy("arc").count().collect():  # a row for each place of the ring
        counts[arc] = n
    total = sum(counts)
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    runs = lay_out(counts, [*range(len(nodes)), 0], owners, bounds)
    # ranks are looked up by blocks; a run is listed in each block that it meets, so a row meets the runs of one block
    block = max(1, total >> _CELL_BITS)
    listed = [(b, low, end, shard, slot) for low, end, shard, slot in runs for b in range(low // block, (end - 1) // block + 1)]
    table = F.broadcast(spark.createDataFrame(listed, "block long, low long, end long, shard int, slot_base long"))
    inside = (F.floor(F.col("rank") / F.lit(block)) == F.col("block")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("end"))
    return ranked.join(table, inside).select("id", "size", "text_crc32", "shard", (F.col("slot_base") + F.col("rank") - F.col("low")).alias("slot"))
