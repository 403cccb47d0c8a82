"""Mixing sources to target weights.

Words are summed per source, a target and so a repetition rate follow for each
source, and a document is taken floor(rate) times and once more with the
fraction as probability, decided by a hash of seed and document id. Only the
sums per source are shuffled or broadcast to the documents when small.

Defined cases: a null text has no words, a null source is a source of its own
and the last in order; a null document id draws like any other value; equal ids
draw alike; sources without words get target 0 and rate 0; no document, no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import WORD, col, cut, fresh
from tabaudit.llm.ranking import with_global_rank

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Bytes of the sources up to which their targets are broadcast.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Shares:
    """What all sources have and share: ``rest`` words over ``weight`` for those below their limit."""

    rest: int
    weight: int


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target per source from a table (``source``, ``source_size``), one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn and
    share the sum of all sizes. A target stops at ``most`` times its source's
    size; the excess is shared again by weight until none is above. Every
    round settles a source or ends, and sources are few or settle many at a
    time; a round is one aggregation of the source table.
    """
    # UTF-8 order is code point order; sorting is distributed, so any number of sources will do
    ranked = with_global_rank(sizes, [F.col("source").isNull(), F.col("source").cast("binary")], "rank")
    listed = F.array(*[F.lit(int(w)) for w in weights])
    state = cut(ranked.select("source", "source_size", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight")))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most

    def above(shares: Shares) -> Column:
        return F.col("weight") * F.lit(shares.rest).cast("decimal(28,0)") > (limit * F.lit(shares.weight)).cast("decimal(28,0)")

    shares, settled = Shares(total, state.agg(F.sum("weight")).first()[0] or 0), None
    while shares.weight:
        # whoever is above its limit at this share is so at every later, larger one
        count, held, weight = state.where(above(shares)).agg(F.count("*"), F.sum(limit), F.sum("weight")).first()
        if count == settled:
            break
        settled = count
        all_weight = state.agg(F.sum("weight")).first()[0]
        shares = Shares(total - (held or 0), all_weight - (weight or 0))
    target = F.lit(0.0) if not shares.weight else F.when(above(shares), limit.cast("double")).otherwise((F.col("weight") * F.lit(shares.rest)).cast("double") / F.lit(float(shares.weight)))
    if not shares.weight:
        target = limit.cast("double")
    return state.select("source", "source_size", target.alias("target"))


def drawn(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1, below 1, that seed and key decide; the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four columns more: words, words and target of the source, and copies to take.

    Returns the table and the names of the new columns by role, since ``docs``
    may have columns of the plain names.
    """
    names = dict(zip(("size", "source_size", "target", "copies"), fresh(docs, "size", "source_size", "target", "copies")))
    (key,) = fresh(docs.withColumns({n: F.lit(0) for n in names.values()}), "mix_source")
    sized = docs.withColumn(names["size"], words_of(col(text_column)))
    sizes = sized.groupBy(col(source_column).alias("source")).agg(F.sum(col(names["size"])).alias("source_size"))
    targets = source_targets(sizes, weights, most).select(F.col("source").alias(key), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    # few sources are sent to all tasks, so that texts stay where they are; their bytes are counted first
    held = targets.agg(F.sum(F.coalesce(F.octet_length(col(key).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    targets = F.broadcast(targets) if held <= BROADCAST_BYTES else targets
    joined = sized.join(targets, col(source_column).eqNullSafe(col(key)), "left").drop(key)
    rate = F.when(col(names["source_size"]) > 0, col(names["target"]) / col(names["source_size"])).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (drawn(col(id_column), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(names["copies"], copies.cast("long")), names


def emit(mixed: DataFrame, copies: str) -> DataFrame:
    """Each row as often as it is to be taken."""
    (at,) = fresh(mixed, "copy")
    return mixed.withColumn(at, F.explode(F.sequence(F.lit(1), F.greatest(col(copies), F.lit(1))))).where(col(copies) > 0).drop(at)
