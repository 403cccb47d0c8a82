"""Which rows have their key in a large set: a bit sketch of the set, and an exact look at the doubtful.

The sketch has two bits per key in an array of 64-bit words, built by partial
aggregation.  Its number of words is bounded, so it can always be broadcast: a
row whose bits aren't both set has a new key, and that is sure.  Of the others
only the distinct keys are met with the set itself; what the set lacks is a
false alarm.  So neither the rows nor copies of the set are shuffled, and a key
that a third of the rows share is one row of that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.sources.sinks import reliable

#: Words of a sketch at most: 16 MB when broadcast.  Keys of a word below that: two in 32 bits are set.
MOST_WORDS, KEYS_PER_WORD = 1 << 20, 4
#: False alarms that are broadcast; more are met by a shuffle.
BROADCAST_ALARMS = 100_000


def _words(size: int) -> int:
    return min(MOST_WORDS, 1 << max(0, (size // KEYS_PER_WORD).bit_length()))


def _placed(df: DataFrame, columns: list[str], words: int) -> DataFrame:
    """``df`` with the word and the two bits of its key."""
    names = ", ".join(f"`{c}`" for c in columns)
    hashed = df.selectExpr("*", f"xxhash64({names}) AS __h")
    bits = "shiftleft(1L, CAST(shiftrightunsigned(__h, 52) & 63 AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(__h, 58) AS INT))"
    return hashed.selectExpr("*", f"CAST(__h & {words - 1} AS INT) AS __word", f"{bits} AS __bits").drop("__h")


def sketch(keys: DataFrame, columns: list[str], words: int) -> DataFrame:
    """(``__word``, ``__set``): the bits of all keys, a row per word that has any."""
    return _placed(keys.select(*columns), columns, words).groupBy("__word").agg(F.bit_or("__bits").alias("__set"))


def split(rows: DataFrame, keys: DataFrame, columns: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``columns`` are in ``keys``, rows whose are not); missing values equal each other.

    ``size`` is about how many keys there are; it only sets the sketch's width.
    """
    kept, words = rows.columns, _words(size)
    probed = _placed(rows, columns, words).join(F.broadcast(sketch(keys, columns, words)), "__word", "left")
    maybe = F.coalesce(F.col("__set").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False))
    doubtful, new = probed.filter(maybe).select(*kept), probed.filter(~maybe).select(*kept)
    # structs compare missing fields as equal
    key = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__key")
    alarms = reliable(doubtful.select(key).distinct().join(keys.select(key).distinct(), "__key", "left_anti"))
    n = alarms.count()
    if not n:
        return doubtful, new
    side = F.broadcast(alarms) if n <= BROADCAST_ALARMS else alarms
    keyed = doubtful.withColumn("__key", key)
    return keyed.join(side, "__key", "left_anti").select(*kept), new.unionByName(keyed.join(side, "__key", "left_semi").select(*kept))
