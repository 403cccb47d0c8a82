"""Ranks over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabaudit.llm.common import cut, fresh

_SHIFT = 1 << 33


def with_global_rank(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in ``order``; ties in any order.

    Rows are range-partitioned and sorted within partitions; a partition
    starts where the row counts before it end. ``monotonically_increasing_id``
    holds partition and place in it. The sorted rows are kept in the shared
    folder, so counts and rows come from the same sort.
    """
    part, place, base = fresh(df, "rank_part", "rank_place", "rank_base")
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.floor(F.col(place) / _SHIFT)))
    counts = rows.groupBy(part).agg(F.count("*").alias(base))
    # a row for each partition: few, whatever the table's size
    bases = counts.select(part, F.coalesce(F.sum(base).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(base))
    return rows.join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.col(place) % _SHIFT).drop(part, place, base)
