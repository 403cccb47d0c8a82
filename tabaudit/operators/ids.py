"""Numbering rows inside a group without putting the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_GROUP, _SLICE, _KEY = "__group", "__slice", "__key"
_RANK, _BEFORE = "__rank", "__before"


def number_within(
    df: DataFrame,
    group: list[str],
    order: list[str],
    slice_of: str,
    name: str = "ID",
) -> DataFrame:
    """Add 1..n per ``group`` in ``order``, splitting every group into slices.

    ``slice_of`` (SQL text) must be non-decreasing in ``order`` (for instance the leading
    order column divided by a constant).  Rows are ranked inside
    (group, slice), and each slice starts after the rows of the slices before
    it, so a group holding a third of the table is spread over its slices.
    Window and join use the same key: the wide side is shuffled once, and the
    offsets are one row per slice.
    """
    columns = df.columns
    # structs compare missing fields as equal, so files with null keys are numbered too
    keys = ", ".join(f"`{g}`" for g in group)
    sliced = df.selectExpr("*", f"struct({keys}) AS {_GROUP}", f"{slice_of} AS {_SLICE}")
    earlier = Window.partitionBy(_GROUP).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(_GROUP, _SLICE)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(_BEFORE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .select(F.struct(_GROUP, _SLICE).alias(_KEY), _BEFORE)
    )
    inside = Window.partitionBy(_KEY).orderBy(*order)
    keyed = sliced.select(*columns, F.struct(_GROUP, _SLICE).alias(_KEY))
    ranked = keyed.withColumn(_RANK, F.row_number().over(inside))
    return ranked.join(offsets, _KEY).select(
        *columns, (F.col(_RANK) + F.col(_BEFORE)).cast("bigint").alias(name)
    )


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last one in ``order`` (an explicit order, so reruns agree).

    Aggregating the greatest struct combines map-side, so a key with very many
    versions never meets in one sort.
    """
    values = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *values))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{v}").alias(v) for v in values])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first one in ``order``; missing order values come last."""
    values = [c for c in df.columns if c not in keys]
    places = [x for i, o in enumerate(order) for x in (o.isNull().alias(f"__n{i}"), o.alias(f"__o{i}"))]
    best = F.min(F.struct(*places, *values))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{v}").alias(v) for v in values])


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Pass ``df`` through; the job fails when a key occurs more than once."""
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.first(c).alias(c) for c in df.columns if c not in keys],
    )
    problem = F.concat_ws(" ", F.lit(f"{what}: more than one row for"), *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("__n") > 1, F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))
    return counted.filter(checked).select(*df.columns)
