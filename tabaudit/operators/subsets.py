"""Leave-one-seed-out subsets without re-running anything per subset.

Every test of the audit depends on its chains only through additive counts
("cells": a contingency cell, a risk set, a rank sum).  Cells are summed once
per seed; the cells of "all chains but seed s" are the totals minus the cells
of s.  The work grows with seeds x cells, not with seeds x chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m

SEEDS = ["dseed", "mseed"]
FULL = "Full population"


def subset_label(kind: Column, seed: Column) -> Column:
    return (
        F.when(kind == "dseed", F.concat(F.lit("Excluding data seed "), seed.cast("string")))
        .when(kind == "mseed", F.concat(F.lit("Excluding model seed "), seed.cast("string")))
        .otherwise(F.lit(FULL))
    )


def _kinds() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("seed")) for s in SEEDS])).alias("__s")


def subset_list(universe: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, seed, subset: the full population and one row per seed to leave out."""
    seeds = universe.select(*keys, _kinds()).select(*keys, "__s.kind", "__s.seed").distinct()
    full = universe.select(*keys).distinct().select(
        *keys, F.lit("full").alias("kind"), F.lit(None).cast("bigint").alias("seed")
    )
    return full.unionByName(seeds).withColumn("subset", subset_label(F.col("kind"), F.col("seed")))


def cells_by_subset(
    cells: DataFrame, universe: DataFrame, keys: list[str], cell: list[str], measures: list[str]
) -> DataFrame:
    """keys, subset, cell, measures for every subset of ``subset_list``.

    ``cells`` carries keys, both seeds, the cell columns and additive
    measures.  Cells whose measures all vanish in a subset are dropped.
    """
    sums = [F.sum(x).alias(x) for x in measures]
    base = cells.groupBy(*keys, *SEEDS, *cell).agg(*sums)
    total = base.groupBy(*keys, *cell).agg(*sums)
    part = (
        base.select(*keys, *cell, *measures, _kinds())
        .select(*keys, *cell, *measures, "__s.kind", "__s.seed")
        .groupBy(*keys, "kind", "seed", *cell)
        .agg(*[F.sum(x).alias(f"__{x}") for x in measures])
    )
    left = subset_list(universe, keys).filter(F.col("kind") != "full")
    out = left.join(total, keys).join(part, [*keys, "kind", "seed", *cell], "left")
    remaining = [(F.col(x) - F.coalesce(F.col(f"__{x}"), F.lit(0))).alias(x) for x in measures]
    reduced = out.select(*keys, "subset", *cell, *remaining)
    everything = total.select(*keys, F.lit(FULL).alias("subset"), *cell, *measures).unionByName(reduced)
    alive = F.lit(False)
    for x in measures:
        alive = alive | (F.col(x) != 0)
    return everything.filter(alive)


def group_members(events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """Events once per comparison group they belong to (groups overlap).

    Adds group, position (index of the generator in its group) and group_size.
    The membership table is a literal, so nothing is joined.
    """
    by_generator: dict[str, list[Column]] = {}
    for group, generators in groups.items():
        for position, generator in enumerate(generators):
            by_generator.setdefault(generator, []).append(
                F.struct(
                    F.lit(group).alias("group"), F.lit(position).alias("position"),
                    F.lit(len(generators)).alias("group_size"),
                )
            )
    entries: list[Column] = []
    for generator, members in by_generator.items():
        entries += [F.lit(generator), F.array(*members)]
    return events.select("*", F.inline(F.try_element_at(F.create_map(*entries), F.col("generator"))))
