"""Per-chain rate trajectories from flag tables.

An absent (chain, generation) can mean three different things, so the fill
rule is always spelled out: evaluated and clean (``chain_rates``), probably
evaluated (``chain_rates_gated``), or not evaluated (``chain_rates_unfilled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Flags per key: counted, or as they are where ``flagged`` has ``n_flagged`` already."""
    if "n_flagged" in flagged.columns:
        return flagged.select(*keys, "n_flagged")
    return flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_flagged"))


def chain_rates(flagged: DataFrame, file_sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Flag rate of every evaluated file; files without a flag get 0.

    ``file_sizes`` (keys + n_rows) comes from the records, so a file with no
    flag at all is still there and the denominator is its real row count.
    """
    counts = _counted(flagged, keys).withColumnRenamed("n_flagged", "__n")
    n = F.coalesce(F.col("__n"), F.lit(0))
    return file_sizes.join(counts, keys, "left").select(
        *keys, "n_rows", n.alias("n_flagged"), (n / F.col("n_rows")).alias("value")
    )


def chain_rates_gated(
    flagged: DataFrame,
    seen: DataFrame,
    chain: list[str],
    rows_per_file: DataFrame,
    min_coverage: float = 0.5,
    per: list[str] | None = None,
) -> DataFrame:
    """Zero-fill a generation only when enough chains have a flag in it.

    ``seen`` lists the known chains.  A generation in which fewer than
    ``min_coverage`` of them (of their group, with ``per``) carry a flag is
    dropped instead of filled.
    """
    scope = per or []
    counts = _counted(flagged, [*chain, "generation"])
    chains = seen.select(*chain).distinct()
    one = F.lit(1).alias("__one")
    totals = chains.groupBy(*scope, one).agg(F.count(F.lit(1)).alias("__chains"))
    covered = counts.groupBy(*scope, F.lit(1).alias("__one"), "generation").agg(F.count(F.lit(1)).alias("__with"))
    kept = covered.join(F.broadcast(totals), [*scope, "__one"]).filter(F.col("__with") / F.col("__chains") >= min_coverage)
    # Generations of a scope as one short array per scope: the grid is an equi-join
    # plus explode.  One row per scope (all chains, or a generator) is broadcast.
    generations = kept.groupBy(*scope, "__one").agg(F.collect_set("generation").alias("__gs"))
    grid = (
        chains.withColumn("__one", F.lit(1))
        .join(F.broadcast(generations), [*scope, "__one"])
        .select(*chain, F.explode("__gs").alias("generation"))
    )
    filled = grid.join(counts, [*chain, "generation"], "left").join(rows_per_file, [*chain, "generation"], "left")
    n = F.coalesce(F.col("n_flagged"), F.lit(0))
    return filled.select(*chain, "generation", n.alias("n_flagged"), (n / F.col("n_rows")).alias("value"))


def chain_rates_unfilled(flagged: DataFrame, rows_per_file: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of files with at least one flag; absent files stay absent."""
    counts = _counted(flagged, keys)
    return counts.join(rows_per_file, keys).select(
        *keys, "n_flagged", (F.col("n_flagged") / F.col("n_rows")).alias("value")
    )


def combined_rates(
    rule_ids: DataFrame, reviewer_ids: DataFrame, rows_per_file: DataFrame, keys: list[str], record_id: str = "ID"
) -> DataFrame:
    """Rate of the true union of both flags, on the files the reviewer covered."""
    covered = reviewer_ids.select(*keys).distinct()
    both = rule_ids.select(*keys, record_id).join(covered, keys, "left_semi").unionByName(
        reviewer_ids.select(*keys, record_id)
    )
    return chain_rates_unfilled(both.distinct(), rows_per_file, keys)


def chain_mean(trajectory: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return trajectory.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def first_flagged(trajectory: DataFrame, chain: list[str], flag: Column) -> DataFrame:
    """First row per chain on which a flag holds."""
    values = [c for c in trajectory.columns if c not in chain]
    first = F.min_by(F.struct(*values), F.col("generation"))
    return (
        trajectory.filter(F.coalesce(flag, F.lit(False)))
        .groupBy(*chain)
        .agg(first.alias("__row"))
        .select(*chain, "__row.*")
    )


def cross_check(ours: DataFrame, official: DataFrame, keys: list[str], tolerance: float = 0.10) -> DataFrame:
    """Rows whose value differs from the official mean by more than ``tolerance``."""
    joined = ours.join(official, keys)
    return joined.withColumn("diff", F.abs(F.col("value") - F.col("official_mean"))).filter(
        F.col("diff") > tolerance
    )


def with_marks(trajectory: DataFrame, auroc: str, low: float = 0.5) -> DataFrame:
    """Add the low-utility mark of a trajectory row (missing utility is not low)."""
    return trajectory.withColumn("low_auroc", F.coalesce(F.col(auroc) <= low, F.lit(False)))
