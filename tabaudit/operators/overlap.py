"""How far do rule flags and novelty flags agree on the same records?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_cells(denominator: DataFrame, numerator: DataFrame, cell: list[str], over: list[str], record_id: str = "ID") -> DataFrame:
    """over, cell, denom, overlap: flagged records of each cell and how many are also in ``numerator``.

    ``denominator`` may hold a record once per rule (``over`` separates them).
    """
    keys = [*cell, record_id]
    hits = numerator.select(*keys).distinct().withColumn("__hit", F.lit(True))
    joined = denominator.select(*over, *keys).join(hits, keys, "left")
    return joined.groupBy(*over, *cell).agg(
        F.count(F.lit(1)).alias("denom"), F.count_if("__hit").alias("overlap")
    )


def stored_overlap(denominator: DataFrame, numerator: DataFrame, cell: list[str], over: list[str], record_id: str = "ID") -> DataFrame:
    """``overlap_cells`` of stored flag tables, whose keys are unique by contract.

    Tables bucketed by ``cell`` and record meet bucket by bucket: neither is
    shuffled, whatever its size.
    """
    keys = [*cell, record_id]
    hits = numerator.select(*keys, F.lit(True).alias("__hit")).hint("merge")
    joined = denominator.select(*over, *keys).join(hits, keys, "left")
    return joined.groupBy(*over, *cell).agg(F.count(F.lit(1)).alias("denom"), F.count_if("__hit").alias("overlap"))


def pooled_overlap(cells: DataFrame, over: list[str]) -> DataFrame:
    """Record-level overlap pooled over cells: ratio, miss rate, cells and counts."""
    sums = cells.filter(F.col("denom") > 0).groupBy(*over).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("overlap").alias("pooled_overlap_ids"),
        F.sum("denom").alias("pooled_denom_ids"),
    )
    ratio = F.col("pooled_overlap_ids") / F.col("pooled_denom_ids")
    return sums.select(
        *over, ratio.alias("pooled_ratio"), (F.lit(1.0) - ratio).alias("pooled_miss_rate"), "n_cells",
        "pooled_denom_ids", (F.col("pooled_denom_ids") - F.col("pooled_overlap_ids")).alias("pooled_missed_ids"),
    )


def overlap_in_place(flagged: DataFrame, cell: list[str], over: list[str], hit: str) -> DataFrame:
    """``overlap_cells`` when both flags are columns of the same rows: no join needed."""
    return flagged.groupBy(*over, *cell).agg(F.count(F.lit(1)).alias("denom"), F.count_if(hit).alias("overlap"))


def any_crosscheck(flag_table: DataFrame, rule_table: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Does the union of all single rules equal the any-rule flag?  Counts per scope."""
    any_total = flag_table.filter(F.col("metric") == "Expert_any").groupBy(*scope).agg(F.count(F.lit(1)).alias("any_total"))
    union = rule_table.select(*scope, *keys).distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("union_total"))
    return any_total.join(union, scope, "full_outer").withColumn(
        "consistent", F.coalesce(F.col("any_total") == F.col("union_total"), F.lit(False))
    )
