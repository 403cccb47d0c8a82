"""Class balance of the outcome label, per file and chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.normalise import binary_label


def label_column(df: DataFrame, aliases: list[str] = m.LABEL_COLUMN_ALIASES) -> str:
    """The label column of a table, matched case-insensitively by known names."""
    by_name = {c.strip().lower(): c for c in df.columns}
    for alias in aliases:
        if alias in by_name:
            return by_name[alias]
    raise ValueError(f"no label column among {df.columns}")


def class_balance(df: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """n_rows, n_positive, positive_share, minority_share, n_classes per key.

    A missing label counts as negative; a single-class file has minority
    share 0 (see ``label_balance`` for the other convention).
    """
    label = label or label_column(df)
    positive = binary_label(F.col(label), dict(df.dtypes)[label])
    share = F.col("n_positive") / F.col("n_rows")
    return (
        df.select(*keys, positive.alias("__y"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("__y").cast("bigint").alias("n_positive"))
        .select(
            *keys, "n_rows", "n_positive", share.alias("positive_share"),
            F.least(share, F.lit(1.0) - share).alias("minority_share"),
            (
                (F.col("n_positive") > 0).cast("bigint") + (F.col("n_positive") < F.col("n_rows")).cast("bigint")
            ).alias("n_classes"),
        )
    )


def label_balance(df: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """n_classes and smallest class share over non-null labels.

    Here a single-class file has share 1.0 and a file without labels has
    0 classes and a null share.
    """
    label = label or label_column(df)
    text = F.lower(F.trim(F.col(label).cast("string")))
    level = (
        F.when(text.isin("1", "yes"), F.lit("true")).when(text.isin("0", "no"), F.lit("false")).otherwise(text)
    )
    per_level = df.select(*keys, level.alias("__level")).groupBy(*keys, "__level").agg(F.count(F.lit(1)).alias("__n"))
    present = F.col("__level").isNotNull()
    counts = per_level.groupBy(*keys).agg(
        F.count_if(present).alias("n_classes"),
        F.min(F.when(present, F.col("__n"))).alias("__least"),
        F.sum(F.when(present, F.col("__n"))).alias("__total"),
    )
    return counts.select(*keys, "n_classes", (F.col("__least") / F.col("__total")).alias("minority_fraction"))


def is_collapsed(n_classes: Column, minority: Column, floor: float = 0.0) -> Column:
    """One class left, or a minority below an optional floor."""
    small = (minority < floor) if floor > 0 else F.lit(False)
    return F.coalesce((n_classes <= 1) | F.coalesce(small, F.lit(False)), F.lit(False))


def attach_collapse(trajectory: DataFrame, balance: DataFrame, keys: list[str], floor: float = 0.0) -> DataFrame:
    """Add n_classes, minority_fraction and class_collapse to trajectory rows."""
    joined = trajectory.join(balance.select(*keys, "n_classes", "minority_fraction"), keys, "left")
    return joined.withColumn("class_collapse", is_collapsed(F.col("n_classes"), F.col("minority_fraction"), floor))


def frozen_chains(balance: DataFrame, chain: list[str]) -> DataFrame:
    """Chains whose positive count is the same in every generation."""
    # min = max says "one distinct value" without a distinct aggregate
    spread = balance.groupBy(*chain).agg(
        F.min("n_positive").alias("n_positive"), F.max("n_positive").alias("__max"),
        F.count(F.lit(1)).alias("n_generations"),
    )
    return spread.filter(F.col("n_positive") == F.col("__max")).drop("__max")


def first_collapse(balance: DataFrame, chain: list[str], group: list[str]) -> DataFrame:
    """First single-class generation per chain, summarised per group."""
    first = balance.filter(F.col("minority_share") == 0).groupBy(*chain).agg(F.min("generation").alias("__g"))
    # the exact median keeps one counter per distinct generation, not one entry per chain
    return first.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_chains"), F.min("__g").alias("first_min"),
        F.median("__g").alias("first_median"), F.max("__g").alias("first_max"),
    )


def short_chains(balance: DataFrame, chain: list[str], generations: int = m.LAST_GENERATION + 1) -> DataFrame:
    """Chains with fewer generations than expected."""
    return balance.groupBy(*chain).agg(F.count(F.lit(1)).alias("n_generations")).filter(
        F.col("n_generations") < generations
    )


def chain_count_check(rows: DataFrame, generator: list[str], chain: list[str], expected: int = m.EXPECTED_CHAINS) -> DataFrame:
    """Generators whose number of chains differs from the design."""
    found = rows.select(*generator, *chain).distinct().groupBy(*generator).agg(F.count(F.lit(1)).alias("n_chains"))
    return found.withColumn("as_expected", F.col("n_chains") == expected)
