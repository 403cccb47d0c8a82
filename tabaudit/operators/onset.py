"""When does a trajectory change?  One window pass serves every metric at once.

Input is the tidy trajectory (generator, dseed, mseed, generation, metric,
value).  It holds one row per chain, metric and generation, so a window
partition is never longer than the number of generations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit import model as m

CHAIN = m.CHAIN_KEYS


def chain_registry(trajectory: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """Every chain that exists: the denominator of all crossing counts."""
    return trajectory.select(*chain).distinct()


def _registry_rows(registry: DataFrame, metrics: list[str], chain: list[str]) -> DataFrame:
    return registry.select(*chain, F.explode(F.array(*[F.lit(x) for x in metrics])).alias("metric"))


def _clean(trajectory: DataFrame) -> DataFrame:
    return trajectory.filter(F.col("value").isNotNull())


def _lookup(values: dict[str, object], kind: str) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), F.col("metric")).cast(kind)


def incline_onset(
    trajectory: DataFrame,
    registry: DataFrame,
    metrics: dict[str, tuple[float, str]] = m.ONSET_METRICS,
    chain: list[str] = CHAIN,
) -> DataFrame:
    """First step between neighbouring observed generations that reaches its threshold.

    Missing values are dropped first, so a step may span a gap.  Chains of the
    registry without data are reported as not crossed.
    """
    for name, (_, direction) in metrics.items():
        if direction not in ("increase", "decrease"):
            raise ValueError(f"{name}: direction must be 'increase' or 'decrease', got {direction!r}")
    order = Window.partitionBy("metric", *chain).orderBy("generation")
    step = F.col("value") - F.lag("value").over(order)
    threshold = _lookup({k: float(t) for k, (t, _) in metrics.items()}, "double")
    rising = _lookup({k: d == "increase" for k, (_, d) in metrics.items()}, "boolean")
    stepped = _clean(trajectory).filter(F.col("metric").isin(*metrics)).withColumn("__step", step)
    hit = F.when(rising, F.col("__step") >= threshold).otherwise(F.col("__step") <= -threshold)
    found = stepped.groupBy("metric", *chain).agg(
        F.min(F.when(hit, F.struct("generation", F.col("__step").alias("step")))).alias("__first"),
        F.count(F.lit(1)).alias("__n"),
    )
    return (
        _registry_rows(registry, list(metrics), chain)
        .join(found, ["metric", *chain], "left")
        .select(
            "metric", *chain,
            F.col("__first.generation").alias("onset_generation"),
            F.col("__first.step").alias("step_size"),
            F.col("__first").isNotNull().alias("crossed"),
            F.coalesce("__n", F.lit(0)).alias("n_observed_generations"),
        )
    )


def baseline_rise_onset(
    trajectory: DataFrame, registry: DataFrame, metrics: dict[str, float], chain: list[str] = CHAIN
) -> DataFrame:
    """First generation whose running maximum exceeds the first value by the threshold.

    A missing first value means the chain can never cross.
    """
    order = Window.partitionBy("metric", *chain).orderBy("generation")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    threshold = _lookup({k: float(t) for k, t in metrics.items()}, "double")
    seen = trajectory.filter(F.col("metric").isin(*metrics)).withColumns(
        {"__base": F.first("value").over(running), "__max": F.max("value").over(running)}
    )
    hit = F.col("value").isNotNull() & (F.col("__max") - F.col("__base") >= threshold)
    found = seen.groupBy("metric", *chain).agg(
        F.first("__base", ignorenulls=True).alias("__b"),
        F.max("value").alias("__p"),
        F.min(F.when(hit, F.col("generation"))).alias("__onset"),
        F.min("generation").alias("__start"),
    )
    known = F.col("__start").isNotNull()
    return (
        _registry_rows(registry, list(metrics), chain)
        .join(found, ["metric", *chain], "left")
        .select(
            "metric", *chain,
            F.when(known, F.col("__b")).otherwise(F.lit(0.0)).alias("baseline"),
            F.when(known, F.col("__p")).otherwise(F.lit(0.0)).alias("peak"),
            F.when(known, F.col("__p") - F.col("__b")).otherwise(F.lit(0.0)).alias("max_rise"),
            F.col("__onset").alias("onset_generation"),
            F.col("__onset").isNotNull().alias("crossed"),
            F.coalesce(F.col("__start") == 0, F.lit(True)).alias("baseline_is_gen0"),
        )
    )


def largest_step(
    trajectory: DataFrame, registry: DataFrame, metrics: list[str], chain: list[str] = CHAIN
) -> DataFrame:
    """Generation after the largest absolute step (the earliest of equals)."""
    order = Window.partitionBy("metric", *chain).orderBy("generation")
    stepped = (
        _clean(trajectory)
        .filter(F.col("metric").isin(*metrics))
        .withColumn("__step", F.col("value") - F.lag("value").over(order))
    )
    best = F.max(
        F.when(
            F.col("__step").isNotNull(),
            F.struct(F.abs("__step").alias("a"), (-F.col("generation")).alias("g"), F.col("__step").alias("s")),
        )
    )
    found = stepped.groupBy("metric", *chain).agg(best.alias("__b"), F.count(F.lit(1)).alias("__n"))
    return (
        _registry_rows(registry, metrics, chain)
        .join(found, ["metric", *chain], "left")
        .select(
            "metric", *chain,
            (-F.col("__b.g")).alias("spike_generation"), F.col("__b.s").alias("spike_size"),
            F.coalesce("__n", F.lit(0)).alias("n_observed_generations"),
        )
    )


def run_below(trajectory: DataFrame, threshold: float, k: int, chain: list[str] = CHAIN) -> DataFrame:
    """Per chain: first generation that starts ``k`` observed values at or below the threshold."""
    ahead = Window.partitionBy(*chain).orderBy("generation").rowsBetween(0, k - 1)
    seen = trajectory.filter(F.col("value").isNotNull()).withColumns(
        {"__worst": F.max("value").over(ahead), "__len": F.count(F.lit(1)).over(ahead)}
    )
    hit = (F.col("__worst") <= threshold) & (F.col("__len") == k)
    return seen.groupBy(*chain).agg(
        F.min(F.when(hit, F.col("generation"))).alias("onset"),
        F.count(F.lit(1)).alias("n_points"),
        F.max("generation").alias("last_generation"),
    )


def first_zero(trajectory: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """Per chain: first generation with value 0."""
    return trajectory.groupBy(*chain).agg(
        F.min(F.when(F.col("value") == 0, F.col("generation"))).alias("onset"),
        F.max("generation").alias("last_generation"),
    )


def first_positive_mean(pooled_rows: DataFrame, keys: list[str]) -> DataFrame:
    """First generation in which a pooled mean exceeds zero."""
    return pooled_rows.filter(F.col("mean") > 0).groupBy(*keys).agg(F.min("generation").alias("first_generation"))


def crossing_counts(onsets: DataFrame, keys: list[str]) -> DataFrame:
    """n_crossed / n_total per metric (and generator)."""
    return onsets.groupBy(*keys).agg(F.count_if("crossed").alias("n_crossed"), F.count(F.lit(1)).alias("n_total"))


def onset_wide(onsets: DataFrame, metrics: list[str], chain: list[str] = CHAIN) -> DataFrame:
    """One row per chain with onset generation and step of every metric."""
    return onsets.groupBy(*chain).agg(
        *[
            F.max(F.when(F.col("metric") == name, F.col(source))).alias(f"{name}_{printed}")
            for name in metrics
            for source, printed in (("onset_generation", "spike_generation"), ("step_size", "spike_size"))
        ]
    )
