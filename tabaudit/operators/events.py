"""Failure events per chain and how they line up with onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.operators.onset import CHAIN, first_zero, run_below

SIGNAL_LOSS, CLASS_COLLAPSE = "signal_loss", "class_collapse"


def failure_events(
    utility: DataFrame,
    minority: DataFrame,
    chain: list[str] = CHAIN,
    threshold: float = m.UTILITY_FLOOR,
    k: int = m.CONSECUTIVE_POINTS,
    last_generation: int = m.LAST_GENERATION,
    censor_at: str = "last_generation",
) -> DataFrame:
    """time, event and mechanism of every chain found in either trajectory.

    A chain fails when its utility stays at or below the floor for ``k``
    observed points, or when its minority share reaches zero, whichever is
    first.  Chains that never fail are censored at ``last_generation``, or at
    their own last observation with ``censor_at="last_observed"``.
    """
    if censor_at not in ("last_generation", "last_observed"):
        raise ValueError(f"unknown censoring rule {censor_at!r}")
    lost = run_below(utility, threshold, k, chain).select(
        *chain, F.col("onset").alias("__lost"), "n_points", F.col("last_generation").alias("__last_u")
    )
    collapsed = first_zero(minority, chain).select(
        *chain, F.col("onset").alias("__collapsed"), F.col("last_generation").alias("__last_m")
    )
    joined = lost.join(collapsed, chain, "full_outer")
    first = F.least("__lost", "__collapsed")
    if censor_at == "last_generation":
        censored = F.lit(last_generation)
    else:
        censored = F.least(F.greatest("__last_u", "__last_m"), F.lit(last_generation))
    mechanism = F.concat_ws(
        "+",
        F.when(F.col("__lost") == first, F.lit(SIGNAL_LOSS)),
        F.when(F.col("__collapsed") == first, F.lit(CLASS_COLLAPSE)),
    )
    points = F.coalesce("n_points", F.lit(0))
    return joined.select(
        *chain,
        F.coalesce(first, censored).cast("int").alias("time"),
        first.isNotNull().cast("int").alias("event"),
        mechanism.alias("mechanism"),
        points.alias("n_tstr_datapoints"),
        (points < k).alias("insufficient_tstr_data"),
    )


def join_onset(events: DataFrame, onsets: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """One row per chain of either table, with ``found_in`` = both / events / onsets.

    Both sides must have one row per chain; a duplicate fails the job.
    """
    from tabaudit.operators.ids import assert_unique

    left = assert_unique(
        events.select(*chain, F.col("time").alias("failure_time"), F.col("event").alias("failure_event"),
                      "mechanism", F.lit(True).alias("__e")),
        chain, "failure events",
    )
    right = assert_unique(
        onsets.select(*chain, F.col("onset_generation").alias("onset_generation"),
                      F.col("crossed").alias("onset_crossed"), "n_observed_generations", F.lit(True).alias("__o")),
        chain, "onsets",
    )
    side = (
        F.when(F.col("__e").isNull(), F.lit("onsets")).when(F.col("__o").isNull(), F.lit("events")).otherwise(F.lit("both"))
    )
    return left.join(right, chain, "full_outer").withColumn("found_in", side).drop("__e", "__o")


# Category labels (fixed values).
CATEGORIES = [
    "both__hallucination_before_failure", "both__same_generation",
    "both__hallucination_after_failure", "failure_only", "hallucination_only", "neither",
]


def dissociation(joined: DataFrame) -> DataFrame:
    """Add ``dissociation_category``; an unknown crossing counts as not crossed."""
    failed = F.coalesce(F.col("failure_event") == 1, F.lit(False))
    crossed = F.coalesce(F.col("onset_crossed"), F.lit(False))
    before, same, after, failure_only, onset_only, neither = (F.lit(c) for c in CATEGORIES)
    category = (
        F.when(failed & crossed & (F.col("onset_generation") < F.col("failure_time")), before)
        .when(failed & crossed & (F.col("onset_generation") == F.col("failure_time")), same)
        .when(failed & crossed, after)
        .when(failed, failure_only)
        .when(crossed, onset_only)
        .otherwise(neither)
    )
    return joined.withColumn("dissociation_category", category)


def category_counts(categorised: DataFrame) -> DataFrame:
    """Chains per category, categories without chains included."""
    sums = categorised.agg(
        *[F.count_if(F.col("dissociation_category") == c).alias(c) for c in CATEGORIES]
    )
    return sums.unpivot([], CATEGORIES, "category", "n_chains")


def risk_intervals(joined: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """Split each chain at its onset: (start, stop, event, active) rows.

    A chain that fails at generation 0 has no time at risk and gives no row.
    """
    stop, onset = F.col("failure_time").cast("double"), F.col("onset_generation").cast("double")
    event = F.col("failure_event")

    def interval(start, end, ev, active):
        return F.struct(start.alias("start"), end.alias("stop"), ev.alias("event"), F.lit(active).alias("active"))

    zero, none = F.lit(0.0), F.lit(0)
    parts = (
        F.when(onset.isNull() | (onset >= stop), F.array(interval(zero, stop, event, 0)))
        .when(onset <= 0, F.array(interval(zero, stop, event, 1)))
        .otherwise(F.array(interval(zero, onset, none, 0), interval(onset, stop, event, 1)))
    )
    return joined.filter(stop > 0).select(*chain, F.inline(parts))


def coverage_reconciliation(utility: DataFrame, minority: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """Is missing utility data explained by class collapse?  One row per chain."""
    last = utility.filter(F.col("value").isNotNull()).groupBy(*chain).agg(F.max("generation").alias("last_tstr_generation"))
    share = minority.groupBy(*chain).agg(
        F.min(F.when(F.col("value") == 0, F.col("generation"))).alias("collapse_generation"),
        F.max("generation").alias("max_generation"),
    )
    return last.join(share, chain, "full_outer").withColumn(
        "diff_vs_collapse", F.col("last_tstr_generation") - F.col("collapse_generation")
    )


def coverage_verdict(reconciled: DataFrame) -> DataFrame:
    """Counts behind the coverage report."""
    diff = F.col("diff_vs_collapse")
    return reconciled.agg(
        F.count_if(F.col("collapse_generation").isNull()).alias("n_never_collapsed"),
        F.count(diff).alias("n_with_both"),
        F.count_if(diff <= 0).alias("n_at_or_before_collapse"),
        F.count_if(diff > 0).alias("n_after_collapse"),
    )
