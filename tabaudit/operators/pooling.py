"""Statistics across chains, and the summary tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.tails import t_critical


def pooled(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """mean, variance, 95 % t interval, min, max and n of ``value`` per key.

    Missing values are dropped and n says how many were left.  With one value
    the variance is 0 and the interval is the value itself; with none all
    statistics are null.
    """
    grouped = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("__var"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return _interval(grouped, keys, prefix)


def _interval(grouped: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    variance = F.when(F.col("n") > 0, F.coalesce(F.col("__var"), F.lit(0.0)))
    half = t_critical(F.col("n") - 1) * F.sqrt(variance) / F.sqrt(F.col("n").cast("double"))
    out = {
        "mean": F.col("mean"), "var": variance,
        "low": F.when(F.col("n") > 0, F.col("mean") - half),
        "high": F.when(F.col("n") > 0, F.col("mean") + half),
        "min": F.col("min"), "max": F.col("max"), "n": F.col("n"),
    }
    return grouped.select(*keys, *[c.alias(prefix + name) for name, c in out.items()])


def pooled_metrics(df: DataFrame, keys: list[str], metrics: list[str], only: list[str] | None = None) -> DataFrame:
    """Long pooled summary (keys, metric, statistics) of several wide columns."""
    long = df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value")
    return pooled(long, [*keys, "metric"], "value")


def resolve_panel(available: list[str], wanted: list[tuple[str, str]], ignored: set[str] = frozenset()) -> tuple[list[str], list[str]]:
    """(metrics of a panel in order, what was asked for and isn't there).

    ``wanted`` lists ("metric", name) and ("prefix", beginning); a prefix gives
    all its metrics by name, without the ``ignored`` ones, and none comes twice.
    """
    chosen: list[str] = []
    missing: list[str] = []
    for kind, target in wanted:
        if kind not in ("metric", "prefix"):
            raise ValueError(f"unknown kind of panel entry: {kind}")
        hits = sorted(c for c in available if c not in ignored and (c == target if kind == "metric" else c.startswith(target)))
        missing += [] if hits else [target]
        chosen += [c for c in hits if c not in chosen]
    return chosen, missing


def zero_filled_counts(
    counts: DataFrame, files: DataFrame, generation: list[str], chain: list[str], item: str, value: str
) -> DataFrame:
    """Mean, sd, interval and n of ``value`` per (generation, item) over *all* files.

    A file in which an item never fired counts as 0.  The zeros are not
    materialised: the sums of the observed rows and the number of files give
    the same moments.  Items are those seen at least once in a generation.
    """
    universe = files.groupBy(*generation).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy(*generation, item).agg(
        F.sum(F.col(value).cast("double")).alias("__s"),
        F.count(F.lit(1)).alias("__k"),
        F.avg(F.col(value).cast("double")).alias("__m"),
        F.coalesce(F.var_samp(F.col(value).cast("double")), F.lit(0.0)).alias("__v"),
    )
    joined = seen.join(universe, generation)
    n, k = F.col("n").cast("double"), F.col("__k").cast("double")
    mean = F.col("__s") / n
    # within the observed rows, plus observed-versus-zero
    spread = F.col("__v") * (k - 1) + k * (n - k) / n * F.col("__m") * F.col("__m")
    sd = F.when(F.col("n") > 1, F.sqrt(spread / (n - 1))).otherwise(F.lit(0.0))
    half = t_critical(F.col("n") - 1) * sd / F.sqrt(n)
    return joined.select(
        *generation, item, mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"),
        sd.alias("sd"), "n",
    )


def attach_owned(base: DataFrame, block: DataFrame, keys: list[str], owned_prefixes: tuple[str, ...]) -> DataFrame:
    """Replace a step's own columns of a wide summary and keep all others.

    Columns that start with an owned prefix are dropped and the block's are
    joined on; rows follow the base, so rerunning a step changes nothing else.
    """
    kept = [c for c in base.columns if not c.startswith(owned_prefixes)]
    return base.select(*kept).join(block, keys, "left")


def keys_only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks, for the merge report."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], run_order: str) -> DataFrame:
    """Append ``new`` to ``old``; per key the row with the latest ``run_order`` wins."""
    from tabaudit.operators.ids import keep_last

    return keep_last(old.unionByName(new, allowMissingColumns=True), keys, [F.col(run_order)])


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose key is not finished yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def reference_line(pooled_rows: DataFrame, scope: list[str], generator: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """One scalar per scope: mean per generator, then over generators, with a spread warning."""
    per_generator = pooled_rows.filter(F.col(value).isNotNull()).groupBy(*scope, generator).agg(F.avg(value).alias("__m"))
    return per_generator.groupBy(*scope).agg(
        F.avg("__m").alias("reference"),
        (F.max("__m") - F.min("__m")).alias("spread"),
        F.count(F.lit(1)).alias("n_generators"),
    ).withColumn("spread_warning", F.col("spread") > tolerance)


def clip_low_high(metric: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Clip an interval to the physical range of its metric, where one is known."""
    rate = metric.startswith("tstr_") | metric.startswith("trtr_")
    gap = metric == "utility_gap"
    floor_only = metric.startswith("HR_") | metric.startswith("Expert_") | metric.isin("LLM", "LLM_accumulated", "Copy")
    lower = F.when(gap, F.lit(-1.0)).when(rate | floor_only, F.lit(0.0))
    upper = F.when(gap | rate, F.lit(1.0))
    # greatest/least skip nulls, so an unknown bound leaves the value alone
    return (
        F.when(low.isNotNull(), F.greatest(low, lower)),
        F.when(high.isNotNull(), F.least(high, upper)),
    )


def curve_points(
    pooled_rows: DataFrame, band_min_n: int = 5, point_min_n: int = 1, ignore_n: bool = False
) -> DataFrame:
    """Plot-ready curve rows of a long pooled summary.

    Points with too few values are dropped, bands on fewer than ``band_min_n``
    values collapse onto the mean, and bands are clipped to physical ranges.
    """
    rows = pooled_rows.filter(F.col("mean").isNotNull())
    if not ignore_n:
        rows = rows.filter(F.col("n") >= point_min_n)
    weak = F.lit(False) if ignore_n else F.col("n") < band_min_n
    low, high = (
        F.when(weak, F.col("mean")).otherwise(F.coalesce(F.col(side), F.col("mean"))) for side in ("low", "high")
    )
    low, high = clip_low_high(F.col("metric"), low, high)
    return rows.withColumns({"low": low, "high": high})
