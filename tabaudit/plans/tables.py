"""Print tables: generations as columns, formatted cells, reader-facing labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit import model as m
from tabaudit.functions.columns import label_map

# Reader-facing texts (fixed values).
NO_PAIR = "n/a (n<2 chains with both onsets defined)"
NO_VARIANCE = "n/a (no variance in onset generation)"
ZERO_OFFSET = "n/a (all offsets = 0 generations)"
NO_RANKING = "n/a (fewer than 2 seed-pairs or generators with a complete ranking)"
GROUP_LABELS = {
    "base": "Full dataset", "core": "Core dataset",
    "base_excl_rtvae": "Full dataset, excluding RTVAE", "core_excl_rtvae": "Core dataset, excluding RTVAE",
}


# Reader-facing names of onset directions (fixed values).
DIRECTION_LABELS = {"increase": "Increase", "decrease": "Decrease"}


def in_print_order(df: DataFrame, within: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` of a print table with each row's place, from 1, inside its block."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def generation_columns(cells: DataFrame, generations: list[int], keys: list[str] = ["metric", "generator"]) -> DataFrame:
    """keys, gen_<g>...: one text column per generation, '' where a cell is missing."""
    return cells.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("generation") == g, F.col("cell"))), F.lit("")).alias(f"gen_{g}") for g in generations]
    )


def metric_table(pooled: DataFrame, generations: list[int], metrics: list[str] | None = None) -> DataFrame:
    """'mean ± width' with the full width of the interval, four decimals."""
    rows = pooled.filter(F.col("metric").isin(*metrics)) if metrics else pooled
    cell = F.format_string("%.4f ± %.4f", F.col("mean"), F.col("high") - F.col("low"))
    return generation_columns(rows.withColumn("cell", F.when(F.col("mean").isNotNull(), cell)), generations)


def mean_ci_percent(mean: Column, high: Column) -> Column:
    """'mean% ± half width%' with one decimal."""
    return F.format_string("%.1f%% ± %.1f%%", mean * 100, (high - mean) * 100)


def median_range_percent(values: Column) -> Column:
    """'median% (min%–max%)' of a sorted array of fractions; one value stands alone."""
    n = F.size(values)
    lower = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    upper = F.try_element_at(values, (F.floor(n / 2) + 1).cast("int"))
    middle = (lower + upper) / 2 * 100
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.format_string("%.1f%%", F.try_element_at(values, F.lit(1)) * 100))
        .otherwise(
            F.format_string(
                "%.1f%% (%.1f%%–%.1f%%)", middle, F.try_element_at(values, F.lit(1)) * 100, F.try_element_at(values, F.lit(-1)) * 100
            )
        )
    )


def novelty_rate_cells(pooled: DataFrame) -> DataFrame:
    """Cells of the HR and HR* rows from pooled (generator, generation, bin, metric) statistics."""
    names = label_map({"HR": "HR", "HR_adjusted": "HR*"}, F.col("metric"))
    label = F.concat(names, F.lit(" (bin="), F.col("bin").cast("string"), F.lit(")"))
    return pooled.select("generator", "generation", label.alias("metric"), mean_ci_percent(F.col("mean"), F.col("high")).alias("cell"))


def rule_rate_cells(pooled: DataFrame) -> DataFrame:
    """Cells of the any-rule row and of the impossible share ('NA' when no rule fired)."""
    both = pooled.groupBy("generator", "generation").agg(
        *[
            F.max(F.when(F.col("metric") == f"Expert_{kind}", F.col(stat))).alias(f"{kind}_{stat}")
            for kind, stat in (("any", "mean"), ("any", "high"), ("impossible", "mean"))
        ]
    )
    share = F.when(
        F.col("any_mean") > 0, F.format_string("%.1f%%", 100 * F.try_divide(F.col("impossible_mean"), F.col("any_mean")))
    ).otherwise(F.lit("NA"))
    cells = F.array(
        F.struct(F.lit("Expert rules (all) %").alias("metric"), mean_ci_percent(F.col("any_mean"), F.col("any_high")).alias("cell")),
        F.struct(F.lit("% impossible expert rules").alias("metric"), share.alias("cell")),
    )
    return both.select("generator", "generation", F.inline(cells))


def rule_rate_rows(pooled: DataFrame, generations: list[int]) -> DataFrame:
    return generation_columns(rule_rate_cells(pooled), generations)


def reviewer_cells(pooled: DataFrame, per_chain: DataFrame) -> DataFrame:
    """Reviewer-only row, and rules + reviewer from single chains where they exist.

    ``per_chain`` (generator, generation, value) holds at most one value per
    chain and generation.  Where it has none, the pooled mean is shown with a
    tag that says so.
    """
    chains = per_chain.filter(F.col("value").isNotNull()).groupBy("generator", "generation").agg(
        median_range_percent(F.array_sort(F.collect_list("value"))).alias("__exact")
    )
    pooled_cell = mean_ci_percent(F.col("mean"), F.col("high"))
    only = pooled.filter((F.col("metric") == "LLM") & F.col("mean").isNotNull()).select(
        "generator", "generation", F.lit("LLM only %").alias("metric"), pooled_cell.alias("cell")
    )
    tagged = F.concat(
        pooled_cell, F.lit(" [mean±CI - no raw chain values found] (n="), F.col("n").cast("string"), F.lit(")")
    )
    combined = (
        pooled.filter((F.col("metric") == "LLM_accumulated") & F.col("mean").isNotNull())
        .select("generator", "generation", tagged.alias("__pooled"))
        .join(chains, ["generator", "generation"], "full_outer")
        .select("generator", "generation", F.lit("Expert rules + LLM %").alias("metric"), F.coalesce("__exact", "__pooled").alias("cell"))
    )
    return only.unionByName(combined)


def flag_rate_table(
    novelty: DataFrame, rule_rates: DataFrame, reviewer: DataFrame, per_chain: DataFrame, generations: list[int]
) -> DataFrame:
    """The whole flag-rate table: novelty, rules and reviewer rows per generator."""
    cells = novelty_rate_cells(novelty).unionByName(rule_rate_cells(rule_rates)).unionByName(reviewer_cells(reviewer, per_chain))
    return generation_columns(cells, generations)


def timing_table(timing: DataFrame, keys: list[str]) -> DataFrame:
    """Paired timing tests with a text in place of every undefined number."""

    def text(name: str) -> Column:
        return F.format_string("%.6f", F.col(name))

    few = F.col("n_pairs") < 2
    flat = F.col("tau").isNull()
    same = F.col("wilcoxon_stat").isNull()
    return timing.select(
        *keys, F.col("subset").alias("Subset"), F.col("n_pairs").alias("N chains"),
        F.when(few, F.lit(NO_PAIR)).when(flat, F.lit(NO_VARIANCE)).otherwise(text("tau")).alias("Kendall's tau"),
        F.when(few, F.lit(NO_PAIR)).when(flat, F.lit(NO_VARIANCE)).otherwise(text("tau_p")).alias("Kendall's tau p-value"),
        F.when(few, F.lit(NO_PAIR)).when(same, F.lit(ZERO_OFFSET)).otherwise(text("wilcoxon_stat")).alias("Wilcoxon statistic"),
        F.when(few, F.lit(NO_PAIR)).when(same, F.lit(ZERO_OFFSET)).otherwise(text("wilcoxon_p")).alias("Wilcoxon p-value"),
        F.when(few, F.lit(NO_PAIR)).otherwise(text("median_offset")).alias("Median offset (generations)"),
    )


def crossing_table(counts: DataFrame, metrics: dict[str, tuple[float, str]]) -> DataFrame:
    """Threshold, direction and crossed chains of every metric; counts of no chain included."""
    rows = [(name, float(t), DIRECTION_LABELS[d]) for name, (t, d) in metrics.items()]
    listed = counts.sparkSession.createDataFrame(rows, "metric string, threshold double, direction string")
    return listed.join(counts, "metric", "left").select(
        F.col("metric").alias("Metric"), F.col("threshold").alias("Threshold"), F.col("direction").alias("Direction of change at onset"),
        F.coalesce("n_crossed", F.lit(0)).alias("N chains crossed"), F.coalesce("n_total", F.lit(0)).alias("N chains total"),
    )


def metric_timing_table(timing: DataFrame, keys: dict[str, str], facts: list[str] = []) -> DataFrame:
    """Paired timing of two onsets: ``keys`` maps columns to printed names, ``facts`` are printed columns as they are."""
    text = timing_table(timing.select("*"), [*keys, *facts]).withColumnRenamed("N chains", "N with both onsets defined")
    return text.withColumnsRenamed(keys)


def concordance_table(w: DataFrame) -> DataFrame:
    """Kendall's W per group and subset, undefined values explained."""

    def text(name: str) -> Column:
        return F.when(F.col("w").isNull(), F.lit(NO_RANKING)).otherwise(F.format_string("%.6f", F.col(name)))

    return group_labels(w).select(
        "Group", F.col("subset").alias("Subset"), text("w").alias("Kendall's W"), F.col("n_seed_pairs").alias("N seed-pairs"),
        F.col("n_generators").alias("N generators"), text("chi2").alias("Chi-square statistic"),
        F.col("df").alias("Degrees of freedom"), text("p").alias("p-value"),
    )


def group_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("Group", label_map(GROUP_LABELS, F.col("group"), F.col("group")))


def cox_table(cox: DataFrame) -> DataFrame:
    """Hazard ratio with the chains the model could use."""
    excluded = F.col("n_chains") - F.col("n_chains_in_model")
    note = F.when(
        excluded > 0,
        F.format_string("%d chain(s) excluded (failure observed at generation 0 leaves no risk interval to model)", excluded),
    ).otherwise(F.lit("none excluded"))
    return cox.select(
        F.col("covariate").alias("Covariate"), F.col("hazard_ratio").alias("Hazard ratio"),
        F.col("ci_low").alias("95% CI (lower)"), F.col("ci_high").alias("95% CI (upper)"), F.col("p").alias("p-value"),
        F.format_string("%d of %d", F.col("n_chains_in_model"), F.col("n_chains")).alias("Chains in model"),
        note.alias("Exclusion note"), F.lit("Data seed and generator").alias("Stratification"),
    )


def calibration_table(spark: SparkSession) -> DataFrame:
    """Onset threshold and direction of every metric."""
    rows = [(name, float(t), d) for name, (t, d) in m.ONSET_METRICS.items()]
    return spark.createDataFrame(rows, "metric string, threshold double, direction string")
