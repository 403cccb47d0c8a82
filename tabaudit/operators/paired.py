"""Paired timing tests: Kendall's tau-b and the Wilcoxon signed-rank test.

Generations are small whole numbers, so every test runs on a contingency table
of at most (last generation + 1)^2 cells per comparison, whatever the number
of chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit import model as m
from tabaudit.functions.tails import KENDALL_EXACT, WILCOXON_EXACT, kendall_p, wilcoxon_p
from tabaudit.operators.subsets import cells_by_subset, subset_list
from tabaudit.sources.sinks import reliable


def tau_b(cells: DataFrame, keys: list[str], last: int = m.LAST_GENERATION) -> DataFrame:
    """Tau-b per key from cells (x, y, n) with y in 0..last; another y fails the job.

    Rows of the contingency table are walked in order of x with running column
    sums, which counts concordant and discordant pairs without forming pairs.
    """
    ys = range(last + 1)
    outside = F.raise_error(F.format_string(f"generation %s is beyond 0..{last}", F.col("y").cast("string")))
    cells = cells.withColumn("y", F.when(F.col("y").between(0, last), F.col("y")).otherwise(outside.cast("bigint")))
    by_x = cells.groupBy(*keys, "x").agg(
        *[F.expr(f"coalesce(sum(CASE WHEN y = {j} THEN n END), 0L) AS c{j}") for j in ys]
    )
    before = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    seen = by_x.selectExpr("*", *[f"coalesce(sum(c{j}) {before}, 0L) AS b{j}" for j in ys])
    # p<j>: points met before with a smaller y than j
    prefix = seen.selectExpr(
        *keys, *[f"c{j}" for j in ys], *[f"{' + '.join(f'b{i}' for i in range(j)) or '0L'} AS p{j}" for j in range(last + 2)],
        f"{' + '.join(f'c{j}' for j in ys)} AS r",
    )
    concordant = " + ".join(f"c{j} * p{j}" for j in ys)
    discordant = " + ".join(f"c{j} * (p{last + 1} - p{j + 1})" for j in ys)

    def ties(t: str, kind: int) -> str:
        t = f"CAST({t} AS DOUBLE)"
        tail = {0: "/ 2", 1: f"* ({t} - 2)", 2: f"* (2 * {t} + 5)"}[kind]
        return f"{t} * ({t} - 1) {tail}"

    sums = prefix.groupBy(*keys).agg(
        F.expr(f"sum({concordant}) AS con"), F.expr(f"sum({discordant}) AS dis"), F.expr("sum(r) AS n"),
        *[F.expr(f"sum({ties('r', k)}) AS x{k}") for k in range(3)],
        *[F.expr(f"sum(c{j}) AS t{j}") for j in ys],
    )
    out = sums.selectExpr(
        *keys, "n", "con", "dis", "x0", "x1", "x2",
        *[f"{' + '.join(ties(f't{j}', k) for j in ys)} AS y{k}" for k in range(3)],
        "CAST(n AS DOUBLE) * (n - 1) AS pairs",
    )
    scale = "(sqrt(pairs / 2 - x0) * sqrt(pairs / 2 - y0))"
    variance = (
        "((pairs * (2 * n + 5) - x2 - y2) / 18 + coalesce(try_divide(2 * x0 * y0, pairs), 0)"
        " + coalesce(try_divide(x1 * y1, 9 * pairs * (n - 2)), 0))"
    )
    return out.selectExpr(
        *keys, "n", "con AS concordant", "dis AS discordant",
        f"try_divide(CAST(con - dis AS DOUBLE), {scale}) AS tau",
        f"CASE WHEN {scale} > 0 THEN try_divide(CAST(con - dis AS DOUBLE), sqrt({variance})) END AS tau_z",
        "x0 = 0 AND y0 = 0 AS tau_untied",
    )


def signed_rank(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Wilcoxon statistic per key from cells (d, n); zero differences are left out."""
    size = (
        cells.filter(F.col("d") != 0)
        .groupBy(*keys, F.abs("d").alias("a"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("n"))), F.lit(0)).alias("pos"),
            F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("n"))), F.lit(0)).alias("neg"),
        )
    )
    before = Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("pos") + F.col("neg")
    rank = F.coalesce(F.sum(t).over(before), F.lit(0)) + (t + 1) / 2.0
    ranked = size.withColumn("rank", rank)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("rank")).alias("w_plus"), F.sum(F.col("neg") * F.col("rank")).alias("w_minus"),
        F.sum(t).alias("nz"), F.sum((t * t * t - t).cast("double")).alias("tie"),
    )
    n = F.col("nz").cast("double")
    statistic = F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie") / 48.0)
    return sums.select(
        *keys, F.col("nz").alias("n_nonzero"), "w_plus", "w_minus", statistic.alias("wilcoxon_stat"),
        F.try_divide(statistic - n * (n + 1) / 4.0, spread).alias("wilcoxon_z"),
        (F.col("tie") == 0).alias("wilcoxon_untied"),
    )


def paired_timing(
    chains: DataFrame, keys: list[str], last: int = m.LAST_GENERATION, p_values: bool = True, method: str = "auto"
) -> DataFrame:
    """Timing tests of two event generations per key and leave-one-seed-out subset.

    ``chains`` holds keys, dseed, mseed, x, y; x and y are null unless both
    events happened.  All chains of a key decide the list of subsets.  Fewer
    than two pairs give only n; equal generations everywhere skip Wilcoxon.
    p values are exact for small samples without ties and normal else
    (``method`` "auto"), or always "normal"; ``tau_p_method`` and
    ``wilcoxon_p_method`` say which.
    """
    # counted once and kept: everything below reads these few rows several times
    base = reliable(chains.groupBy(*keys, "dseed", "mseed", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    universe = base.select(*keys, "dseed", "mseed").distinct()
    pairs = base.filter("x IS NOT NULL AND y IS NOT NULL")
    cells = reliable(cells_by_subset(pairs, universe, keys, ["x", "y"], ["n"]))
    over = [*keys, "subset"]
    tau = tau_b(cells, over, last)
    diffs = cells.groupBy(*over, (F.col("y") - F.col("x")).alias("d")).agg(F.sum("n").alias("n"))
    middle = diffs.groupBy(*over).agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("median_offset"))
    wilcoxon = signed_rank(diffs, over)
    joined = (
        subset_list(universe, keys)
        .select(*over)
        .join(tau, over, "left")
        .join(middle, over, "left")
        .join(wilcoxon, over, "left")
    )
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    enough = n >= 2

    def when_enough(name: str) -> Column:
        return F.when(enough, F.col(name)).alias(name)

    out = joined.select(
        *over, n.alias("n_pairs"), when_enough("concordant"), when_enough("discordant"), when_enough("tau"),
        when_enough("median_offset"), when_enough("w_plus"), when_enough("w_minus"), when_enough("wilcoxon_stat"),
        when_enough("tau_z"), when_enough("wilcoxon_z"), "tau_untied", "wilcoxon_untied", "n_nonzero",
    )
    if p_values:
        untied = F.col("wilcoxon_untied") & (F.col("n_nonzero") == F.col("n_pairs"))
        exact = {"tau": F.col("tau_untied") & (F.col("n_pairs") <= KENDALL_EXACT), "wilcoxon": untied & (F.col("n_nonzero") <= WILCOXON_EXACT)}
        exact = {k: F.coalesce(e, F.lit(False)) if method == "auto" else F.lit(False) for k, e in exact.items()}
        out = out.withColumns(
            {
                "tau_p": kendall_p(F.col("tau_z"), F.col("n_pairs"), F.col("discordant"), exact["tau"]),
                "wilcoxon_p": wilcoxon_p(F.col("wilcoxon_z"), F.col("n_nonzero"), F.col("wilcoxon_stat"), exact["wilcoxon"]),
            }
        )
        names = {k: F.when(F.col(f"{k}_p").isNotNull(), F.when(e, F.lit("exact")).otherwise(F.lit("normal"))) for k, e in exact.items()}
        out = out.withColumns({f"{k}_p_method": name for k, name in names.items()})
    return out.drop("tau_untied", "wilcoxon_untied", "n_nonzero")


def onset_failure_chains(joined: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Chains with onset (x) and failure (y) generation for ``paired_timing``."""
    both = "coalesce(failure_event = 1 AND onset_crossed, false)"
    return joined.withColumns(keys).selectExpr(
        *keys, "dseed", "mseed",
        f"CASE WHEN {both} THEN onset_generation END AS x", f"CASE WHEN {both} THEN failure_time END AS y",
    )


def onset_onset_chains(
    onsets: DataFrame, left_metric: str, right_metrics: list[str], by_generator: bool = False,
    chain: list[str] = m.CHAIN_KEYS,
) -> DataFrame:
    """Chains with one metric's onset (x) and each of several others' (y)."""
    keys = ["qa_metric"] + (["generator"] if by_generator else [])
    left = onsets.filter(F.col("metric") == left_metric).select(*chain, F.col("onset_generation").alias("x"))
    right = onsets.filter(F.col("metric").isin(*right_metrics)).select(
        *chain, F.col("metric").alias("qa_metric"), F.col("onset_generation").alias("y")
    )
    return left.join(right, chain).selectExpr(
        *keys, "dseed", "mseed", "CASE WHEN y IS NOT NULL THEN x END AS x", "CASE WHEN x IS NOT NULL THEN y END AS y"
    )
