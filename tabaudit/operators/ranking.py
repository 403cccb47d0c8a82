"""Which generator fails first?  Ranks per seed pair and Kendall's W."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit import model as m
from tabaudit.functions.tails import chi2_p
from tabaudit.operators.subsets import cells_by_subset, group_members, subset_list
from tabaudit.sources.sinks import reliable

_PAIR = ["group", "dseed", "mseed"]


def rank_rows(events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """group, dseed, mseed, generator, rank (1 = failed first) of every member chain.

    Ties in failure time share their mean rank and all censored chains share
    the mean of the ranks left over.  ``complete`` tells whether every
    generator of the group is present in the pair; the rank of an incomplete
    pair is null.  A window never holds more rows than a group has generators.
    """
    members = group_members(events, groups)
    pair = Window.partitionBy(*_PAIR)
    status = Window.partitionBy(*_PAIR, "event")
    same = Window.partitionBy(*_PAIR, "event", "time")
    failed = F.col("event") == 1
    wide = members.withColumns(
        {
            "complete": F.count(F.lit(1)).over(pair) == F.col("group_size"),
            "__failed": F.count_if(failed).over(pair),
            "__tied": F.when(failed, F.count(F.lit(1)).over(same)).otherwise(F.count(F.lit(1)).over(status)),
            "__place": F.rank().over(status.orderBy("time")),
            "incomplete_censoring": F.max((F.col("event") == 0) & (F.col("time") < m.LAST_GENERATION)).over(pair),
        }
    )
    rank = F.when(failed, F.col("__place") + (F.col("__tied") - 1) / 2.0).otherwise(
        (F.col("__failed") + 1 + F.col("group_size")) / 2.0
    )
    return wide.select(
        *_PAIR, "generator", "position", "group_size", "complete", "incomplete_censoring",
        F.when(F.col("complete"), rank).alias("rank"), F.col("__tied").alias("tied"),
    )


def incomplete_pairs(ranks: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """Seed pairs that lack generators of their group, with the missing names."""
    expected = F.create_map(*[x for g, names in groups.items() for x in (F.lit(g), F.array(*[F.lit(n) for n in names]))])
    present = ranks.filter(~F.col("complete")).groupBy(*_PAIR).agg(F.collect_set("generator").alias("__p"))
    missing = F.array_except(F.try_element_at(expected, F.col("group")), F.col("__p"))
    return present.select(*_PAIR, F.array_join(missing, ", ").alias("missing_generators"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Mean, median and range of each generator's rank over complete seed pairs."""
    return (
        ranks.filter("complete")
        .groupBy("group", "generator")
        .agg(
            F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"),
            F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
            F.count_if(F.col("rank") == 1).alias("n_ranked_1st"), F.count(F.lit(1)).alias("n_seed_pairs"),
        )
    )


def kendalls_w(ranks: DataFrame, p_values: bool = True) -> DataFrame:
    """Tie-corrected W and the Friedman statistic per group and leave-one-seed-out subset."""
    ranks = reliable(ranks)
    complete = ranks.filter("complete").withColumns(
        # summed over a pair this is sum(t^3 - t) over its tie groups
        {"ties": (F.col("tied") * F.col("tied") - 1).cast("double"), "pairs": F.lit(1).cast("bigint")}
    )
    sizes = F.max("group_size").alias("n_generators")
    cells = cells_by_subset(
        complete, ranks.select("group", "dseed", "mseed").distinct(), ["group"],
        ["generator", "group_size"], ["rank", "ties", "pairs"],
    )
    over = ["group", "subset"]
    sums = cells.groupBy(*over).agg(
        F.sum("rank").alias("r"), F.sum(F.col("rank") * F.col("rank")).alias("r2"),
        F.sum("ties").alias("ties"), F.max("pairs").alias("m"), sizes,
    )
    n, pairs = F.col("n_generators").cast("double"), F.col("m").cast("double")
    s = F.col("r2") - F.col("r") * F.col("r") / n
    bottom = pairs * pairs * (n * n * n - n) - pairs * F.col("ties")
    w = F.when(bottom > 0, F.try_divide(12.0 * s, bottom))
    out = sums.select(
        *over, F.col("m").alias("n_seed_pairs"), F.col("n_generators").cast("bigint").alias("n_generators"),
        w.alias("w"), (pairs * (n - 1) * w).alias("chi2"), (F.col("n_generators") - 1).cast("bigint").alias("df"),
    )
    everything = subset_list(ranks.select("group", "dseed", "mseed").distinct(), ["group"]).select(*over)
    out = everything.join(out, over, "left").withColumn("n_seed_pairs", F.coalesce("n_seed_pairs", F.lit(0)))
    return out.withColumn("p", chi2_p(F.col("chi2"), F.col("df"))) if p_values else out


def holm(tests: DataFrame, family: list[str], p: str = "p", adjusted: str = "p_holm") -> DataFrame:
    """Holm step-down adjustment of the p values of each family of tests."""
    ordered = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    size = F.count(p).over(Window.partitionBy(*family))
    stepped = tests.withColumn("__step", (size - F.row_number().over(ordered) + 1) * F.col(p))
    running = F.max("__step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(adjusted, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("__step")
