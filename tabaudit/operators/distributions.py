"""Distributions of single features: real against generated.

Everything starts from value counts (group, value, n).  Measured features are
rounded to at most one decimal at ingest, so the number of distinct values is
bounded by their measurable range; the counts combine map-side, and no group
of raw values is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.columns import number_text
from tabaudit.sources.sinks import reliable

CLIP_PERCENTILES = (0.005, 0.995)
GRID_POINTS = 400
BANDWIDTH_SCALE = 1.5
#: Distinct values of a series that one task may order; beyond, ranks are searched in cells, level by level.
ONE_TASK_VALUES, CELLS, CELL_LEVELS = 200_000, 1024, 2
#: Distinct values of a series up to which densities are exact, and cells per bandwidth beyond.
EXACT_VALUES, FINE_CELLS = 50_000, 100


def value_counts(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value, n of numeric features; values that are not numbers are dropped."""
    types = dict(df.dtypes)
    items = ", ".join(f"named_struct('feature', '{c}', 'value', {number_text(types, c)})" for c in features)
    return (
        df.selectExpr(*keys, f"inline(array({items}))")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def percentiles(counts: DataFrame, keys: list[str], points: dict[str, float], in_one_task: int = ONE_TASK_VALUES) -> DataFrame:
    """Exact linear-interpolated percentiles per key, from value counts.

    Keys with few distinct values are ranked in one window each.  Where any has
    more than ``in_one_task``, the wanted ranks are looked for in equal cells
    of the value range, and again in equal cells of the cells that hold them;
    only the values of those are ranked, so no task orders a whole series.
    """
    largest = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__values")).agg(F.max("__values")).first()[0] or 0
    if largest <= in_one_task:
        return _in_one_window(counts, keys, points)
    extent = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    ranks = []
    for name, p in points.items():
        place = (F.col("n") - 1) * F.lit(p)
        ranks += [F.struct(F.lit(f"{side}_{name}").alias("name"), f(place).cast("bigint").alias("rank")) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    wanted = extent.select(*keys, "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.inline(F.array(*ranks)))
    for _ in range(CELL_LEVELS):
        wanted = reliable(_narrowed(counts, wanted, keys))
    found = _ranked(counts, wanted, keys)
    sides = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"{side}_{n}", F.col("value"))).alias(f"__{side}_{n}") for n in points for side in ("lo", "hi")])
    values = []
    for name, p in points.items():
        place = (F.col("n") - 1) * F.lit(p)
        values.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (place - F.floor(place))).alias(name))
    return extent.select(*keys, "n").join(sides, keys).select(*keys, "n", *values)


def _in_one_window(counts: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("value")
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.withColumns(
        {"__upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__total": total}
    )

    def at(position: Column) -> Column:
        """Smallest value whose cumulative count exceeds the 0-based position."""
        return F.min(F.when(F.col("__upto") > position, F.col("value")))

    aggs = [F.max("__total").alias("n")]
    for name, p in points.items():
        place = (F.col("__total") - 1) * F.lit(p)
        aggs += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"),
                 F.max(place - F.floor(place)).alias(f"__w_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    values = [
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n) for n in points
    ]
    return out.select(*keys, "n", *values)


def _inside(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Value counts within the regions that hold wanted ranks; regions are a few per series, series as many as panels."""
    regions = wanted.select(*keys, "lo", "hi", "before").distinct()
    return counts.join(regions, keys).filter(F.col("value").between(F.col("lo"), F.col("hi")))


def _narrowed(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with regions cut down to the cell that holds the rank."""
    region = [*keys, "lo", "hi", "before"]
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    cell = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(CELLS))), F.lit(CELLS - 1)).cast("int")
    cells = _inside(counts, wanted, keys).groupBy(*region, cell.alias("cell")).agg(
        F.sum("n").alias("cell_n"), F.min("value").alias("cell_lo"), F.max("value").alias("cell_hi")
    )
    # at most CELLS rows of a region meet here
    order = Window.partitionBy(*region).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("cell_before", F.col("before") + F.coalesce(F.sum("cell_n").over(order), F.lit(0)))
    holds = (F.col("rank") >= F.col("cell_before")) & (F.col("rank") < F.col("cell_before") + F.col("cell_n"))
    return placed.join(wanted, region).filter(holds).select(*keys, F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"), F.col("cell_before").alias("before"), "name", "rank")


def _ranked(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, value): the value at each wanted rank."""
    region = [*keys, "lo", "hi", "before"]
    order = Window.partitionBy(*region).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = _inside(counts, wanted, keys).withColumn("upto", F.col("before") + F.sum("n").over(order))
    return upto.join(wanted, region).filter(F.col("upto") > F.col("rank")).groupBy(*keys, "name").agg(F.min("value").alias("value"))


def clip_range(counts: DataFrame, panel: list[str], series: list[str]) -> DataFrame:
    """panel, lo, hi: union of the clip ranges of all series of a panel.

    A degenerate range falls back to min/max, then to a width of one.
    """
    per_series = percentiles(counts, [*panel, *series], {"p_lo": CLIP_PERCENTILES[0], "p_hi": CLIP_PERCENTILES[1]})
    union = per_series.groupBy(*panel).agg(F.min("p_lo").alias("lo"), F.max("p_hi").alias("hi"))
    extent = counts.groupBy(*panel).agg(F.min("value").alias("__min"), F.max("value").alias("__max"))
    flat = F.col("hi") <= F.col("lo")
    lo = F.when(flat, F.col("__min")).otherwise(F.col("lo"))
    top = F.when(flat, F.col("__max")).otherwise(F.col("hi"))
    return union.join(extent, panel).select(*panel, lo.alias("lo"), F.when(top <= lo, lo + 1.0).otherwise(top).alias("hi"))


def density_histogram(counts: DataFrame, ranges: DataFrame, panel: list[str], series: list[str], bins: int) -> DataFrame:
    """panel, series, bin (1-based), n, density over [lo, hi]; values outside are left out of the bins only."""
    placed = counts.join(ranges, panel)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    number = F.least(
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))) + 1, F.lit(bins)
    )
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    totals = counts.groupBy(*panel, *series).agg(F.sum("n").alias("__total"))
    binned = placed.filter(inside).groupBy(*panel, *series, number.cast("int").alias("bin"), width.alias("__w")).agg(
        F.sum("n").alias("n")
    )
    return binned.join(totals, [*panel, *series]).select(
        *panel, *series, "bin", "n", (F.col("n") / (F.col("__total") * F.col("__w"))).alias("density")
    )


def kernel_density(
    counts: DataFrame, ranges: DataFrame, panel: list[str], series: list[str], points: int = GRID_POINTS,
    exact_values: int = EXACT_VALUES, fine: int = FINE_CELLS,
) -> DataFrame:
    """panel, series, point, x, density: Gaussian kernel density on an even grid.

    Bandwidth h is Scott's factor times 1.5 times the standard deviation.  Series
    with fewer than five values or no spread have no curve.  Equal values are
    weighted once.  Where any series has more than ``exact_values`` distinct
    values, they are first shared out between the two nearest points of a grid
    of ``fine`` cells per h, so rows no longer grow with the values; that
    changes a density by no more than 0.05 / (h * fine * fine).
    """
    keys = [*panel, *series]
    moments = counts.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("__n"), F.sum(F.col("n") * F.col("value")).alias("__s"),
        F.min("value").alias("__min"), F.max("value").alias("__max"),
    ).filter((F.col("__n") >= 5) & (F.col("__max") > F.col("__min")))
    centred = counts.join(moments, keys).withColumn("__dev", F.col("value") - F.col("__s") / F.col("__n"))
    spread = centred.groupBy(*keys).agg(
        F.max("__n").alias("__n"), F.sum(F.col("n") * F.col("__dev") * F.col("__dev")).alias("__ss")
    )
    bandwidth = F.sqrt(F.col("__ss") / (F.col("__n") - 1.0)) * F.pow(F.col("__n"), F.lit(-0.2)) * F.lit(BANDWIDTH_SCALE)
    scaled = spread.select(*keys, "__n", bandwidth.alias("__h")).join(ranges, panel)
    most = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k")).agg(F.max("__k")).first()[0] or 0
    if most > exact_values:
        counts = _shared_out(counts, scaled.select(*keys, "__h"), keys, fine)
    grid = counts.join(scaled, keys).select(
        *keys, "value", "n", "__n", "__h", "lo", "hi",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    )
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(points - 1))
    z = (F.col("x") - F.col("value")) / F.col("__h")
    return (
        grid.withColumn("x", x)
        .groupBy(*keys, "point", "x", "__n", "__h")
        .agg(F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z)).alias("__k"))
        .select(*keys, "point", "x", (F.col("__k") / (F.col("__n") * F.col("__h") * F.lit(2.5066282746310002))).alias("density"))
    )


def _shared_out(counts: DataFrame, bandwidths: DataFrame, keys: list[str], fine: int) -> DataFrame:
    """Value counts moved to the points of a fine grid, each value to its two neighbours in proportion."""
    place = F.col("value") * F.lit(float(fine)) / F.col("__h")
    low = F.floor(place)
    right = place - low
    parts = F.array(F.struct(low.alias("k"), ((1.0 - right) * F.col("n")).alias("w")), F.struct((low + 1).alias("k"), (right * F.col("n")).alias("w")))
    moved = counts.join(bandwidths, keys).select(*keys, "__h", F.inline(parts)).groupBy(*keys, "__h", "k").agg(F.sum("w").alias("n"))
    return moved.select(*keys, (F.col("k") * F.col("__h") / F.lit(float(fine))).alias("value"), "n")


def level_counts(df: DataFrame, keys: list[str], features: list[str], missing: str | None = None) -> DataFrame:
    """keys, feature, level, n of categorical features; ``missing`` names nulls instead of dropping them."""
    items = ", ".join(f"named_struct('feature', '{c}', 'level', CAST(`{c}` AS STRING))" for c in features)
    rows = df.selectExpr(*keys, f"inline(array({items}))")
    rows = rows.withColumn("level", F.coalesce("level", F.lit(missing))) if missing else rows.filter("level is not null")
    return rows.groupBy(*keys, "feature", "level").agg(F.count(F.lit(1)).alias("n"))


def proportions(counts: DataFrame, panel: list[str], role: str, real: str) -> DataFrame:
    """panel, level, real_share, synthetic_share over the union of levels (absent = 0)."""

    def share(side: DataFrame, name: str) -> DataFrame:
        totals = side.groupBy(*panel).agg(F.sum("n").alias("__t"))
        return side.groupBy(*panel, "level").agg(F.sum("n").alias("__n")).join(totals, panel).select(
            *panel, "level", (F.col("__n") / F.col("__t")).alias(name)
        )

    a = share(counts.filter(F.col(role) == real), "real_share")
    b = share(counts.filter(F.col(role) != real), "synthetic_share")
    joined = a.join(b, [*panel, "level"], "full_outer")
    return joined.na.fill(0.0, ["real_share", "synthetic_share"])


def top_levels(counts: DataFrame, panel: list[str], k: int = 20) -> DataFrame:
    """The k most frequent levels per panel (ties by name) and the number of levels."""
    # ranking runs over distinct levels, not over records
    order = Window.partitionBy(*panel).orderBy(F.desc("n"), "level")
    ranked = counts.withColumns(
        {"position": F.row_number().over(order), "n_levels": F.count(F.lit(1)).over(Window.partitionBy(*panel))}
    )
    return ranked.filter(F.col("position") <= k)


def feature_types(df: DataFrame, features: list[str], declared_numeric: list[str], declared_categorical: list[str]) -> DataFrame:
    """feature, numeric_share, n_distinct, is_numeric.

    Declared numeric features stay numeric while at least 80 % of their values
    are numbers; undeclared ones also need more than 15 distinct values.
    """
    types = dict(df.dtypes)
    items = ", ".join(
        f"named_struct('feature', '{c}', 'level', CAST(`{c}` AS STRING), 'ok', ({number_text(types, c)}) IS NOT NULL)"
        for c in features
    )
    per_level = (
        df.selectExpr(f"inline(array({items}))").filter(F.col("level").isNotNull()).groupBy("feature", "level", "ok")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stats = per_level.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        (F.sum(F.when(F.col("ok"), F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("numeric_share"),
    )
    enough = F.col("numeric_share") >= 0.8
    numeric = (
        F.when(F.col("feature").isin(*declared_numeric), enough)
        .when(F.col("feature").isin(*declared_categorical), F.lit(False))
        .otherwise(enough & (F.col("n_distinct") > 15))
    )
    return stats.select("feature", "numeric_share", "n_distinct", numeric.alias("is_numeric"))


# ------------------------------------------------------------- composition
def rule_composition(
    rule_means: DataFrame, bar: list[str], min_peak: float = 5.0, max_segments: int = 12
) -> DataFrame:
    """bar, rule, share, segment, total, n_rules: each rule's share of all firings of a bar.

    ``rule_means`` holds bar, rule and value.  Rules whose peak share over all
    bars reaches ``min_peak`` percent are named (at most ``max_segments``, the
    highest peaks first); the others form the segment "Other".
    """
    fired = rule_means.filter(F.col("value") > 0)
    totals = fired.groupBy(*bar).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_rules_fired"))
    shares = fired.join(totals, bar).withColumn("share", F.lit(100.0) * F.col("value") / F.col("total"))
    # one row per rule of the catalogue, so this ranking is a few dozen rows
    peaks = shares.groupBy("rule").agg(F.max("share").alias("peak"))
    named = (
        peaks.filter(F.col("peak") >= min_peak).orderBy(F.desc("peak"), "rule").limit(max_segments)
        .select("rule", F.col("rule").alias("segment"))
    )
    return shares.join(named, "rule", "left").select(
        *bar, "rule", F.coalesce("segment", F.lit("Other")).alias("segment"), "share", "total", "n_rules_fired"
    )


def composition_segments(composition: DataFrame, bar: list[str]) -> DataFrame:
    """bar, segment, share, total, n_rules_fired: the drawn segments of each bar."""
    return composition.groupBy(*bar, "segment").agg(
        F.sum("share").alias("share"), F.max("total").alias("total"), F.max("n_rules_fired").alias("n_rules_fired")
    )
