"""Novelty and copy tests of generated records against real ones.

A record is *novel* at a bin resolution when its cell - numerics replaced by
equal-width bins learned from the population, categories normalised - does not
occur in the population.  It is a *copy* when its rounded values equal a
training record of the same chain.

Two physical strategies give the same answer and are picked by a checked size:

* the population cells of every resolution are small enough to broadcast:
  one map-side pass probes all resolutions per record, nothing is shuffled but
  the per-file counts;
* otherwise (resolution, cell) pairs are pre-aggregated map-side - a collapsed
  generator that repeats one row sends one row per task - and met with the
  population cells in a shuffle join.

The forms that list records meet a bounded sketch of the known cells first, so
that only the distinct cells that may be known are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.columns import as_number, number_text
from tabaudit.functions.normalise import bin_text, copy_label_text, copy_number_text, membership_text
from tabaudit.operators import sketch

# Population cells are broadcast only below this estimated size.
BROADCAST_BYTES = 256 * 1024 * 1024
_BYTES_PER_VALUE = 32

@dataclass
class Population:
    """What the tests need to know about the real population.

    Learned in one aggregation job; only bounds and counts reach the driver.
    """

    frame: DataFrame
    numeric: list[str]
    categorical: list[str]
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    cardinality: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    cell_counts: dict[tuple[int, ...], int] = field(default_factory=dict)

    @classmethod
    def learn(cls, frame: DataFrame, numeric: list[str], categorical: list[str]) -> "Population":
        absent = [c for c in numeric + categorical if c not in frame.columns]
        if absent:
            raise ValueError(f"population lacks declared columns: {absent}")
        row = population_bounds_row(frame, numeric).first()
        bounds = {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in numeric}
        return cls(frame, list(numeric), list(categorical), bounds, {}, row["n_rows"])

    def with_cardinality(self) -> "Population":
        """Also learn the number of levels per categorical feature."""
        found = {r["feature"]: r["n_levels"] for r in level_cardinality(self.frame, self.categorical).collect()}
        self.cardinality = {c: found.get(c, 0) for c in self.categorical}
        return self

    def cells_fit_broadcast(self, resolutions: list[int]) -> bool:
        """Whether the distinct cells are small; they never outnumber rows, so only a large population has them counted."""
        width = _BYTES_PER_VALUE * (len(self.numeric) + len(self.categorical) + 1)
        if self.rows * len(resolutions) * width <= BROADCAST_BYTES:
            return True
        key = tuple(resolutions)
        if key not in self.cell_counts:
            self.cell_counts[key] = population_cells(self, resolutions).count()
        return self.cell_counts[key] * width <= BROADCAST_BYTES

    @property
    def cell_columns(self) -> list[str]:
        return [f"cell_{c}" for c in self.numeric + self.categorical]


# ------------------------------------------------------------------ learning
def population_bounds_row(frame: DataFrame, numeric: list[str]) -> DataFrame:
    """min/max of every numeric feature and the row count, in one pass."""
    pairs, types = [], dict(frame.dtypes)
    for c in numeric:
        value = as_number(types, c)
        pairs += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
    return frame.agg(F.count(F.lit(1)).alias("n_rows"), *pairs)


def population_bounds(frame: DataFrame, numeric: list[str]) -> DataFrame:
    """(feature, low, high), one row per numeric feature with a value."""
    row = population_bounds_row(frame, numeric)
    items = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("low"), F.col(f"max_{c}").alias("high"))
            for c in numeric
        ]
    )
    return row.select(F.inline(items)).filter(F.col("low").isNotNull())


def feature_levels(frame: DataFrame, categorical: list[str]) -> DataFrame:
    """Distinct (feature, level) pairs, combined map-side before the shuffle."""
    items = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in categorical]
    )
    return frame.select(F.inline(items)).filter(F.col("level").isNotNull()).distinct()


def level_cardinality(frame: DataFrame, categorical: list[str]) -> DataFrame:
    return feature_levels(frame, categorical).groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"))


# --------------------------------------------------------------------- cells
_NUMBER, _LEVEL = "__x_", "__l_"


def _bin(pop: Population, name: str, bins: int) -> str:
    low, high = pop.bounds[name]
    return "0" if low is None else bin_text(f"{_NUMBER}{name}", float(low), float(high), bins)


def _readable(df: DataFrame, pop: Population, keep: list[str]) -> DataFrame:
    """``keep`` plus readable numbers and comparable levels, computed once for all resolutions."""
    _require(df, pop.numeric + pop.categorical)
    types = dict(df.dtypes)
    numbers = [f"{number_text(types, c)} AS {_NUMBER}{c}" for c in pop.numeric]
    return df.selectExpr(*keep, *numbers, *[f"{membership_text(c)} AS {_LEVEL}{c}" for c in pop.categorical])


def _require(df: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"records lack declared columns: {absent}")


def cells(df: DataFrame, pop: Population, resolutions: list[int], keep: list[str]) -> DataFrame:
    """``keep`` columns plus one (bin, cell...) row per resolution."""
    per_resolution = ", ".join(
        f"named_struct('bin', {b}, " + ", ".join(f"'cell_{c}', {_bin(pop, c, b)}" for c in pop.numeric) + ")"
        for b in resolutions
    )
    levels = [f"{_LEVEL}{c} AS cell_{c}" for c in pop.categorical]
    readable = _readable(df, pop, keep)
    return readable.selectExpr(*keep, *levels, f"inline(array({per_resolution}))").select(*keep, "bin", *pop.cell_columns)


def population_cells(pop: Population, resolutions: list[int]) -> DataFrame:
    """Distinct (bin, cell...) of the population."""
    return cells(pop.frame, pop, resolutions, []).distinct()


def _cell_at(pop: Population, bins: int) -> str:
    """SQL text of a record's cell at one resolution, as a struct led by the resolution."""
    fields = [f"'bin', {bins}"] + [f"'{c}', {_bin(pop, c, bins)}" for c in pop.numeric]
    fields += [f"'{c}', {_LEVEL}{c}" for c in pop.categorical]
    return f"named_struct({', '.join(fields)})"


def with_novelty(df: DataFrame, pop: Population, resolutions: list[int], keep: list[str]) -> DataFrame:
    """``keep`` plus one boolean ``novel_b<bins>`` per resolution, by broadcast probes.

    Only for a population whose cells pass the size check; see ``novel_rows``
    for the form without a size limit.
    """
    structs = [_cell_at(pop, b) for b in resolutions]
    out = _readable(df, pop, keep).selectExpr(*keep, *[f"{s} AS __cell_{b}" for b, s in zip(resolutions, structs)])
    # The distinct cells of every resolution together, built and broadcast once:
    # all probes below share the same exchange.
    known = _readable(pop.frame, pop, []).selectExpr(f"explode(array({', '.join(structs)})) AS cell").distinct()
    for b in resolutions:
        side = known.selectExpr(f"cell AS __known_{b}")
        out = out.join(F.broadcast(side), F.col(f"__cell_{b}") == F.col(f"__known_{b}"), "left")
    return out.selectExpr(*keep, *[f"__known_{b} IS NULL AS novel_b{b}" for b in resolutions])


def flagged_novelty(df: DataFrame, pop: Population, bins: int, keep: list[str], broadcast: bool | None = None) -> DataFrame:
    """``keep`` plus ``novel_b<bins>`` of one resolution, for a population of any size.

    Probes by broadcast behind the size check; else identical rows (``keep``
    and cell) are counted first, met with the known cells in a shuffle, and
    listed again.
    """
    if pop.cells_fit_broadcast([bins]) if broadcast is None else broadcast:
        return with_novelty(df, pop, [bins], keep)
    same = ["bin", *pop.cell_columns]
    distinct = cells(df, pop, [bins], keep).groupBy(*keep, *same).agg(F.count(F.lit(1)).alias("__n"))
    known = population_cells(pop, [bins]).withColumn("__known", F.lit(True))
    met = distinct.join(known, same, "left").withColumn(f"novel_b{bins}", F.col("__known").isNull())
    return met.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*keep, f"novel_b{bins}")


# --------------------------------------------------------------------- rates
def novelty_by_file(
    records: DataFrame,
    pop: Population,
    keys: list[str],
    resolutions: list[int] = m.BIN_RESOLUTIONS,
    broadcast: bool | None = None,
) -> DataFrame:
    """keys, bin, n_rows, n_novel, novelty_rate."""
    if broadcast is None:
        broadcast = pop.cells_fit_broadcast(resolutions)
    if broadcast:
        flagged = with_novelty(records, pop, resolutions, keys)
        counted = flagged.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count_if(F.col(f"novel_b{b}")).alias(f"n_{b}") for b in resolutions],
        )
        per_bin = F.array(
            *[F.struct(F.lit(b).alias("bin"), F.col(f"n_{b}").alias("n_novel")) for b in resolutions]
        )
        rates = counted.select(*keys, "n_rows", F.inline(per_bin))
    else:
        same = ["bin", *pop.cell_columns]
        # identical cells of a file become one row before anything is shuffled
        distinct = cells(records, pop, resolutions, keys).groupBy(*keys, *same).agg(
            F.count(F.lit(1)).alias("__n")
        )
        known = population_cells(pop, resolutions).withColumn("__known", F.lit(True))
        rates = (
            distinct.join(known, same, "left")
            .groupBy(*keys, "bin")
            .agg(
                F.sum("__n").alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("__known").isNull(), F.col("__n"))), F.lit(0)).alias("n_novel"),
            )
        )
    return rates.withColumn("novelty_rate", F.col("n_novel") / F.col("n_rows"))


def novel_rows(
    records: DataFrame,
    pop: Population,
    keep: list[str],
    resolutions: list[int] = m.BIN_RESOLUTIONS,
    broadcast: bool | None = None,
) -> DataFrame:
    """``keep`` columns and ``metric`` (HR_b<bins>), one row per novel record and resolution."""
    if broadcast is None:
        broadcast = pop.cells_fit_broadcast(resolutions)
    if broadcast:
        flagged = with_novelty(records, pop, resolutions, keep)
        hits = F.array_compact(
            F.array(*[F.when(F.col(f"novel_b{b}"), F.lit(f"HR_b{b}")) for b in resolutions])
        )
        return flagged.select(*keep, F.explode(hits).alias("metric"))
    same = ["bin", *pop.cell_columns]
    _, novel = sketch.split(cells(records, pop, resolutions, keep), population_cells(pop, resolutions), same, pop.rows * len(resolutions))
    return novel.select(*keep, F.concat(F.lit("HR_b"), F.col("bin").cast("string")).alias("metric"))


def adjustment_factor(pop: Population, bins: int, stabiliser: float = m.STABILISER) -> float:
    """Opportunity adjustment of one resolution.

    The number of possible cells is ``bins ** numerics * product of levels``;
    only its logarithm is used, so it is never formed.
    """
    if any(n == 0 for n in pop.cardinality.values()):
        ratio = 1.0
    else:
        log_cells = len(pop.numeric) * math.log(bins) + sum(math.log(n) for n in pop.cardinality.values())
        ratio = math.log(pop.rows) / log_cells if log_cells > 0 else 1.0
    weight = 0.0 if ratio > 1 else stabiliser
    return (1.0 - weight) + weight * ratio


def adjust_novelty(rates: DataFrame, pop: Population, resolutions: list[int] = m.BIN_RESOLUTIONS) -> DataFrame:
    """Add ``novelty_adjusted`` to a table with ``bin`` and ``novelty_rate``."""
    factor = F.try_element_at(
        F.create_map(*[F.lit(x) for b in resolutions for x in (b, adjustment_factor(pop, b))]), F.col("bin")
    )
    return rates.withColumn("novelty_adjusted", F.col("novelty_rate") * factor)


# -------------------------------------------------------------------- copies
def _copy_columns(df: DataFrame, numeric: list[str], categorical: list[str], tag: str) -> list[str]:
    types = dict(df.dtypes)
    out = [f"{copy_number_text(number_text(types, c))} AS {tag}_{c}" for c in numeric]
    return out + [f"{copy_label_text(c)} AS {tag}_{c}" for c in categorical]


def copied_rows(
    records: DataFrame,
    training: DataFrame,
    chain: list[str],
    numeric: list[str],
    categorical: list[str],
) -> DataFrame:
    """Records whose rounded values equal a training record of their chain.

    The key is the chain and every feature (null equals null, but a missing
    chain has no training rows).  Records meet a sketch of the training rows;
    only distinct keys of those that may be copies are met with the rows
    themselves, so a chain or one repeated row that holds a third of the
    records crosses no shuffle.
    """
    _require(records, numeric + categorical)
    _require(training, numeric + categorical)
    feats = [f"__c_{c}" for c in numeric + categorical]
    own = [f"__k_{k}" for k in chain]
    named = [f"`{k}` AS __k_{k}" for k in chain]
    left = records.selectExpr("*", *named, *_copy_columns(records, numeric, categorical, "__c"))
    known = training.selectExpr(*named, *_copy_columns(training, numeric, categorical, "__c")).dropna(subset=own)
    copies, _ = sketch.split(left, known, [*own, *feats], training.count())
    return copies.select(*records.columns)


def copy_counts(
    records: DataFrame,
    training: DataFrame,
    chain: list[str],
    keys: list[str],
    numeric: list[str],
    categorical: list[str],
) -> DataFrame:
    """keys, n_rows, n_copies, copy_rate; the rate is null for chains without training data.

    Identical rows of a file are counted map-side before the join, so a
    collapsed file crosses the shuffle as few rows.
    """
    feats = [f"__c_{c}" for c in numeric + categorical]
    grouped = (
        records.selectExpr(*keys, *_copy_columns(records, numeric, categorical, "__c"))
        .groupBy(*keys, *feats)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    known = (
        training.selectExpr(*[f"{k} AS __k_{k}" for k in chain], *_copy_columns(training, numeric, categorical, "__t"))
        .distinct()
        .withColumn("__copy", F.lit(True))
    )
    same = [F.col(f"__c_{c}").eqNullSafe(F.col(f"__t_{c}")) for c in numeric + categorical]
    same += [F.col(k) == F.col(f"__k_{k}") for k in chain]
    counted = (
        grouped.join(known, same, "left")
        .groupBy(*keys)
        .agg(
            F.sum("__n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("__copy"), F.col("__n"))), F.lit(0)).alias("n_copies"),
        )
    )
    trained = training.select(*chain).distinct().withColumn("__trained", F.lit(True))
    return counted.join(trained, chain, "left").select(
        *keys, "n_rows", "n_copies",
        F.when(F.col("__trained"), F.col("n_copies") / F.col("n_rows")).alias("copy_rate"),
    )
