"""Survival statistics of failure events.

Times are generations, so each chain is at risk at no more than
``last_generation + 1`` points; exploding those points and counting gives risk
sets by plain map-side aggregation, without interval joins or sorting chains.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tabaudit import model as m
from tabaudit.functions.tails import chi2_p, normal_two_sided_p
from tabaudit.operators.ranking import holm
from tabaudit.operators.subsets import FULL, cells_by_subset, group_members, subset_list
from tabaudit.sources.sinks import reliable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUBSET = ["group", "subset"]


# ------------------------------------------------------------- Kaplan-Meier
def survival_table(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and observed time: n_at_risk, deaths, censored, survival, ci_low, ci_high."""
    counts = events.groupBy(*keys, "time").agg(
        F.count_if(F.col("event") == 1).alias("deaths"), F.count_if(F.col("event") == 0).alias("censored")
    )
    ahead = Window.partitionBy(*keys).orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    so_far = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    at_risk = counts.withColumn("n_at_risk", F.sum(F.col("deaths") + F.col("censored")).over(ahead))
    n, d = F.col("n_at_risk").cast("double"), F.col("deaths").cast("double")
    increment = F.when((d > 0) & (n > d), d / F.nullif(n * (n - d), F.lit(0.0))).otherwise(F.lit(0.0))
    curve = at_risk.withColumns(
        {"survival": F.product(F.lit(1.0) - d / n).over(so_far), "__green": F.sum(increment).over(so_far)}
    )
    half = F.lit(1.96) * F.col("survival") * F.sqrt("__green")
    return curve.select(
        *keys, "time", "n_at_risk", "deaths", "censored", "survival",
        F.greatest(F.lit(0.0), F.col("survival") - half).alias("ci_low"),
        F.least(F.lit(1.0), F.col("survival") + half).alias("ci_high"),
    )


def step_curve(table: DataFrame, keys: list[str], max_time: int = m.LAST_GENERATION) -> DataFrame:
    """Step function per key: starts at (0, 1, 1, 1), runs flat to ``max_time``.

    The steps of one key are collected into an array, whose length is bounded
    by the number of generations.
    """
    point = F.struct(
        F.col("time").cast("double").alias("time"), F.col("survival").alias("survival"),
        F.col("ci_low").alias("ci_low"), F.col("ci_high").alias("ci_high"),
    )
    start = F.struct(*[F.lit(v).alias(n) for n, v in (("time", 0.0), ("survival", 1.0), ("ci_low", 1.0), ("ci_high", 1.0))])
    steps = F.concat(F.array(start), F.array_sort(F.collect_list(F.when(F.col("deaths") > 0, point))))
    last = F.element_at("__s", -1)
    flat = F.struct(
        F.lit(float(max_time)).alias("time"), last["survival"].alias("survival"),
        last["ci_low"].alias("ci_low"), last["ci_high"].alias("ci_high"),
    )
    extended = F.when(last["time"] < max_time, F.array_append("__s", flat)).otherwise(F.col("__s"))
    return (
        table.groupBy(*keys).agg(steps.alias("__s"))
        .select(*keys, F.posexplode(extended).alias("step", "__p"))
        .select(*keys, "step", "__p.*")
    )


def censor_points(table: DataFrame, keys: list[str]) -> DataFrame:
    """Survival level at which censored chains leave the risk set."""
    return table.filter(F.col("censored") > 0).select(*keys, "time", "survival", "censored")


# ----------------------------------------------------------------- log-rank
def _at_risk(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chain and time at risk, with the death marked."""
    return members.select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("time"))).alias("t"), "time", "event"
    ).withColumn("__d", ((F.col("t") == F.col("time")) & (F.col("event") == 1)).cast("bigint"))


def risk_counts(events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """group, dseed, mseed, generator position, t, n at risk, d deaths."""
    keys = ["group", "group_size", "dseed", "mseed", "generator", "position"]
    rows = _at_risk(group_members(events, groups), keys)
    return rows.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("__d").alias("d"))


def _by_position(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """n_0.., d_0.. columns: one per generator position of the group."""
    columns = []
    for p in range(width):
        at = F.col("position") == p
        columns += [
            F.coalesce(F.sum(F.when(at, F.col("n"))), F.lit(0)).cast("double").alias(f"n_{p}"),
            F.coalesce(F.sum(F.when(at, F.col("d"))), F.lit(0)).cast("double").alias(f"d_{p}"),
        ]
    return cells.groupBy(*keys).agg(*columns)


def _sum(names: list[str]) -> Column:
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return total


@F.pandas_udf(DoubleType())
def _quadratic_form(score: pd.Series, covariance: pd.Series) -> pd.Series:
    def one(u, v):
        u = np.asarray(u, dtype=float)
        v = np.asarray(v, dtype=float).reshape(len(u), len(u))
        keep = np.arange(len(u) - 1)
        return float(u[keep] @ np.linalg.pinv(v[np.ix_(keep, keep)]) @ u[keep])

    return pd.Series([one(u, v) for u, v in zip(score, covariance)], dtype="float64")


def logrank_sums(raw: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """Per (group, subset): generators present, O-E per position and its covariance matrix.

    ``raw`` are the ``risk_counts``.  Columns z_<p> and v_<p>_<q>; both are sums over times, so one aggregation
    of at most ``generations`` rows per subset.
    """
    width = max(len(g) for g in groups.values())
    cells = cells_by_subset(
        raw, raw.select("group", "dseed", "mseed").distinct(), ["group"], ["generator", "position", "t"], ["n", "d"]
    )
    grid = _by_position(cells, [*_SUBSET, "t"], width)
    ps = range(width)
    n, d = _sum([f"n_{p}" for p in ps]), _sum([f"d_{p}" for p in ps])
    shared = "CASE WHEN N > 1 THEN D * (N - D) / (N - 1) ELSE 0D END"
    grid = grid.withColumns({"N": n, "D": d}).selectExpr("*", f"{shared} AS k")
    sums = [F.expr(f"max(n_{p} > 0) AS present_{p}") for p in ps]
    for p in ps:
        sums.append(F.expr(f"sum(d_{p} - D * n_{p} / N) AS z_{p}"))
        sums += [F.expr(f"sum(k * n_{p} / N * ({float(p == q)}D - n_{q} / N)) AS v_{p}_{q}") for q in ps]
    return grid.groupBy(*_SUBSET).agg(*sums)


def logrank(events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS, p_values: bool = True) -> DataFrame:
    """Omnibus log-rank test per group and subset; null statistic below two generators."""
    width = max(len(g) for g in groups.values())
    ps = range(width)
    raw = reliable(risk_counts(events, groups))
    sums = logrank_sums(raw, groups)
    present = sum((F.col(f"present_{p}").cast("int") for p in ps), F.lit(0))
    # positions without chains contribute a zero row, which the pseudo-inverse ignores
    score = F.array(*[F.col(f"z_{p}") for p in ps])
    covariance = F.array(*[F.col(f"v_{p}_{q}") for p in ps for q in ps])
    filled = _move_absent_first(sums, width).withColumns({"__u": score, "__v": covariance})
    tested = filled.select(
        *_SUBSET, present.alias("__k"),
        F.when(present >= 2, _quadratic_form(F.col("__u"), F.col("__v"))).alias("statistic"),
    )
    everything = subset_list(raw.select("group", "dseed", "mseed").distinct(), ["group"]).select(*_SUBSET)
    out = everything.join(tested, _SUBSET, "left").select(
        *_SUBSET, F.lit("Omnibus log-rank").alias("test"), "statistic",
        F.when(F.col("__k") >= 2, F.col("__k") - 1).cast("bigint").alias("df"),
    )
    return out.withColumn("p", chi2_p(F.col("statistic"), F.col("df"))) if p_values else out


def _move_absent_first(sums: DataFrame, width: int) -> DataFrame:
    """The last position is the one left out of the quadratic form.

    Its row is the negative sum of the others, so leaving it out is only right
    when it is present; absent positions have zero rows wherever they stand.
    A group whose last position is absent swaps it with its last present one.
    """
    out = sums
    last = width - 1
    for p in range(last):
        alone = "".join(f" AND NOT present_{q}" for q in range(p + 1, last))
        take = f"NOT present_{last} AND present_{p}{alone}"
        swapped = {f"z_{p}": f"z_{last}"} | {f"v_{p}_{q}": f"v_{last}_{q}" for q in range(width)}
        swapped |= {f"v_{q}_{p}": f"v_{q}_{last}" for q in range(width) if q != p}
        out = out.selectExpr(
            *[f"CASE WHEN {take} THEN {swapped[c]} ELSE {c} END AS {c}" if c in swapped else c for c in sums.columns]
        )
    return out


def logrank_pairwise(
    events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS, p_values: bool = True
) -> DataFrame:
    """Log-rank test of every two generators of a group, Holm-adjusted per subset."""
    width = max(len(g) for g in groups.values())
    raw = reliable(risk_counts(events, groups))
    cells = cells_by_subset(
        raw, raw.select("group", "dseed", "mseed").distinct(), ["group"], ["generator", "position", "t"], ["n", "d"]
    )
    grid = _by_position(cells, [*_SUBSET, "t"], width)
    pairs = []
    for a in range(width):
        for b in range(a + 1, width):
            pairs.append(
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n_{a}").alias("na"), F.col(f"d_{a}").alias("da"),
                    F.col(f"n_{b}").alias("nb"), F.col(f"d_{b}").alias("db"),
                )
            )
    rows = grid.select(*_SUBSET, F.inline(F.array(*pairs)))
    n, d = F.col("na") + F.col("nb"), F.col("da") + F.col("db")
    share = F.col("na") / F.nullif(n, F.lit(0.0))
    variance = F.when(n > 1, d * (n - d) / F.nullif(n - 1.0, F.lit(0.0)) * share * (1.0 - share)).otherwise(F.lit(0.0))
    sums = rows.groupBy(*_SUBSET, "a", "b").agg(
        F.sum(F.when(n > 0, F.col("da") - d * share)).alias("z"), F.sum(F.when(n > 0, variance)).alias("v"),
        F.max("na").alias("__na"), F.max("nb").alias("__nb"),
    )
    names = F.create_map(
        *[x for g, members in groups.items() for x in (F.lit(g), F.array(*[F.lit(k) for k in members]))]
    )
    own = F.try_element_at(names, F.col("group"))
    named = sums.filter((F.col("__na") > 0) & (F.col("__nb") > 0)).select(
        *_SUBSET, F.lit("Pairwise log-rank").alias("test"),
        F.concat(F.element_at(own, F.col("a") + 1), F.lit(" vs "), F.element_at(own, F.col("b") + 1)).alias("comparison"),
        F.coalesce(F.try_divide(F.col("z") * F.col("z"), F.col("v")), F.lit(0.0)).alias("statistic"),
        F.lit(1).cast("bigint").alias("df"),
    )
    if not p_values:
        return named
    return holm(named.withColumn("p", chi2_p(F.col("statistic"), F.col("df"))), _SUBSET)


# --------------------------------------------- Cox, one time-varying covariate
def interval_risk_sets(intervals: DataFrame, strata: list[str]) -> DataFrame:
    """strata, t, n0, n1 at risk and d0, d1 deaths by covariate, event times only."""
    whole = intervals.select(
        *strata, F.explode(F.sequence(F.col("start").cast("int") + 1, F.col("stop").cast("int"))).alias("t"),
        "stop", "event", "active",
    )
    died = (F.col("t") == F.col("stop")) & (F.col("event") == 1)
    on = F.col("active") == 1
    return whole.groupBy(*strata, "t").agg(
        F.count_if(~on).alias("n0"), F.count_if(on).alias("n1"),
        F.count_if(died & ~on).alias("d0"), F.count_if(died & on).alias("d1"),
    ).filter(F.col("d0") + F.col("d1") > 0)


#: Coefficients beyond which a likelihood counts as having no finite maximum.
_EDGE = 20


def cox_time_varying(joined: DataFrame, intervals: DataFrame, strata: list[str] = ["dseed", "generator"], cells: int = 32) -> DataFrame:
    """Hazard ratio of the active state, stratified, ties by Efron's method.

    The likelihood is concave, so its maximum lies where the score changes its
    sign.  One aggregation gives score, information and likelihood for a whole
    grid of coefficients; three finer grids and a Newton step close in on the
    root, five small jobs however the search goes.  A likelihood without a finite
    maximum has no coefficient; where all at risk share one state it is flat, and its
    maximum is the null value.  ``joined`` (one row per chain) supplies the chain
    counts of the report.
    """
    sets = interval_risk_sets(intervals, strata).groupBy("n0", "n1", "d0", "d1").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    # one row per tied death: what remains at risk after removing its share of the tied deaths
    deaths = F.col("d0") + F.col("d1")
    removed = F.col("l") / deaths
    terms = reliable(
        sets.withColumn("l", F.explode(F.sequence(F.lit(0), (deaths - 1).cast("int")))).select(
            "weight",
            (F.col("n0") - removed * F.col("d0")).alias("a"),
            (F.col("n1") - removed * F.col("d1")).alias("b"),
            F.when(F.col("l") == 0, F.col("d1")).otherwise(F.lit(0)).cast("double").alias("observed"),
        )
    )

    def at(betas: list[float]) -> list[tuple[float, float, float, float]]:
        """(coefficient, score, information, log-likelihood) of each, in order."""
        risk = F.col("b") * F.exp("beta")
        p = risk / (F.col("a") + risk)
        rows = terms.withColumn("beta", F.explode(F.array(*[F.lit(float(x)) for x in betas]))).groupBy("beta").agg(
            F.sum(F.col("weight") * (F.col("observed") - p)).alias("score"),
            F.sum(F.col("weight") * p * (1.0 - p)).alias("info"),
            F.sum(F.col("weight") * (F.col("observed") * F.col("beta") - F.log(F.col("a") + risk))).alias("loglik"),
        )
        return sorted(tuple(r) for r in rows.collect())

    grid = at([float(x) for x in range(-_EDGE, _EDGE + 1)])
    null = next((r for r in grid if r[0] == 0.0), None)
    usable = null is not None and null[2] > 0
    # without information every coefficient gives the same likelihood
    beta, se, loglik, converged = None, None, None if null is None else null[3], False
    if usable:
        if grid[0][1] < 0 or grid[-1][1] > 0:  # still rising at the edge: no finite maximum
            loglik = (grid[0] if grid[0][1] < 0 else grid[-1])[3]
        else:
            for _ in range(3):
                k = max(i for i, r in enumerate(grid) if r[1] >= 0)
                if k == len(grid) - 1:
                    break
                low, high = grid[k][0], grid[k + 1][0]
                grid = at([low + (high - low) * i / cells for i in range(cells + 1)])
            nearest = min(grid, key=lambda r: abs(r[1]))
            best = at([nearest[0] + nearest[1] / nearest[2]])[0]
            converged = abs(best[1] / best[2]) < 1e-6
            beta, loglik = best[0] + best[1] / best[2], best[3]
            se = 1.0 / math.sqrt(best[2])
    facts = joined.agg(
        F.count(F.lit(1)).alias("n_chains"), F.count_if(F.col("failure_time") > 0).alias("n_chains_in_model"),
        F.count_if((F.col("failure_time") > 0) & (F.col("failure_event") == 1)).alias("n_events"),
    )
    coef, err = F.lit(beta).cast("double"), F.lit(se).cast("double")
    z = F.try_divide(coef, err)
    return facts.select(
        F.lit("onset_active").alias("covariate"), coef.alias("coef"), F.exp(coef).alias("hazard_ratio"), err.alias("se"),
        F.exp(coef - F.lit(1.959963984540054) * err).alias("ci_low"),
        F.exp(coef + F.lit(1.959963984540054) * err).alias("ci_high"),
        z.alias("z"), normal_two_sided_p(z).alias("p"), "n_chains", "n_chains_in_model", "n_events",
        F.lit(null[3] if null else None).cast("double").alias("log_likelihood_null"),
        F.lit(loglik).cast("double").alias("log_likelihood"), F.lit(converged).alias("converged"),
    )


# --------------------------------------- Cox by generator, stratified by pair
def _efron(tuples: np.ndarray, counts: np.ndarray, live: list[int], beta: np.ndarray):
    """Log-likelihood, score and information of one model from risk-set tuples."""
    k = len(live)
    risk_weight = np.exp(np.concatenate([[0.0], beta]))
    n, d = tuples[:, :, 0][:, live], tuples[:, :, 1][:, live]
    total = d.sum(axis=1)
    loglik, score, info = 0.0, np.zeros(k - 1), np.zeros((k - 1, k - 1))
    for row in range(len(tuples)):
        if total[row] == 0:
            continue
        w = counts[row]
        loglik += w * (d[row, 1:] @ beta)
        score += w * d[row, 1:]
        for tied in range(int(total[row])):
            left = (n[row] - tied / total[row] * d[row]) * risk_weight
            p = left / left.sum()
            loglik -= w * math.log(left.sum())
            score -= w * p[1:]
            info += w * (np.diag(p[1:]) - np.outer(p[1:], p[1:]))
    return loglik, score, info


def _fit_pair_model(tuples: np.ndarray, counts: np.ndarray, live: list[int]):
    """(statistic, df, converged) of the likelihood-ratio test against equal hazards."""
    beta = np.zeros(len(live) - 1)
    null, score, info = _efron(tuples, counts, live, beta)
    best, converged = null, False
    for _ in range(100):
        step = np.linalg.pinv(info) @ score
        step = np.clip(step, -2.0, 2.0)
        if np.max(np.abs(step)) < 1e-8:
            converged = True
            break
        trial = _efron(tuples, counts, live, beta + step)
        while trial[0] < best - 1e-12 and np.max(np.abs(step)) > 1e-8:
            step = step / 2.0
            trial = _efron(tuples, counts, live, beta + step)
        beta, (best, score, info) = beta + step, trial
        if np.max(np.abs(beta)) > 30:
            break
    return 2.0 * (best - null), len(live) - 1, converged


def cox_stratified(events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """Likelihood-ratio test of generator, stratified by seed pair, per group and subset.

    A second model leaves out generators that fail in every chain of the
    subset.  Inside a seed pair each generator has one chain, so a risk set is
    one of at most 3^(group size) tuples: the models are fitted on counts of
    those tuples, whatever the number of chains.
    """
    width = max(len(g) for g in groups.values())
    raw = reliable(risk_counts(events, groups))
    universe = raw.select("group", "dseed", "mseed").distinct()
    vector = [f"{x}_{p}" for p in range(width) for x in ("n", "d")]
    sets = _by_position(raw, ["group", "dseed", "mseed", "t"], width)
    sets = sets.filter(_sum([f"d_{p}" for p in range(width)]) > 0).withColumn("sets", F.lit(1).cast("bigint"))
    cells = cells_by_subset(sets, universe, ["group"], vector, ["sets"])
    # every chain is at risk at time 0 exactly once
    chains = raw.groupBy("group", "dseed", "mseed", "position").agg(
        F.max("n").alias("chains"), F.sum("d").alias("failures")
    )
    per_generator = cells_by_subset(chains, universe, ["group"], ["position"], ["chains", "failures"])
    status = per_generator.groupBy(*_SUBSET).agg(
        F.collect_list(F.struct("position", (F.col("failures") == F.col("chains")).alias("always"))).alias("status")
    )
    joined = cells.join(status, _SUBSET)
    names = {g: list(v) for g, v in groups.items()}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        group, subset = frame["group"].iloc[0], frame["subset"].iloc[0]
        # rows of a model in a fixed order, so sums do not depend on the shuffle
        frame = frame.sort_values(vector)
        values = frame[vector].to_numpy(dtype=float).reshape(len(frame), width, 2)
        counts = frame["sets"].to_numpy(dtype=float)
        state = {int(s["position"]): bool(s["always"]) for s in frame["status"].iloc[0]}
        models = [("all generators", sorted(state))]
        always = [p for p in sorted(state) if state[p]]
        rest = [p for p in sorted(state) if not state[p]]
        if always and len(rest) >= 2:
            models.append(("excluding " + ", ".join(names[group][p] for p in always), rest))
        rows = []
        for note, live in models:
            used = " vs ".join(names[group][p] for p in live)
            if len(live) < 2:
                rows.append((group, subset, f"Stratified Cox LRT ({note})", used, None, None, None))
                continue
            stat, df, ok = _fit_pair_model(values, counts, live)
            rows.append((group, subset, f"Stratified Cox LRT ({note})", used, stat, df, ok))
        return pd.DataFrame(rows, columns=["group", "subset", "test", "comparison", "statistic", "df", "converged"])

    fitted = joined.groupBy(*_SUBSET).applyInPandas(
        fit, "group string, subset string, test string, comparison string, statistic double, df long, converged boolean"
    )
    return fitted.withColumn("p", chi2_p(F.col("statistic"), F.col("df")))


def survival_comparison(events: DataFrame, groups: dict[str, list[str]] = m.GENERATOR_GROUPS) -> DataFrame:
    """All survival tests over groups and leave-one-seed-out subsets, in one table."""
    columns = ["group", "subset", "test", "comparison", "statistic", "df", "p", "p_holm"]
    listed = F.create_map(*[F.lit(x) for g, v in groups.items() for x in (g, " vs ".join(v))])
    events = reliable(events)
    omnibus = logrank(events, groups).withColumns(
        {"comparison": F.try_element_at(listed, F.col("group")), "p_holm": F.lit(None).cast("double")}
    )
    cox = cox_stratified(events, groups).withColumn("p_holm", F.lit(None).cast("double"))
    return (
        omnibus.select(*columns)
        .unionByName(logrank_pairwise(events, groups).select(*columns))
        .unionByName(cox.select(*columns))
    )
