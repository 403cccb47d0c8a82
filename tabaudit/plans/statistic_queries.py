"""Queries on onsets, failure events and the statistical tests over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.operators import events, onset, paired, ranking, subsets, survival
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, chi2_tail_sql, long_of, r6, s6

registry = Registry()
query = registry.query
CHAIN_SQL = "generator, dseed, mseed"

# ------------------------------------------------------------------- onsets
_METRIC_LIST = ", ".join(f"('{n}', {t}, '{d}')" for n, (t, d) in v.ONSETS.items())
REGISTRY_SQL = f"""{v.TIDY_SQL},
rules_of(metric, threshold, direction) AS (VALUES {_METRIC_LIST}),
registry AS (SELECT DISTINCT {CHAIN_SQL}, metric FROM trajectory, rules_of),
steps AS (SELECT *, value - lag(value) OVER (PARTITION BY metric, {CHAIN_SQL} ORDER BY generation) AS step FROM tidy WHERE value IS NOT NULL)"""
INCLINE_SQL = f"""{REGISTRY_SQL},
hits AS (SELECT metric, {CHAIN_SQL}, min(generation) AS onset_generation, arg_min(step, generation) AS step_size
         FROM steps JOIN rules_of USING (metric)
         WHERE (direction = 'increase' AND step >= threshold) OR (direction = 'decrease' AND step <= -threshold) GROUP BY ALL),
seen AS (SELECT metric, {CHAIN_SQL}, count(*) AS n FROM steps GROUP BY ALL),
onsets AS (SELECT metric, {CHAIN_SQL}, onset_generation, step_size, onset_generation IS NOT NULL AS crossed, coalesce(n, 0) AS n_observed_generations
           FROM registry LEFT JOIN hits USING (metric, {CHAIN_SQL}) LEFT JOIN seen USING (metric, {CHAIN_SQL}))"""


def _tidy(spark: SparkSession, folder: str) -> DataFrame:
    return v.tidy_trajectory(spark, folder)


def _onsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tidy(spark, folder)
    return onset.incline_onset(rows, onset.chain_registry(rows), v.ONSETS)


@query(f"WITH {INCLINE_SQL} SELECT metric, {CHAIN_SQL}, CAST(onset_generation AS BIGINT) AS onset_generation, {s6('step_size')}, crossed, n_observed_generations FROM onsets")
def onset_incline(spark: SparkSession, folder: str) -> DataFrame:
    return _onsets(spark, folder).select(
        "metric", *v.CHAIN, long_of("onset_generation"), r6("step_size"), "crossed", "n_observed_generations"
    )


@query(f"""WITH {REGISTRY_SQL},
run AS (SELECT *, first_value(value) OVER w AS base, max(value) OVER w AS top FROM tidy WINDOW w AS (PARTITION BY metric, {CHAIN_SQL} ORDER BY generation)),
done AS (SELECT metric, {CHAIN_SQL}, arg_min(base, generation) AS baseline, max(value) AS peak, min(generation) FILTER (top - base >= threshold) AS onset_generation, min(generation) AS g0
         FROM run JOIN rules_of USING (metric) GROUP BY ALL)
SELECT metric, {CHAIN_SQL}, {s6('baseline')}, {s6('peak')}, {s6('peak - baseline', 'max_rise')}, CAST(onset_generation AS BIGINT) AS onset_generation,
       onset_generation IS NOT NULL AS crossed, g0 = 0 AS baseline_is_gen0
FROM registry LEFT JOIN done USING (metric, {CHAIN_SQL})""")
def onset_baseline_rise(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tidy(spark, folder)
    out = onset.baseline_rise_onset(rows, onset.chain_registry(rows), {k: t for k, (t, _) in v.ONSETS.items()})
    return out.select("metric", *v.CHAIN, r6("baseline"), r6("peak"), r6("max_rise"), long_of("onset_generation"), "crossed", "baseline_is_gen0")


@query(f"""WITH {REGISTRY_SQL},
best AS (SELECT metric, {CHAIN_SQL}, generation, step, row_number() OVER (PARTITION BY metric, {CHAIN_SQL} ORDER BY abs(step) DESC, generation) AS rn FROM steps WHERE step IS NOT NULL),
seen AS (SELECT metric, {CHAIN_SQL}, count(*) AS n FROM steps GROUP BY ALL)
SELECT metric, {CHAIN_SQL}, CAST(generation AS BIGINT) AS spike_generation, {s6('step', 'spike_size')}, coalesce(n, 0) AS n_observed_generations
FROM registry LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (metric, {CHAIN_SQL}) LEFT JOIN seen USING (metric, {CHAIN_SQL})""")
def onset_largest_step(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tidy(spark, folder)
    out = onset.largest_step(rows, onset.chain_registry(rows), list(v.ONSETS))
    return out.select("metric", *v.CHAIN, long_of("spike_generation"), r6("spike_size"), "n_observed_generations")


@query(f"WITH {INCLINE_SQL} SELECT metric, generator, count_if(crossed) AS n_crossed, count(*) AS n_total FROM onsets GROUP BY ALL")
def crossing_counts(spark: SparkSession, folder: str) -> DataFrame:
    return onset.crossing_counts(_onsets(spark, folder), ["metric", "generator"])


_WIDE = ", ".join(
    f"CAST(max(onset_generation) FILTER (metric = '{n}') AS BIGINT) AS {n}_spike_generation, "
    f"floor(max(step_size) FILTER (metric = '{n}') * 1e6 + 0.500003) / 1e6 AS {n}_spike_size" for n in v.ONSETS
)


@query(f"WITH {INCLINE_SQL} SELECT {CHAIN_SQL}, {_WIDE} FROM onsets GROUP BY ALL")
def onset_combined(spark: SparkSession, folder: str) -> DataFrame:
    wide = onset.onset_wide(_onsets(spark, folder), list(v.ONSETS))
    columns = [x for n in v.ONSETS for x in (long_of(f"{n}_spike_generation"), r6(f"{n}_spike_size"))]
    return wide.select(*v.CHAIN, *columns)


# ------------------------------------------------------------------- events
EVENTS_SQL = f"""{INCLINE_SQL},
minority AS (SELECT {CHAIN_SQL}, generation, least(positive_share, 1 - positive_share) AS value FROM trajectory),
paired_points AS (SELECT *, lead(auroc_like) OVER (PARTITION BY {CHAIN_SQL} ORDER BY generation) AS nxt,
                         lead(generation) OVER (PARTITION BY {CHAIN_SQL} ORDER BY generation) AS nxt_g FROM trajectory),
lost AS (SELECT {CHAIN_SQL}, min(generation) AS g FROM paired_points WHERE auroc_like <= 0.3 AND nxt <= 0.3 AND nxt_g IS NOT NULL GROUP BY ALL),
emptied AS (SELECT {CHAIN_SQL}, min(generation) AS g FROM minority WHERE value = 0 GROUP BY ALL),
points AS (SELECT {CHAIN_SQL}, count(*) AS n FROM trajectory GROUP BY ALL),
events_of AS (SELECT {CHAIN_SQL}, CAST(coalesce(least(l.g, e.g), 19) AS BIGINT) AS time, CAST(coalesce(l.g, e.g) IS NOT NULL AS BIGINT) AS event,
    concat_ws('+', CASE WHEN l.g = least(l.g, e.g) THEN 'signal_loss' END, CASE WHEN e.g = least(l.g, e.g) THEN 'class_collapse' END) AS mechanism,
    n AS n_tstr_datapoints, n < 2 AS insufficient_tstr_data
  FROM points LEFT JOIN lost l USING ({CHAIN_SQL}) LEFT JOIN emptied e USING ({CHAIN_SQL}))"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    wide = v.trajectory(spark, folder)
    return events.failure_events(v.metric_rows(wide, "auroc_like"), v.minority(wide), threshold=0.3)


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    onsets = _onsets(spark, folder).filter(F.col("metric") == "flag_rate")
    return events.dissociation(events.join_onset(_events(spark, folder), onsets))


@query(f"WITH {EVENTS_SQL} SELECT * FROM events_of")
def failure_events(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        *v.CHAIN, long_of("time"), long_of("event"), "mechanism", "n_tstr_datapoints", "insufficient_tstr_data"
    )


@query(f"""WITH {EVENTS_SQL},
low AS (SELECT {CHAIN_SQL}, max(generation) FILTER (auroc_like > 0.3) AS last_g FROM trajectory GROUP BY ALL),
share AS (SELECT {CHAIN_SQL}, min(generation) FILTER (value = 0) AS collapse_g, max(generation) AS max_g FROM minority GROUP BY ALL)
SELECT {CHAIN_SQL}, CAST(last_g AS BIGINT) AS last_tstr_generation, CAST(collapse_g AS BIGINT) AS collapse_generation, CAST(max_g AS BIGINT) AS max_generation,
       CAST(last_g - collapse_g AS BIGINT) AS diff_vs_collapse FROM low FULL JOIN share USING ({CHAIN_SQL})""")
def coverage_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    wide = v.trajectory(spark, folder)
    utility = v.metric_rows(wide, "auroc_like").withColumn("value", F.when(F.col("value") > 0.3, F.col("value")))
    out = events.coverage_reconciliation(utility, v.minority(wide))
    return out.select(*v.CHAIN, *[long_of(c) for c in ("last_tstr_generation", "collapse_generation", "max_generation", "diff_vs_collapse")])


JOINED_SQL = f"""{EVENTS_SQL},
joined AS (SELECT {CHAIN_SQL}, time, event, onset_generation, crossed,
   CASE WHEN event = 1 AND crossed AND onset_generation < time THEN 'both__hallucination_before_failure'
        WHEN event = 1 AND crossed AND onset_generation = time THEN 'both__same_generation'
        WHEN event = 1 AND crossed THEN 'both__hallucination_after_failure'
        WHEN event = 1 THEN 'failure_only' WHEN crossed THEN 'hallucination_only' ELSE 'neither' END AS category
  FROM events_of JOIN (SELECT * FROM onsets WHERE metric = 'flag_rate') o USING ({CHAIN_SQL}))"""


@query(f"WITH {JOINED_SQL} SELECT {CHAIN_SQL}, time AS failure_time, event AS failure_event, CAST(onset_generation AS BIGINT) AS onset_generation, crossed AS onset_crossed, 'both' AS found_in, category AS dissociation_category FROM joined")
def dissociation_chains(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(spark, folder).select(
        *v.CHAIN, long_of("failure_time"), long_of("failure_event"), long_of("onset_generation"), "onset_crossed", "found_in", "dissociation_category"
    )


@query(f"""WITH {JOINED_SQL}, listed(category) AS (VALUES {', '.join(f"('{c}')" for c in events.CATEGORIES)})
SELECT category, count(generator) AS n_chains FROM listed LEFT JOIN joined USING (category) GROUP BY category""")
def dissociation_categories(spark: SparkSession, folder: str) -> DataFrame:
    return events.category_counts(_joined(spark, folder))


INTERVALS_SQL = f"""{JOINED_SQL},
intervals AS (
  SELECT {CHAIN_SQL}, 0.0 AS start, CAST(CASE WHEN onset_generation > 0 AND onset_generation < time THEN onset_generation ELSE time END AS DOUBLE) AS stop,
         CASE WHEN onset_generation > 0 AND onset_generation < time THEN 0 ELSE event END AS event,
         CASE WHEN onset_generation <= 0 AND onset_generation < time THEN 1 ELSE 0 END AS active FROM joined WHERE time > 0
  UNION ALL
  SELECT {CHAIN_SQL}, CAST(onset_generation AS DOUBLE), CAST(time AS DOUBLE), event, 1 FROM joined WHERE time > 0 AND onset_generation > 0 AND onset_generation < time)"""


@query(f"WITH {INTERVALS_SQL} SELECT {CHAIN_SQL}, CAST(start AS DOUBLE) AS start, stop, CAST(event AS BIGINT) AS event, CAST(active AS BIGINT) AS active FROM intervals")
def interval_split(spark: SparkSession, folder: str) -> DataFrame:
    return events.risk_intervals(_joined(spark, folder)).select(*v.CHAIN, "start", "stop", long_of("event"), long_of("active"))


@query(f"""WITH {INTERVALS_SQL},
event_times AS (SELECT DISTINCT dseed, generator, stop AS t FROM intervals WHERE event = 1)
SELECT dseed, generator, CAST(t AS BIGINT) AS t, count_if(active = 0) AS n0, count_if(active = 1) AS n1,
       count_if(active = 0 AND event = 1 AND stop = t) AS d0, count_if(active = 1 AND event = 1 AND stop = t) AS d1
FROM event_times JOIN intervals USING (dseed, generator) WHERE start < t AND t <= stop GROUP BY ALL""")
def risk_sets(spark: SparkSession, folder: str) -> DataFrame:
    intervals = events.risk_intervals(_joined(spark, folder))
    return survival.interval_risk_sets(intervals, ["dseed", "generator"]).select("dseed", "generator", long_of("t"), "n0", "n1", "d0", "d1")


# -------------------------------------------------------------- paired timing
def _subset_sql(source: str, keys: str) -> str:
    """pairs repeated for the full population and every left-out seed (checks only)."""
    return f"""
seeds AS (SELECT DISTINCT {keys}, 'dseed' AS kind, dseed AS seed FROM {source} UNION SELECT DISTINCT {keys}, 'mseed', mseed FROM {source}),
subsets AS (SELECT DISTINCT {keys}, 'full' AS kind, CAST(NULL AS BIGINT) AS seed FROM {source} UNION ALL SELECT * FROM seeds),
labelled AS (SELECT *, CASE kind WHEN 'full' THEN 'Full population' WHEN 'dseed' THEN 'Excluding data seed ' || seed ELSE 'Excluding model seed ' || seed END AS subset FROM subsets)"""


def _timing_sql(keys: str, joined_keys: str) -> str:
    """Tau-b and Wilcoxon by brute force over pairs of chains, per key and subset."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in f"{keys}, subset".split(","))
    return f"""
rows_of AS (SELECT l.subset, p.*, row_number() OVER () AS rid FROM labelled l JOIN pairs p USING ({keys})
            WHERE l.kind = 'full' OR (l.kind = 'dseed' AND p.dseed <> l.seed) OR (l.kind = 'mseed' AND p.mseed <> l.seed)),
duels AS (SELECT a.subset, {', '.join('a.' + k.strip() for k in keys.split(','))}, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy
          FROM rows_of a JOIN rows_of b ON {on} AND a.rid < b.rid),
tau AS (SELECT {keys}, subset, count_if(sx * sy > 0) AS concordant, count_if(sx * sy < 0) AS discordant,
               count_if(sx <> 0) AS ux, count_if(sy <> 0) AS uy FROM duels GROUP BY ALL),
ranked AS (SELECT {keys}, subset, y - x AS d, rank() OVER w + (count(*) OVER (PARTITION BY {keys}, subset, abs(y - x)) - 1) / 2.0 AS rk
           FROM rows_of WHERE y <> x WINDOW w AS (PARTITION BY {keys}, subset ORDER BY abs(y - x))),
signed AS (SELECT {keys}, subset, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus FROM ranked GROUP BY ALL),
middle AS (SELECT {keys}, subset, count(*) AS n, median(y - x) AS med FROM rows_of GROUP BY ALL)
SELECT {keys}, subset, coalesce(n, 0) AS n_pairs, CASE WHEN n >= 2 THEN concordant END AS concordant, CASE WHEN n >= 2 THEN discordant END AS discordant,
  {s6('CASE WHEN n >= 2 THEN (concordant - discordant) / nullif(sqrt(ux) * sqrt(uy), 0) END', 'tau')},
  {s6('CASE WHEN n >= 2 THEN med END', 'median_offset')}, {s6('CASE WHEN n >= 2 THEN w_plus END', 'w_plus')},
  {s6('CASE WHEN n >= 2 THEN w_minus END', 'w_minus')}, {s6('CASE WHEN n >= 2 THEN least(w_plus, w_minus) END', 'wilcoxon_stat')}
FROM labelled LEFT JOIN middle USING ({keys}, subset) LEFT JOIN tau USING ({keys}, subset) LEFT JOIN signed USING ({keys}, subset)"""


def _timing_out(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "subset", "n_pairs", "concordant", "discordant", r6("tau"), r6("median_offset"), r6("w_plus"), r6("w_minus"), r6("wilcoxon_stat")
    )


@query(f"""WITH {JOINED_SQL}, universe AS (SELECT 'flag_rate' AS metric, dseed, mseed FROM joined), {_subset_sql('universe', 'metric')},
pairs AS (SELECT 'flag_rate' AS metric, dseed, mseed, onset_generation AS x, time AS y FROM joined WHERE event = 1 AND crossed), {_timing_sql('metric', '')}""")
def paired_timing(spark: SparkSession, folder: str) -> DataFrame:
    chains = paired.onset_failure_chains(_joined(spark, folder), {"metric": F.lit("flag_rate")})
    return _timing_out(paired.paired_timing(chains, ["metric"], p_values=False), ["metric"])


_METRIC_PAIRS = """
lefts AS (SELECT generator, dseed, mseed, onset_generation AS x FROM onsets WHERE metric = 'flag_rate'),
rights AS (SELECT generator, dseed, mseed, metric AS qa_metric, onset_generation AS y FROM onsets WHERE metric <> 'flag_rate'),
universe AS (SELECT * FROM lefts JOIN rights USING (generator, dseed, mseed)),
pairs AS (SELECT * FROM universe WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(f"WITH {INCLINE_SQL}, {_METRIC_PAIRS}, {_subset_sql('universe', 'qa_metric')}, {_timing_sql('qa_metric', '')}")
def paired_timing_metrics(spark: SparkSession, folder: str) -> DataFrame:
    chains = paired.onset_onset_chains(_onsets(spark, folder), "flag_rate", ["positive_share", "auroc_like"])
    return _timing_out(paired.paired_timing(chains, ["qa_metric"], p_values=False), ["qa_metric"])


@query(f"WITH {INCLINE_SQL}, {_METRIC_PAIRS}, {_subset_sql('universe', 'qa_metric, generator')}, timing AS ({_timing_sql('qa_metric, generator', '')[1:].replace('rows_of AS', 'WITH rows_of AS', 1)}) SELECT * FROM timing WHERE subset = 'Full population'")
def paired_timing_by_generator(spark: SparkSession, folder: str) -> DataFrame:
    chains = paired.onset_onset_chains(_onsets(spark, folder), "flag_rate", ["positive_share", "auroc_like"], by_generator=True)
    out = paired.paired_timing(chains, ["qa_metric", "generator"], p_values=False)
    return _timing_out(out.filter(F.col("subset") == subsets.FULL), ["qa_metric", "generator"])


# The exact null distributions by their recurrences: shares of permutations by inversions, of sign patterns by rank sum.
EXACT_SQL = """
inversions AS (SELECT 1 AS size, [1.0::DOUBLE] AS share UNION ALL
  SELECT size + 1, list_transform(range(size * (size + 1) // 2 + 1), lambda i: coalesce(list_sum(share[greatest(1, i - size + 1):i + 1]), 0) / (size + 1)) FROM inversions WHERE size < 33),
rank_sums AS (SELECT 0 AS size, [1.0::DOUBLE] AS share UNION ALL
  SELECT size + 1, list_transform(range((size + 1) * (size + 2) // 2 + 1), lambda i: (coalesce(share[i + 1], 0) + CASE WHEN i > size THEN coalesce(share[i - size], 0) ELSE 0 END) / 2) FROM rank_sums WHERE size < 50)"""


def _tested_sql(keys: str) -> str:
    """CTEs up to ``tested``: statistics, p values and how they were found, per key and subset."""
    counts = _timing_sql(keys, "")
    whole = counts[: counts.rindex("\nSELECT")]

    def ties(side: str) -> str:
        return f"""{side}_ties AS (SELECT {keys}, subset, sum(t * (t - 1) / 2) AS {side}0, sum(t * (t - 1) * (t - 2)) AS {side}1, sum(t * (t - 1) * (2 * t + 5)) AS {side}2
  FROM (SELECT {keys}, subset, {side}, count(*) AS t FROM rows_of GROUP BY ALL) g GROUP BY {keys}, subset)"""

    pairs = "(n * (n - 1.0))"
    variance = f"(({pairs} * (2 * n + 5) - x2 - y2) / 18 + 2 * x0 * y0 / {pairs} + coalesce(x1 * y1 / nullif(9 * {pairs} * (n - 2), 0), 0))"
    return f"""{whole},
{ties('x')}, {ties('y')},
zero_free AS (SELECT {keys}, subset, sum(t) AS nz, sum(t * t * t - t) AS tie FROM (SELECT {keys}, subset, abs(y - x) AS a, count(*) AS t FROM rows_of WHERE y <> x GROUP BY ALL) g GROUP BY {keys}, subset),
scored AS (SELECT {keys}, subset, coalesce(n, 0) AS n_pairs, n, med, CASE WHEN n >= 2 THEN discordant END AS dis, CASE WHEN n >= 2 THEN (concordant - discordant) / nullif(sqrt(ux) * sqrt(uy), 0) END AS tau,
    CASE WHEN n >= 2 AND ux > 0 AND uy > 0 THEN (concordant - discordant) / sqrt({variance}) END AS tau_z, x0 = 0 AND y0 = 0 AND n <= 33 AS tau_exact,
    CASE WHEN n >= 2 THEN least(w_plus, w_minus) END AS w, nz, coalesce(tie = 0 AND nz = n AND nz <= 50, FALSE) AS w_exact,
    CASE WHEN n >= 2 THEN (least(w_plus, w_minus) - nz * (nz + 1) / 4.0) / nullif(sqrt(nz * (nz + 1) * (2 * nz + 1) / 24.0 - tie / 48.0), 0) END AS w_z
  FROM labelled LEFT JOIN middle USING ({keys}, subset) LEFT JOIN tau USING ({keys}, subset) LEFT JOIN signed USING ({keys}, subset)
  LEFT JOIN x_ties USING ({keys}, subset) LEFT JOIN y_ties USING ({keys}, subset) LEFT JOIN zero_free USING ({keys}, subset)),
tested AS (SELECT s.*,
    CASE WHEN tau_z IS NULL THEN NULL WHEN tau_exact THEN CASE WHEN 4 * dis = n * (n - 1) THEN 1.0 ELSE least(1.0, 2 * list_sum(i.share[1:CAST(least(dis, n * (n - 1) // 2 - dis) AS BIGINT) + 1])) END ELSE {chi2_tail_sql('tau_z * tau_z', '1')} END AS tau_p,
    CASE WHEN tau_z IS NOT NULL THEN CASE WHEN tau_exact THEN 'exact' ELSE 'normal' END END AS tau_p_method,
    CASE WHEN w_z IS NULL THEN NULL WHEN w_exact THEN least(1.0, 2 * list_sum(r.share[1:CAST(w AS BIGINT) + 1])) ELSE {chi2_tail_sql('w_z * w_z', '1')} END AS wilcoxon_p,
    CASE WHEN w_z IS NOT NULL THEN CASE WHEN w_exact THEN 'exact' ELSE 'normal' END END AS wilcoxon_p_method
  FROM scored s LEFT JOIN inversions i ON i.size = s.n LEFT JOIN rank_sums r ON r.size = s.nz)"""


_FAILURE_PAIRS = f"""{JOINED_SQL}, universe AS (SELECT 'flag_rate' AS metric, dseed, mseed FROM joined), {_subset_sql('universe', 'metric')},
pairs AS (SELECT 'flag_rate' AS metric, dseed, mseed, onset_generation AS x, time AS y FROM joined WHERE event = 1 AND crossed)"""
_TESTED = f"{s6('tau')}, {s6('tau_p')}, tau_p_method, {s6('w', 'wilcoxon_stat')}, {s6('wilcoxon_p')}, wilcoxon_p_method"
TIMING_P_SQL = f"{_FAILURE_PAIRS}, {EXACT_SQL.lstrip()}, {_tested_sql('metric')}"


def _tested_out(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "subset", "n_pairs", r6("tau"), r6("tau_p"), "tau_p_method", r6("wilcoxon_stat"), r6("wilcoxon_p"), "wilcoxon_p_method")


@query(f"WITH RECURSIVE {TIMING_P_SQL} SELECT metric, subset, n_pairs, {_TESTED} FROM tested")
def paired_timing_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Test table with p values, exact for small samples without ties."""
    chains = paired.onset_failure_chains(_joined(spark, folder), {"metric": F.lit("flag_rate")})
    return _tested_out(paired.paired_timing(chains, ["metric"]), ["metric"])


# Generations of the largest steps lie far apart, so few chains often have no ties.
_SMALL_PAIRS = f"""
best AS (SELECT metric, {CHAIN_SQL}, generation FROM steps WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric, {CHAIN_SQL} ORDER BY abs(step) DESC, generation) = 1),
spikes AS (SELECT metric, {CHAIN_SQL}, CAST(generation AS BIGINT) AS generation FROM registry LEFT JOIN best USING (metric, {CHAIN_SQL})),
universe AS (SELECT l.generator, l.dseed, l.mseed, r.metric || ' of data seed ' || l.dseed AS qa_metric, l.generation AS x, r.generation AS y
  FROM spikes l JOIN spikes r ON l.generator = r.generator AND l.dseed = r.dseed AND l.mseed = r.mseed WHERE l.metric = 'flag_rate' AND r.metric <> 'flag_rate'),
pairs AS (SELECT * FROM universe WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(f"WITH RECURSIVE {REGISTRY_SQL}, {_SMALL_PAIRS.lstrip()}, {_subset_sql('universe', 'qa_metric, generator')}, {EXACT_SQL.lstrip()}, {_tested_sql('qa_metric, generator')} SELECT qa_metric, generator, subset, n_pairs, {_TESTED} FROM tested")
def paired_timing_few_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Tests on the five chains of a generator and data seed, where exact distributions apply."""
    rows = _tidy(spark, folder)
    spikes = onset.largest_step(rows, onset.chain_registry(rows), list(v.ONSETS)).withColumnRenamed("spike_generation", "onset_generation")
    chains = paired.onset_onset_chains(spikes, "flag_rate", ["positive_share", "auroc_like"], by_generator=True)
    named = chains.withColumn("qa_metric", F.concat("qa_metric", F.lit(" of data seed "), F.col("dseed").cast("string")))
    return _tested_out(paired.paired_timing(named, ["qa_metric", "generator"]), ["qa_metric", "generator"])


# ------------------------------------------------------------------ ranking
_GROUPS_SQL = "groups(\"group\", generator, size) AS (VALUES ('base', 'ARF', 4), ('base', 'CTGAN', 4), ('base', 'DDPM', 4), ('base', 'RTVAE', 4), ('base_excl_rtvae', 'ARF', 3), ('base_excl_rtvae', 'CTGAN', 3), ('base_excl_rtvae', 'DDPM', 3))"
RANKS_SQL = f"""{EVENTS_SQL}, {_GROUPS_SQL},
members AS (SELECT g.*, e.* EXCLUDE (generator), count(*) OVER (PARTITION BY "group", dseed, mseed) = size AS complete,
                   count_if(event = 1) OVER (PARTITION BY "group", dseed, mseed) AS n_failed FROM events_of e JOIN groups g USING (generator)),
ranks AS (SELECT *, CASE WHEN NOT complete THEN NULL WHEN event = 1
            THEN rank() OVER (PARTITION BY "group", dseed, mseed, event ORDER BY time) + (count(*) OVER (PARTITION BY "group", dseed, mseed, event, time) - 1) / 2.0
            ELSE (n_failed + 1 + size) / 2.0 END AS rk FROM members)"""


@query(f'WITH {RANKS_SQL} SELECT "group", dseed, mseed, generator, complete, {s6("rk", "rank")} FROM ranks')
def rank_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_rows(_events(spark, folder)).select("group", "dseed", "mseed", "generator", "complete", r6("rank"))


# Chains that are left out, so that some pairs are incomplete.
_LEFT_OUT = "(generator = 'DDPM' AND mseed = 4) OR (generator = 'ARF' AND mseed = 4 AND dseed = 1)"
_INCOMPLETE_SQL = RANKS_SQL.replace("FROM events_of e JOIN groups g", f"FROM (SELECT * FROM events_of WHERE NOT ({_LEFT_OUT})) e JOIN groups g")


@query(f"""WITH {_INCOMPLETE_SQL} SELECT "group", dseed, mseed, string_agg(missing, ', ' ORDER BY missing) AS missing_generators FROM (
  SELECT p."group", p.dseed, p.mseed, g.generator AS missing FROM (SELECT DISTINCT "group", dseed, mseed FROM ranks WHERE NOT complete) p
  JOIN groups g USING ("group") ANTI JOIN ranks r ON r."group" = p."group" AND r.dseed = p.dseed AND r.mseed = p.mseed AND r.generator = g.generator) x
GROUP BY ALL""")
def rank_incomplete_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.incomplete_pairs(ranking.rank_rows(_events(spark, folder).filter(f"NOT ({_LEFT_OUT})")))


@query(f"""WITH {RANKS_SQL} SELECT "group", generator, {s6('avg(rk)', 'mean_rank')}, {s6('median(rk)', 'median_rank')}, {s6('min(rk)', 'min_rank')}, {s6('max(rk)', 'max_rank')},
  count_if(rk = 1) AS n_ranked_1st, count(*) AS n_seed_pairs FROM ranks WHERE complete GROUP BY "group", generator""")
def rank_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.rank_summary(ranking.rank_rows(_events(spark, folder)))
    return out.select("group", "generator", r6("mean_rank"), r6("median_rank"), r6("min_rank"), r6("max_rank"), "n_ranked_1st", "n_seed_pairs")


W_SQL = f"""{RANKS_SQL}, {_subset_sql('ranks', '"group"')},
used AS (SELECT l.subset, r.* FROM labelled l JOIN (SELECT * FROM ranks WHERE complete) r USING ("group")
         WHERE l.kind = 'full' OR (l.kind = 'dseed' AND r.dseed <> l.seed) OR (l.kind = 'mseed' AND r.mseed <> l.seed)),
sums AS (SELECT "group", subset, generator, sum(rk) AS r, max(size) AS n, count(*) AS m FROM used GROUP BY ALL),
tied AS (SELECT "group", subset, sum(t * t * t - t) AS tie FROM (SELECT "group", subset, dseed, mseed, rk, count(*) AS t FROM used GROUP BY ALL) x GROUP BY ALL),
w_of AS (SELECT "group", subset, max(m) AS m, max(n) AS n, 12.0 * (sum(r * r) - sum(r) * sum(r) / max(n)) / nullif(max(m) * max(m) * (max(n) ** 3 - max(n)) - max(m) * max(tie), 0) AS w
         FROM sums JOIN tied USING ("group", subset) GROUP BY ALL)"""


@query(f"""WITH {W_SQL}
SELECT "group", subset, coalesce(m, 0) AS n_seed_pairs, CAST(n AS BIGINT) AS n_generators, {s6('w')}, {s6('m * (n - 1) * w', 'chi2')}, CAST(n - 1 AS BIGINT) AS df,
       {s6(chi2_tail_sql('m * (n - 1) * w', 'n - 1'), 'p')} FROM labelled LEFT JOIN w_of USING ("group", subset)""")
def kendall_w(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.kendalls_w(ranking.rank_rows(_events(spark, folder)))
    return out.select("group", "subset", "n_seed_pairs", "n_generators", r6("w"), r6("chi2"), "df", r6("p"))


# ----------------------------------------------------------------- survival
KM_SQL = f"""{EVENTS_SQL},
per_time AS (SELECT generator, time, count_if(event = 1) AS deaths, count_if(event = 0) AS censored FROM events_of GROUP BY ALL),
at_risk AS (SELECT *, CAST(sum(deaths + censored) OVER (PARTITION BY generator ORDER BY time DESC) AS BIGINT) AS n FROM per_time),
factors AS (SELECT *, 1 - deaths / n AS f, CASE WHEN deaths > 0 AND n > deaths THEN deaths / (n * (n - deaths)) ELSE 0 END AS g FROM at_risk),
km AS (SELECT a.generator, a.time, max(a.n) AS n_at_risk, max(a.deaths) AS deaths, max(a.censored) AS censored, product(b.f) AS s, sum(b.g) AS green
       FROM factors a JOIN factors b ON a.generator = b.generator AND b.time <= a.time GROUP BY ALL),
km_ci AS (SELECT *, greatest(0, s - 1.96 * s * sqrt(green)) AS lo, least(1, s + 1.96 * s * sqrt(green)) AS hi FROM km)"""


@query(f"WITH {KM_SQL} SELECT generator, time, n_at_risk, deaths, censored, {s6('s', 'survival')}, {s6('lo', 'ci_low')}, {s6('hi', 'ci_high')} FROM km_ci")
def kaplan_meier(spark: SparkSession, folder: str) -> DataFrame:
    out = survival.survival_table(_events(spark, folder), ["generator"])
    return out.select("generator", long_of("time"), "n_at_risk", "deaths", "censored", r6("survival"), r6("ci_low"), r6("ci_high"))


@query(f"""WITH {KM_SQL},
steps_of AS (SELECT generator, 0.0 AS time, 1.0 AS s, 1.0 AS lo, 1.0 AS hi, 0 AS o FROM km GROUP BY generator
             UNION ALL SELECT generator, time, s, lo, hi, 1 FROM km_ci WHERE deaths > 0),
lasts AS (SELECT generator, max(time) AS t, arg_max(s, time + o * 0.5) AS s, arg_max(lo, time + o * 0.5) AS lo, arg_max(hi, time + o * 0.5) AS hi FROM steps_of GROUP BY generator),
every AS (SELECT * FROM steps_of UNION ALL SELECT generator, 19, s, lo, hi, 2 FROM lasts WHERE t < 19)
SELECT generator, row_number() OVER (PARTITION BY generator ORDER BY time, o) - 1 AS step, CAST(time AS DOUBLE) AS time, {s6('s', 'survival')}, {s6('lo', 'ci_low')}, {s6('hi', 'ci_high')} FROM every""")
def kaplan_meier_curve(spark: SparkSession, folder: str) -> DataFrame:
    table = survival.survival_table(_events(spark, folder), ["generator"])
    out = survival.step_curve(table, ["generator"])
    return out.select("generator", long_of("step"), "time", r6("survival"), r6("ci_low"), r6("ci_high"))


@query(f"WITH {KM_SQL} SELECT generator, time, {s6('s', 'survival')}, censored FROM km WHERE censored > 0")
def censor_points(spark: SparkSession, folder: str) -> DataFrame:
    table = survival.survival_table(_events(spark, folder), ["generator"])
    return survival.censor_points(table, ["generator"]).select("generator", long_of("time"), r6("survival"), "censored")


LOGRANK_SQL = f"""{EVENTS_SQL}, {_GROUPS_SQL},
members AS (SELECT g."group", g.size, e.* FROM events_of e JOIN groups g USING (generator)), {_subset_sql('members', '"group"')},
used AS (SELECT l.subset, r.* FROM labelled l JOIN members r USING ("group")
         WHERE l.kind = 'full' OR (l.kind = 'dseed' AND r.dseed <> l.seed) OR (l.kind = 'mseed' AND r.mseed <> l.seed)),
times AS (SELECT DISTINCT "group", subset, time AS t FROM used WHERE event = 1),
sets AS (SELECT "group", subset, t, generator, count_if(time >= t) AS n, count_if(time = t AND event = 1) AS d FROM times JOIN used USING ("group", subset) GROUP BY ALL)"""


@query(f"""WITH {LOGRANK_SQL},
both_sides AS (SELECT a."group", a.subset, a.generator || ' vs ' || b.generator AS comparison, a.n AS na, a.d AS da, b.n AS nb, b.d AS db
               FROM sets a JOIN sets b USING ("group", subset, t) WHERE a.generator < b.generator),
sums AS (SELECT "group", subset, comparison, sum(CASE WHEN na + nb > 0 THEN da - (da + db) * na / (na + nb) END) AS z,
           sum(CASE WHEN na + nb > 1 THEN (da + db) * (na + nb - da - db) / (na + nb - 1) * (na / (na + nb)) * (nb / (na + nb)) ELSE 0 END) AS v FROM both_sides GROUP BY ALL),
tested AS (SELECT *, coalesce(z * z / nullif(v, 0), 0) AS statistic, {chi2_tail_sql('coalesce(z * z / nullif(v, 0), 0)', '1')} AS p FROM sums),
stepped AS (SELECT *, (count(*) OVER (PARTITION BY "group", subset) - row_number() OVER (PARTITION BY "group", subset ORDER BY p) + 1) * p AS adj FROM tested)
SELECT "group", subset, comparison, {s6('statistic')}, CAST(1 AS BIGINT) AS df, {s6('p')},
       {s6('least(1.0, max(adj) OVER (PARTITION BY "group", subset ORDER BY p ROWS UNBOUNDED PRECEDING))', 'p_holm')} FROM stepped""")
def holm_pairwise(spark: SparkSession, folder: str) -> DataFrame:
    out = survival.logrank_pairwise(_events(spark, folder))
    return out.select("group", "subset", "comparison", r6("statistic"), "df", r6("p"), r6("p_holm"))


# Quadratic form of the three-generator group in closed form; the four-generator
# group is checked through its equal value for any choice of three scores.
@query(f"""WITH {LOGRANK_SQL},
wide AS (SELECT "group", subset, t, sum(n) AS n, sum(d) AS d,
   sum(n) FILTER (generator = 'ARF') AS n1, sum(d) FILTER (generator = 'ARF') AS d1, sum(n) FILTER (generator = 'CTGAN') AS n2, sum(d) FILTER (generator = 'CTGAN') AS d2,
   sum(n) FILTER (generator = 'DDPM') AS n3, sum(d) FILTER (generator = 'DDPM') AS d3
   FROM sets GROUP BY ALL),
coef AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS k FROM wide WHERE n > 0),
m AS (SELECT "group", subset, sum(d1 - d * n1 / n) AS z1, sum(d2 - d * n2 / n) AS z2, sum(d3 - d * n3 / n) AS z3,
  sum(k * (n1 / n) * (1 - n1 / n)) AS a, sum(k * (n2 / n) * (1 - n2 / n)) AS e, sum(k * (n3 / n) * (1 - n3 / n)) AS i,
  sum(-k * (n1 / n) * (n2 / n)) AS b, sum(-k * (n1 / n) * (n3 / n)) AS c, sum(-k * (n2 / n) * (n3 / n)) AS f FROM coef GROUP BY ALL),
stat AS (SELECT "group", subset, CASE WHEN "group" = 'base_excl_rtvae' THEN (e * z1 * z1 - 2 * b * z1 * z2 + a * z2 * z2) / (a * e - b * b)
  ELSE ((e * i - f * f) * z1 * z1 + (a * i - c * c) * z2 * z2 + (a * e - b * b) * z3 * z3 + 2 * (c * f - b * i) * z1 * z2 + 2 * (b * f - c * e) * z1 * z3 + 2 * (b * c - a * f) * z2 * z3)
       / (a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e)) END AS statistic, CASE WHEN "group" = 'base_excl_rtvae' THEN 2 ELSE 3 END AS df FROM m)
SELECT "group", subset, {s6('statistic')}, CAST(df AS BIGINT) AS df, {s6(chi2_tail_sql('statistic', 'df'), 'p')} FROM labelled LEFT JOIN stat USING ("group", subset)""")
def logrank(spark: SparkSession, folder: str) -> DataFrame:
    out = survival.logrank(_events(spark, folder))
    return out.select("group", "subset", r6("statistic"), "df", r6("p"))


# Newton steps of the one-covariate model, a recursive query over the terms of Efron's likelihood.
_RISK = "b * exp(beta)"
COX_SQL = f"""{INTERVALS_SQL},
event_times AS (SELECT DISTINCT dseed, generator, stop AS t FROM intervals WHERE event = 1),
cox_sets AS (SELECT dseed, generator, t, count_if(active = 0) AS n0, count_if(active = 1) AS n1, count_if(active = 0 AND event = 1 AND stop = t) AS d0, count_if(active = 1 AND event = 1 AND stop = t) AS d1
             FROM event_times JOIN intervals USING (dseed, generator) WHERE start < t AND t <= stop GROUP BY ALL),
cox_terms AS (SELECT n0 - l / (d0 + d1) * d0 AS a, n1 - l / (d0 + d1) * d1 AS b, CASE WHEN l = 0 THEN d1 ELSE 0 END AS o FROM (SELECT *, unnest(range(CAST(d0 + d1 AS BIGINT))) AS l FROM cox_sets) x),
newton AS (
  SELECT 0 AS k, 0.0::DOUBLE AS beta
  UNION ALL SELECT k + 1, any_value(beta) + greatest(-2.0, least(2.0, sum(o - {_RISK} / (a + {_RISK})) / sum({_RISK} / (a + {_RISK}) * a / (a + {_RISK})))) FROM newton, cox_terms WHERE k < 40 GROUP BY k),
cox_at AS (SELECT beta, 1 / sqrt(sum({_RISK} / (a + {_RISK}) * a / (a + {_RISK}))) AS se, sum(o * beta - ln(a + {_RISK})) AS loglik, sum(-ln(a + b)) AS null_loglik FROM newton, cox_terms WHERE k = 40 GROUP BY beta),
cox_fit AS (SELECT CASE WHEN abs(beta) <= 20 THEN beta END AS beta, CASE WHEN abs(beta) <= 20 THEN se END AS se, loglik, null_loglik, abs(beta) <= 20 AS converged FROM cox_at),
cox_facts AS (SELECT count(*) AS n_chains, count_if(time > 0) AS n_chains_in_model, count_if(time > 0 AND event = 1) AS n_events FROM joined)"""


@query(f"""WITH RECURSIVE {COX_SQL}
SELECT 'onset_active' AS covariate, {s6('beta', 'coef')}, {s6('exp(beta)', 'hazard_ratio')}, {s6('se')}, {s6('exp(beta - 1.959963984540054 * se)', 'ci_low')},
  {s6('exp(beta + 1.959963984540054 * se)', 'ci_high')}, {s6('beta / se', 'z')}, {s6(chi2_tail_sql('(beta / se) * (beta / se)', '1'), 'p')},
  n_chains, n_chains_in_model, n_events, {s6('null_loglik', 'log_likelihood_null')}, {s6('loglik', 'log_likelihood')}, converged FROM cox_fit, cox_facts""")
def cox_time_varying(spark: SparkSession, folder: str) -> DataFrame:
    joined = _joined(spark, folder)
    out = survival.cox_time_varying(joined, events.risk_intervals(joined))
    doubles = ["coef", "hazard_ratio", "se", "ci_low", "ci_high", "z", "p", "log_likelihood_null", "log_likelihood"]
    return out.select("covariate", *[r6(c) for c in doubles], "n_chains", "n_chains_in_model", "n_events", "converged")


# The stratified models: up to three coefficients, relative to the first generator of a model, by Newton steps in closed form.
_PLACES = (1, 2, 3, 4)
_SUM = "(x1 + x2 * exp(b2) + x3 * exp(b3) + x4 * exp(b4))"


def _share(j: int) -> str:
    return f"(x{j} * exp(b{j}) / {_SUM})"


# a place that a model lacks has no score; its information is set to one
_SUMS = ", ".join(
    [f"sum(o{j} - {_share(j)}) AS g{j}" for j in (2, 3, 4)]
    + [f"sum({_share(j)} * (1 - {_share(j)})) + CASE WHEN any_value(size) < {j} THEN 1 ELSE 0 END AS h{j}{j}" for j in (2, 3, 4)]
    + [f"sum(-{_share(i)} * {_share(j)}) AS h{i}{j}" for i, j in ((2, 3), (2, 4), (3, 4))]
)
_DET = "(h22 * (h33 * h44 - h34 * h34) - h23 * (h23 * h44 - h24 * h34) + h24 * (h23 * h34 - h24 * h33))"
_STEPS = {
    2: "g2 * (h33 * h44 - h34 * h34) - h23 * (g3 * h44 - h34 * g4) + h24 * (g3 * h34 - h33 * g4)",
    3: "h22 * (g3 * h44 - h34 * g4) - g2 * (h23 * h44 - h34 * h24) + h24 * (h23 * g4 - g3 * h24)",
    4: "h22 * (h33 * g4 - g3 * h34) - h23 * (h23 * g4 - g3 * h24) + g2 * (h23 * h34 - h33 * h24)",
}
_NEXT = ", ".join(
    f"b{j} + CASE WHEN greatest(abs(b2), abs(b3), abs(b4)) > 30 OR greatest(abs(g2), abs(g3), abs(g4)) < 1e-12 THEN 0 ELSE coalesce(greatest(-2.0, least(2.0, ({step}) / nullif({_DET}, 0))), 0) END AS b{j}" for j, step in _STEPS.items()
)
STRATIFIED_SQL = f"""{LOGRANK_SQL},
status AS (SELECT "group", subset, generator, count(*) = count_if(event = 1) AS always FROM used GROUP BY ALL),
models AS (
  SELECT "group", subset, 'Stratified Cox LRT (all generators)' AS test, list(generator ORDER BY generator) AS live FROM status GROUP BY "group", subset
  UNION ALL SELECT "group", subset, 'Stratified Cox LRT (excluding ' || string_agg(generator, ', ' ORDER BY generator) FILTER (always) || ')', list(generator ORDER BY generator) FILTER (NOT always)
  FROM status GROUP BY "group", subset HAVING count_if(always) > 0 AND count_if(NOT always) >= 2),
pair_times AS (SELECT DISTINCT "group", subset, dseed, mseed, time AS t FROM used WHERE event = 1),
pair_sets AS (SELECT "group", subset, test, len(live) AS size, dseed, mseed, t, {', '.join(f"count_if(coalesce(live[{j}] = generator, FALSE) AND time >= t) AS n{j}, count_if(coalesce(live[{j}] = generator, FALSE) AND time = t AND event = 1) AS d{j}" for j in _PLACES)}
              FROM models JOIN pair_times USING ("group", subset) JOIN used USING ("group", subset, dseed, mseed) GROUP BY ALL),
pair_terms AS (SELECT "group", subset, test, size, {', '.join(f"n{j} - l / d * d{j} AS x{j}, CASE WHEN l = 0 THEN d{j} ELSE 0 END AS o{j}" for j in _PLACES)}
               FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM (SELECT *, d1 + d2 + d3 + d4 AS d FROM pair_sets) y) z),
newton AS (
  SELECT 0 AS k, "group", subset, test, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 0.0::DOUBLE AS b4 FROM models
  UNION ALL SELECT k + 1, "group", subset, test, {_NEXT}
  FROM (SELECT k, "group", subset, test, b2, b3, b4, {_SUMS} FROM newton JOIN pair_terms USING ("group", subset, test) WHERE k < 60 GROUP BY k, "group", subset, test, b2, b3, b4) q),
pair_fit AS (SELECT "group", subset, test, 2 * (sum(o2 * b2 + o3 * b3 + o4 * b4 - ln({_SUM})) - sum(-ln(x1 + x2 + x3 + x4))) AS statistic, max(greatest(abs(b2), abs(b3), abs(b4))) <= 25 AS converged
             FROM newton JOIN pair_terms USING ("group", subset, test) WHERE k = 60 GROUP BY "group", subset, test),
stratified AS (SELECT "group", subset, test, array_to_string(live, ' vs ') AS comparison, coalesce(statistic, 0) AS statistic, len(live) - 1 AS df, coalesce(converged, FALSE) AS converged FROM models LEFT JOIN pair_fit USING ("group", subset, test))"""


@query(f"""WITH RECURSIVE {STRATIFIED_SQL}
SELECT "group", subset, test, comparison, {s6('statistic')}, CAST(df AS BIGINT) AS df, converged, {s6(chi2_tail_sql('statistic', 'df'), 'p')} FROM stratified""")
def cox_stratified(spark: SparkSession, folder: str) -> DataFrame:
    out = survival.cox_stratified(_events(spark, folder))
    return out.select("group", "subset", "test", "comparison", r6("statistic"), "df", "converged", r6("p"))
