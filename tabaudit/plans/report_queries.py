"""Queries on overlap, composition, distributions and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.operators import distributions as di
from tabaudit.operators import events, novelty, overlap, paired, pooling, ranking, rules, survival
from tabaudit.plans import record_queries as rq
from tabaudit.plans import tables
from tabaudit.plans import statistic_queries as tq
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, T_CTE, chi2_tail_sql, long_of, r6, s6
from tabaudit.sources.sinks import reliable, stored

registry = Registry()
query = registry.query
KEYS = v.FILE
KEY_SQL = rq.KEY_SQL

# ------------------------------------------------------------------ overlap
# The headline resolution over all features, of records whose inputs are folded: as they are,
# nearly every record of the test tables is new, and flags would not overlap in part.
_BINS = m.HEADLINE_BINS
_NOVEL = f"novel_b{_BINS}"
NOVEL_CATEGORICAL = [*m.CATEGORICAL_FEATURES, *[c for c in m.BOOLEAN_FEATURES if c not in m.CATEGORICAL_FEATURES]]


def _label_sql(c: str) -> str:
    return f"CASE WHEN {c} THEN '1' WHEN NOT {c} THEN '0' ELSE 'Missing' END" if c in m.BOOLEAN_FEATURES else rq._norm_sql(c)


_CELL = ", ".join([f"{rq._bin_sql(c)} AS b_{c}" for c in m.NUMERIC_FEATURES] + [f"{_label_sql(c)} AS b_{c}" for c in NOVEL_CATEGORICAL])
_CELL_NAMES = ", ".join(f"b_{c}" for c in [*m.NUMERIC_FEATURES, *NOVEL_CATEGORICAL])
OVERLAP_SQL = f"""{rq.RULED_SQL.replace(v.RECORDS_SQL, v.FOLDED_SQL)},
bounds AS (SELECT {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in m.NUMERIC_FEATURES)} FROM records WHERE role = 'population'),
known AS (SELECT DISTINCT {_CELL_NAMES}, TRUE AS hit FROM (SELECT {_CELL} FROM (SELECT *, {_BINS} AS bin FROM records WHERE role = 'population') r, bounds) x),
marked AS (SELECT f.*, hit IS NULL AS novel FROM (SELECT f.*, {_CELL} FROM (SELECT *, {_BINS} AS bin FROM flagged) f, bounds) f LEFT JOIN known USING ({_CELL_NAMES}))"""


def _novel_clinical(spark: SparkSession, folder: str, records: DataFrame, keep: list[str], broadcast: bool | None = None) -> DataFrame:
    pop = novelty.Population.learn(v.records(spark, folder, "population", inputs=v.FOLDED), m.NUMERIC_FEATURES, NOVEL_CATEGORICAL)
    return novelty.flagged_novelty(records, pop, _BINS, keep, broadcast)


def _marked(spark: SparkSession, folder: str, broadcast: bool | None = None) -> DataFrame:
    masked = rules.flags(rq.masked_records(spark, folder, inputs=v.FOLDED))
    keep = [*KEYS, "variant", "impossible", "suspicious", "any_rule", "impossible_mask", "suspicious_mask"]
    return _novel_clinical(spark, folder, masked, keep, broadcast)


def _pooled_out(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, r6("pooled_ratio"), r6("pooled_miss_rate"), "n_cells", "pooled_denom_ids", "pooled_missed_ids")


def _pooled_sql(source: str, keys: str, cell: str) -> str:
    return f"""SELECT {keys}, {s6('sum(o) / sum(d)', 'pooled_ratio')}, {s6('1 - sum(o) / sum(d)', 'pooled_miss_rate')}, count(*) AS n_cells,
  CAST(sum(d) AS BIGINT) AS pooled_denom_ids, CAST(sum(d) - sum(o) AS BIGINT) AS pooled_missed_ids
  FROM (SELECT {keys}, {cell}, count(*) AS d, count_if(novel) AS o FROM {source} GROUP BY ALL) c GROUP BY {keys}"""


_HEADLINE_SQL = f"""WITH {OVERLAP_SQL},
headline AS (SELECT variant AS scope, 'clinical (any)' AS metric_label, 'Expert_any' AS expert_metric, {KEY_SQL}, novel FROM marked WHERE any_rule
             UNION ALL SELECT variant, 'impossible', 'Expert_impossible', {KEY_SQL}, novel FROM marked WHERE impossible)
{_pooled_sql('headline', 'scope, metric_label, expert_metric', KEY_SQL)}"""


def _headline(spark: SparkSession, folder: str, broadcast: bool | None) -> DataFrame:
    labelled = _marked(spark, folder, broadcast).filter("any_rule").selectExpr(
        *KEYS, "variant AS scope", _NOVEL,
        """inline(array_compact(array(named_struct('metric_label', 'clinical (any)', 'expert_metric', 'Expert_any'),
           CASE WHEN impossible THEN named_struct('metric_label', 'impossible', 'expert_metric', 'Expert_impossible') END)))""",
    )
    keys = ["scope", "metric_label", "expert_metric"]
    cells = overlap.overlap_in_place(labelled, KEYS, keys, _NOVEL)
    return _pooled_out(overlap.pooled_overlap(cells, keys), keys)


@query(_HEADLINE_SQL)
def overlap_headline(spark: SparkSession, folder: str) -> DataFrame:
    return _headline(spark, folder, None)


@query(_HEADLINE_SQL)
def overlap_headline_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The form for populations too large to broadcast."""
    return _headline(spark, folder, False)


_RULE_ROWS_SQL = f"""rule_rows AS (SELECT {KEY_SQL}, variant AS scope, novel, 'impossible' AS category, unnest(imp) AS rule FROM marked
  UNION ALL SELECT {KEY_SQL}, variant, novel, 'suspicious', unnest(sus) FROM marked)"""


@query(f"WITH {OVERLAP_SQL}, {_RULE_ROWS_SQL} {_pooled_sql('rule_rows', 'scope, category, rule', KEY_SQL)}")
def overlap_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = rules.rule_rows(_marked(spark, folder), [*KEYS, "variant AS scope", _NOVEL])
    keys = ["scope", "category", "rule"]
    cells = overlap.overlap_in_place(rows, KEYS, keys, _NOVEL)
    return _pooled_out(overlap.pooled_overlap(cells, keys), keys)


@query(f"WITH {OVERLAP_SQL}, {_RULE_ROWS_SQL} {_pooled_sql('rule_rows', 'generator, category, rule', 'dseed, mseed, generation')}")
def overlap_by_generator_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The same numbers from stored flag tables, met by a join on the record."""
    # numbered once, for both sides of the join
    records = stored(v.records(spark, folder, "synthetic", ids=True, inputs=v.FOLDED), "numbered")
    detail = rules.rule_rows(rules.apply_rules(records), [*KEYS, "ID"])
    novel = _novel_clinical(spark, folder, records, [*KEYS, "ID"]).filter(_NOVEL)
    keys = ["generator", "category", "rule"]
    cells = overlap.overlap_cells(detail, novel, KEYS, ["category", "rule"])
    return _pooled_out(overlap.pooled_overlap(cells, keys), keys)


@query(f"""WITH {rq.RULED_SQL}
SELECT variant, count_if(any_rule) AS any_total, count_if(len(imp) + len(sus) > 0) AS union_total, count_if(any_rule) = count_if(len(imp) + len(sus) > 0) AS consistent FROM flagged GROUP BY variant""")
def rule_any_crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    masked = rq.masked_records(spark, folder, ids=True)
    keep = [*KEYS, "ID", "variant"]
    return overlap.any_crosscheck(rules.flag_rows(masked, keep), rules.rule_rows(masked, keep), ["variant"], [*KEYS, "ID"])


# -------------------------------------------------------------- composition
COMPOSITION_SQL = f"""{rq.RULED_SQL},
bars AS (SELECT generator, generation, rule, count(*) AS n FROM detail WHERE generation IN (0, 6) GROUP BY ALL),
shares AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY generator, generation) AS share, count(*) OVER (PARTITION BY generator, generation) AS n_rules_fired,
                  sum(n) OVER (PARTITION BY generator, generation) AS total FROM bars),
named AS (SELECT rule FROM (SELECT rule, max(share) AS peak FROM shares GROUP BY rule) p WHERE peak >= 5 ORDER BY peak DESC, rule LIMIT 12)"""


@query(f"""WITH {COMPOSITION_SQL}
SELECT generator, generation, CASE WHEN rule IN (SELECT rule FROM named) THEN rule ELSE 'Other' END AS segment, {s6('sum(share)', 'share')},
       CAST(max(total) AS BIGINT) AS total, max(n_rules_fired) AS n_rules_fired FROM shares GROUP BY ALL""")
def rule_composition(spark: SparkSession, folder: str) -> DataFrame:
    masked = rules.apply_rules(v.records(spark, folder, "synthetic").filter(F.col("generation").isin(0, 6)))
    fired = rules.rule_counts(masked, ["generator", "generation"]).withColumnRenamed("n", "value")
    bar = ["generator", "generation"]
    out = di.composition_segments(di.rule_composition(fired, bar), bar)
    return out.select(*bar, "segment", r6("share"), long_of("total"), "n_rules_fired")


# ------------------------------------------------------------- distributions
_NUM, _CAT = m.NUMERIC_FEATURES, m.CATEGORICAL_FEATURES
# Anchor generations; the test tables end with 6.
_GENS = [0, 3, 5, 6]
_VALUES_SQL = " UNION ALL ".join(f"SELECT generator, generation, role, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM records WHERE {c} IS NOT NULL" for c in _NUM)
DIST_SQL = f"""{v.RECORDS_SQL}, vals AS ({_VALUES_SQL}),
series AS (SELECT generator, feature, 'real' AS series, -1 AS generation, value FROM vals WHERE role = 'training'
           UNION ALL SELECT generator, feature, 'synthetic', generation, value FROM vals WHERE role = 'synthetic' AND generation IN (0, 3, 5, 6)),
pct AS (SELECT generator, feature, series, generation, count(*) AS n, quantile_cont(value, 0.005) AS p_lo, quantile_cont(value, 0.995) AS p_hi, median(value) AS med FROM series GROUP BY ALL),
pooled_pct AS (SELECT generator, feature, series, quantile_cont(value, 0.005) AS p_lo, quantile_cont(value, 0.995) AS p_hi FROM series GROUP BY ALL),
ranges AS (SELECT generator, feature, min(p_lo) AS lo, max(p_hi) AS hi FROM pooled_pct GROUP BY ALL)"""
_SERIES = ["series", "generation"]
_PANEL = ["generator", "feature"]


def _value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Value counts per generator, feature, series (real pooled over runs) and generation."""
    rows = v.records(spark, folder).filter(
        (F.col("role") == "training") | ((F.col("role") == "synthetic") & F.col("generation").isin(_GENS))
    )
    keyed = rows.selectExpr(
        "generator", "CASE role WHEN 'training' THEN 'real' ELSE 'synthetic' END AS series",
        "CASE role WHEN 'training' THEN -1L ELSE generation END AS generation", *_NUM,
    )
    # read several times by every query on it
    return reliable(di.value_counts(keyed, ["generator", *_SERIES], _NUM))


def _ranges(counts: DataFrame) -> DataFrame:
    """Clip ranges from the real and the pooled generated values."""
    pooled_counts = counts.groupBy(*_PANEL, "series", "value").agg(F.sum("n").alias("n"))
    return di.clip_range(pooled_counts, _PANEL, ["series"])


@query(f"WITH {DIST_SQL} SELECT generator, feature, series, CAST(generation AS BIGINT) AS generation, n, {s6('p_lo')}, {s6('p_hi')}, {s6('med', 'median')} FROM pct")
def feature_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    keys = [*_PANEL, *_SERIES]
    out = di.percentiles(_value_counts(spark, folder), keys, {"p_lo": 0.005, "p_hi": 0.995, "median": 0.5})
    return out.select(*keys, "n", r6("p_lo"), r6("p_hi"), r6("median"))


@query(f"WITH {DIST_SQL} SELECT generator, feature, {s6('lo')}, {s6('hi')} FROM ranges")
def clip_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return _ranges(_value_counts(spark, folder)).select(*_PANEL, r6("lo"), r6("hi"))


@query(f"""WITH {DIST_SQL},
totals AS (SELECT generator, feature, series, generation, count(*) AS total FROM series GROUP BY ALL)
SELECT generator, feature, series, CAST(generation AS BIGINT) AS generation, CAST(least(floor((value - lo) / (hi - lo) * 40.0::DOUBLE) + 1, 40) AS BIGINT) AS bin,
       count(*) AS n, {s6('count(*) / (max(total) * ((max(hi) - max(lo)) / 40.0::DOUBLE))', 'density')}
FROM series JOIN ranges USING (generator, feature) JOIN totals USING (generator, feature, series, generation)
WHERE value BETWEEN lo AND hi GROUP BY ALL""")
def density_histogram(spark: SparkSession, folder: str) -> DataFrame:
    counts = _value_counts(spark, folder)
    out = di.density_histogram(counts, _ranges(counts), _PANEL, _SERIES, 40)
    return out.select(*_PANEL, *_SERIES, long_of("bin"), "n", r6("density"))


@query(f"""WITH {DIST_SQL},
moments AS (SELECT generator, feature, series, generation, count(*) AS n, stddev_samp(value) * count(*) ** (-0.2) * 1.5 AS h FROM series GROUP BY ALL HAVING count(*) >= 5 AND max(value) > min(value)),
grid AS (SELECT m.*, lo + (hi - lo) * i / 399.0::DOUBLE AS x, i AS point FROM moments m JOIN ranges USING (generator, feature), range(400) r(i))
SELECT generator, feature, series, CAST(generation AS BIGINT) AS generation, point, {s6('max(x)', 'x')}, {s6('sum(exp(-0.5 * ((x - value) / h) ** 2)) / (max(n) * max(h) * sqrt(2 * pi()))', 'density')}
FROM grid JOIN series USING (generator, feature, series, generation) GROUP BY generator, feature, series, generation, point""")
def kde_grid(spark: SparkSession, folder: str) -> DataFrame:
    counts = _value_counts(spark, folder)
    out = di.kernel_density(counts, _ranges(counts), _PANEL, _SERIES)
    return out.select(*_PANEL, *_SERIES, long_of("point"), r6("x"), r6("density"))


# Two features with more levels than a table shows.
_LEVELLED = [*_CAT, "age", "sodium"]
_LEVELS_SQL = " UNION ALL ".join(f"SELECT generator, role, '{c}' AS feature, CAST({c} AS VARCHAR) AS level FROM records WHERE role <> 'population'" for c in _CAT)


@query(f"""WITH {v.RECORDS_SQL}, lv AS ({_LEVELS_SQL}),
shares AS (SELECT generator, feature, level, count_if(role = 'training') AS a, count_if(role = 'synthetic') AS b FROM lv WHERE level IS NOT NULL GROUP BY ALL)
SELECT generator, feature, level, {s6('a / sum(a) OVER (PARTITION BY generator, feature)', 'real_share')}, {s6('b / sum(b) OVER (PARTITION BY generator, feature)', 'synthetic_share')} FROM shares""")
def feature_proportions(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.records(spark, folder).filter("role <> 'population'")
    counts = di.level_counts(rows, ["generator", "role"], _CAT)
    out = di.proportions(counts, _PANEL, "role", "training")
    return out.select(*_PANEL, "level", r6("real_share"), r6("synthetic_share"))


@query(f"""WITH {v.RECORDS_SQL},
lv AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '<NA>') AS level FROM records WHERE role = 'population'" for c in _LEVELLED)}),
counted AS (SELECT feature, level, count(*) AS n FROM lv GROUP BY ALL)
SELECT feature, level, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS position, count(*) OVER (PARTITION BY feature) AS n_levels FROM counted
QUALIFY position <= 20""")
def category_topk(spark: SparkSession, folder: str) -> DataFrame:
    counts = di.level_counts(v.records(spark, folder, "population"), [], _LEVELLED, missing="<NA>")
    return di.top_levels(counts, ["feature"]).select("feature", "level", "n", long_of("position"), "n_levels")


_TYPED = m.FEATURES
_TYPES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, {'TRUE' if c in m.NUMERIC_FEATURES or c in m.BOOLEAN_FEATURES else f'TRY_CAST({c} AS DOUBLE) IS NOT NULL'} AS ok FROM records WHERE role = 'population' AND {c} IS NOT NULL"
    for c in _TYPED
)


@query(f"""WITH {v.RECORDS_SQL}, t AS ({_TYPES_SQL}),
stats AS (SELECT feature, count_if(ok) / count(*) AS share, count(DISTINCT level) AS n_distinct FROM t GROUP BY feature)
SELECT feature, {s6('share', 'numeric_share')}, n_distinct, CASE WHEN feature IN ('heartrate') THEN share >= 0.8 WHEN feature = 'icd9' THEN FALSE ELSE share >= 0.8 AND n_distinct > 15 END AS is_numeric FROM stats""")
def feature_types(spark: SparkSession, folder: str) -> DataFrame:
    out = di.feature_types(v.records(spark, folder, "population"), _TYPED, ["heartrate"], ["icd9"])
    return out.select("feature", r6("numeric_share"), "n_distinct", "is_numeric")


# ------------------------------------------------------------ pooled curves
POOLED_SQL = f"""{v.TIDY_SQL}, {T_CTE},
renamed AS (SELECT generator, generation, CASE metric WHEN 'flag_rate' THEN 'tstr_fpr' WHEN 'positive_share' THEN 'readmission_minority_share' ELSE 'utility_gap' END AS metric, value FROM tidy),
g AS (SELECT generator, generation, metric, count(value) AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM renamed GROUP BY ALL),
pooled AS (SELECT g.*, mean - coalesce(tcrit, 0) * sqrt(var) / sqrt(n) AS low, mean + coalesce(tcrit, 0) * sqrt(var) / sqrt(n) AS high FROM g LEFT JOIN tq ON tq.df = n - 1)"""
_RENAMED = {"flag_rate": "tstr_fpr", "positive_share": "readmission_minority_share", "auroc_like": "utility_gap"}


def _pooled(spark: SparkSession, folder: str) -> DataFrame:
    wide = v.trajectory(spark, folder).withColumnsRenamed(_RENAMED)
    return pooling.pooled_metrics(wide, ["generator", "generation"], list(_RENAMED.values()))


@query(f"""WITH {POOLED_SQL},
banded AS (SELECT *, CASE WHEN n < 5 THEN mean ELSE low END AS l, CASE WHEN n < 5 THEN mean ELSE high END AS h FROM pooled)
SELECT generator, metric, CAST(generation AS BIGINT) AS generation, n, {s6('mean')},
       {s6("CASE WHEN metric = 'utility_gap' THEN greatest(l, -1) WHEN metric LIKE 'tstr%' THEN greatest(l, 0) ELSE l END", 'low')},
       {s6("CASE WHEN metric = 'utility_gap' OR metric LIKE 'tstr%' THEN least(h, 1) ELSE h END", 'high')} FROM banded""")
def curve_data(spark: SparkSession, folder: str) -> DataFrame:
    out = pooling.curve_points(_pooled(spark, folder))
    return out.select("generator", "metric", long_of("generation"), "n", r6("mean"), r6("low"), r6("high"))


@query(f"WITH {POOLED_SQL}, per AS (SELECT metric, generator, avg(mean) AS m FROM pooled GROUP BY ALL) SELECT metric, {s6('avg(m)', 'reference')}, {s6('max(m) - min(m)', 'spread')}, count(*) AS n_generators, max(m) - min(m) > 1e-6 AS spread_warning FROM per GROUP BY metric")
def reference_line(spark: SparkSession, folder: str) -> DataFrame:
    out = pooling.reference_line(_pooled(spark, folder), ["metric"], "generator", "mean")
    return out.select("metric", r6("reference"), r6("spread"), "n_generators", "spread_warning")


_FORMAT_SQL = "printf('%.4f ± %.4f', mean, high - low)"


@query(f"""WITH {POOLED_SQL}
SELECT metric, generator, {', '.join(f"coalesce(max({_FORMAT_SQL}) FILTER (generation = {g}), '') AS gen_{g}" for g in (0, 5, 10, 19))} FROM pooled GROUP BY metric, generator""")
def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    return tables.metric_table(_pooled(spark, folder), [0, 5, 10, 19])


FLAG_TABLE_SQL = f"""{rq.RULED_SQL}, {T_CTE},
r AS (SELECT generator, generation, avg(any_rate) AS mean, coalesce(stddev_samp(any_rate), 0) AS sd, count(*) AS n, avg(impossible_rate) AS imp FROM file_rates GROUP BY ALL),
ci AS (SELECT r.*, mean + coalesce(tcrit, 0) * sd / sqrt(n) AS high FROM r LEFT JOIN tq ON tq.df = n - 1),
cells_of AS (SELECT generator, generation, 'Expert rules (all) %' AS metric, printf('%.1f%% ± %.1f%%', 100 * mean, 100 * (high - mean)) AS cell FROM ci
             UNION ALL SELECT generator, generation, '% impossible expert rules', CASE WHEN mean > 0 THEN printf('%.1f%%', 100 * imp / mean) ELSE 'NA' END FROM ci)"""


@query(f"""WITH {FLAG_TABLE_SQL}
SELECT metric, generator, {', '.join(f"coalesce(max(cell) FILTER (generation = {g}), '') AS gen_{g}" for g in range(7))} FROM cells_of GROUP BY metric, generator""")
def flag_rate_table(spark: SparkSession, folder: str) -> DataFrame:
    rates = rq.rule_rates_long(rules.rule_rates(rq.masked_records(spark, folder), KEYS))
    pooled = pooling.pooled(rates, ["generator", "generation", "metric"], "value")
    return tables.rule_rate_rows(pooled, list(range(7)))


# --------------------------------------------------------------- claim tables
def _text_sql(value: str, *instead: tuple[str, str]) -> str:
    cases = " ".join(f"WHEN {when} THEN '{text}'" for when, text in instead)
    return f"CASE {cases} ELSE printf('%.6f', {value}) END"


_FEW, _FLAT, _SAME = ("n_pairs < 2", tables.NO_PAIR), ("tau IS NULL", tables.NO_VARIANCE), ("w IS NULL", tables.ZERO_OFFSET)


@query(f"""WITH RECURSIVE {tq.TIMING_P_SQL}
SELECT metric, subset AS "Subset", n_pairs AS "N chains", {_text_sql('tau', _FEW, _FLAT)} AS "Kendall's tau", {_text_sql('tau_p', _FEW, _FLAT)} AS "Kendall's tau p-value",
  {_text_sql('w', _FEW, _SAME)} AS "Wilcoxon statistic", {_text_sql('wilcoxon_p', _FEW, _SAME)} AS "Wilcoxon p-value", {_text_sql('med', _FEW)} AS "Median offset (generations)" FROM tested""")
def table_of_timing(spark: SparkSession, folder: str) -> DataFrame:
    """Paired timing with reader-facing placeholders."""
    chains = paired.onset_failure_chains(tq._joined(spark, folder), {"metric": F.lit("flag_rate")})
    return tables.timing_table(paired.paired_timing(chains, ["metric"]), ["metric"])


@query(f"""WITH {tq.W_SQL}
SELECT CASE "group" WHEN 'base' THEN 'Full dataset' ELSE 'Full dataset, excluding RTVAE' END AS "Group", subset AS "Subset",
  coalesce(m, 0) AS n_seed_pairs, {s6('w', 'kendalls_w')} FROM labelled LEFT JOIN w_of USING ("group", subset)""")
def table_of_concordance(spark: SparkSession, folder: str) -> DataFrame:
    w = ranking.kendalls_w(ranking.rank_rows(tq._events(spark, folder)), p_values=False)
    return tables.group_labels(w).select("Group", F.col("subset").alias("Subset"), "n_seed_pairs", r6("w", "kendalls_w"))


_GROUP_SQL = "CASE \"group\" WHEN 'base' THEN 'Full dataset' ELSE 'Full dataset, excluding RTVAE' END AS \"Group\""


@query(f"""WITH {tq.W_SQL}, {T_CTE},
tested AS (SELECT "group", subset, coalesce(m, 0) AS pairs, n, w, m * (n - 1) * w AS chi2, {chi2_tail_sql('m * (n - 1) * w', 'n - 1')} AS p FROM labelled LEFT JOIN w_of USING ("group", subset))
SELECT {_GROUP_SQL}, subset AS "Subset", {_text_sql('w', ('w IS NULL', tables.NO_RANKING))} AS "Kendall's W", pairs AS "N seed-pairs", CAST(n AS BIGINT) AS "N generators",
  {_text_sql('chi2', ('w IS NULL', tables.NO_RANKING))} AS "Chi-square statistic", CAST(n - 1 AS BIGINT) AS "Degrees of freedom", {_text_sql('p', ('w IS NULL', tables.NO_RANKING))} AS "p-value" FROM tested""")
def table_of_concordance_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the concordance table, undefined values explained."""
    return tables.concordance_table(ranking.kendalls_w(ranking.rank_rows(tq._events(spark, folder))))


@query(f"""WITH RECURSIVE {tq.COX_SQL}
SELECT 'onset_active' AS "Covariate", {s6('exp(beta)', '"Hazard ratio"')}, {s6('exp(beta - 1.959963984540054 * se)', '"95% CI (lower)"')}, {s6('exp(beta + 1.959963984540054 * se)', '"95% CI (upper)"')},
  {s6(chi2_tail_sql('(beta / se) * (beta / se)', '1'), '"p-value"')}, n_chains_in_model || ' of ' || n_chains AS "Chains in model",
  CASE WHEN n_chains > n_chains_in_model THEN (n_chains - n_chains_in_model) || ' chain(s) excluded (failure observed at generation 0 leaves no risk interval to model)' ELSE 'none excluded' END AS "Exclusion note",
  'Data seed and generator' AS "Stratification" FROM cox_fit, cox_facts""")
def table_of_hazard(spark: SparkSession, folder: str) -> DataFrame:
    """The hazard ratio as it is printed."""
    joined = tq._joined(spark, folder)
    table = tables.cox_table(survival.cox_time_varying(joined, events.risk_intervals(joined)))
    return table.select("Covariate", *[r6(f"`{c}`", c) for c in ("Hazard ratio", "95% CI (lower)", "95% CI (upper)", "p-value")], "Chains in model", "Exclusion note", "Stratification")


def _sql_of(name: str) -> str:
    return tq.registry.entries[name].sql


@query(f"""SELECT {_GROUP_SQL}, subset AS "Subset", test, comparison, statistic, df, p, p_holm FROM (
  SELECT "group", subset, 'Omnibus log-rank' AS test, CASE "group" WHEN 'base' THEN 'ARF vs CTGAN vs DDPM vs RTVAE' ELSE 'ARF vs CTGAN vs DDPM' END AS comparison, statistic, df, p, CAST(NULL AS DOUBLE) AS p_holm FROM ({_sql_of('logrank')}) a
  UNION ALL SELECT "group", subset, 'Pairwise log-rank', comparison, statistic, df, p, p_holm FROM ({_sql_of('holm_pairwise')}) b
  UNION ALL SELECT "group", subset, test, comparison, statistic, df, p, NULL FROM ({_sql_of('cox_stratified')}) c) every""")
def table_of_survival(spark: SparkSession, folder: str) -> DataFrame:
    return tables.group_labels(survival.survival_comparison(tq._events(spark, folder))).select(
        "Group", F.col("subset").alias("Subset"), "test", "comparison", r6("statistic"), "df", r6("p"), r6("p_holm")
    )
