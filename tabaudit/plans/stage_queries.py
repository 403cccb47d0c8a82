"""Queries on stored stage tables: flags met without a shuffle, metric families, whole print tables, marked trajectories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.operators import events, labels, novelty, onset, overlap, pooling, review, rules, trajectories
from tabaudit.plans import chain_queries as cq
from tabaudit.plans import record_queries as rq
from tabaudit.plans import report_queries as report
from tabaudit.plans import statistic_queries as tq
from tabaudit.plans import tables
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, T_CTE, long_of, r6, s6
from tabaudit.sources import sinks
from tabaudit.sources.stage_tables import Contract, StageStore

registry = Registry()
query = registry.query
KEYS, KEY_SQL = v.FILE, rq.KEY_SQL

# ---------------------------------------------------------------- stage tables
RECORD = ("folder", "generation", "ID")
#: Buckets at least, and rows of the lines' table for one more.
BUCKETS, BUCKET_LINES = 16, 1 << 20
_FLAGS = {"folder": "string", "generation": "bigint", "ID": "bigint", "generator": "string", "variant": "string", "metric": "string"}
_CHAIN = {"generator": "string", "dseed": "bigint", "mseed": "bigint"}


def contracts(buckets: int) -> list[Contract]:
    """The stage tables of these queries."""
    return [
        Contract("flags", _FLAGS, keys=(*RECORD, "metric"), partition_by=("metric",), bucket_by=RECORD, buckets=buckets),
        Contract("flags_sorted", _FLAGS, cluster_by=("generation", "folder", "metric", "ID")),
        Contract("rule_detail", {k: t for k, t in _FLAGS.items() if k != "metric"} | {"category": "string", "rule": "string"}, keys=(*RECORD, "rule"), bucket_by=RECORD, buckets=buckets),
        Contract("reviewer_flags", {k: t for k, t in _FLAGS.items() if k != "metric"}, keys=RECORD, bucket_by=RECORD, buckets=buckets),
        Contract("file_sizes", {"folder": "string", "generation": "bigint", **_CHAIN, "variant": "string", "n_rows": "bigint"}, keys=("folder", "generation")),
        Contract("metrics", {**_CHAIN, "generation": "bigint", "metric": "string", "value": "double"}, keys=(*_CHAIN, "generation", "metric"), partition_by=("metric",)),
    ]


_STORES: dict[tuple[str, str], StageStore] = {}
_NUMBERED: dict[tuple[str, str], DataFrame] = {}
_FOLDER = "concat_ws('_', generator, CAST(dseed AS STRING), CAST(mseed AS STRING))"
_FOLDER_SQL = _FOLDER.replace("STRING", "VARCHAR")
_BINS = m.HEADLINE_BINS
_NOVEL = f"HR_b{_BINS}"


def _folded(spark: SparkSession, folder: str, role: str, ids: bool = False) -> DataFrame:
    return v.records(spark, folder, role, ids, inputs=v.FOLDED).withColumn("folder", F.expr(_FOLDER))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic records with their IDs, numbered and written once per session: several tables are made of them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _NUMBERED:
        _NUMBERED[key] = sinks.stored(_folded(spark, folder, "synthetic", ids=True), "numbered")
    return _NUMBERED[key]


def _store(spark: SparkSession, folder: str, *names: str) -> StageStore:
    """The store of these tables with ``names`` finished; each is written once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        # a bucket is one task, so their number grows with the table
        buckets = max(BUCKETS, v.table(spark, folder, "lineitem").count() // BUCKET_LINES)
        _STORES[key] = StageStore(spark, f"{sinks.checkpoint_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}").declare(*contracts(buckets))
    store = _STORES[key]
    for name in names:
        if not sinks.exists(spark, f"{store.root}/{name}/manifest.json"):
            store.write(name, _BUILD[name](spark, folder, store))
    return store


def _flag_rows(spark: SparkSession, folder: str, store: StageStore) -> DataFrame:
    """Rule flags, and novelty over all features at the headline resolution."""
    keep = [*RECORD, "generator", "variant"]
    records = _numbered(spark, folder)
    pop = novelty.Population.learn(_folded(spark, folder, "population"), m.NUMERIC_FEATURES, report.NOVEL_CATEGORICAL)
    return rules.flag_rows(rules.apply_rules(records), keep).unionByName(novelty.novel_rows(records, pop, keep, [_BINS])).select(*_FLAGS)


def _detail_rows(spark: SparkSession, folder: str, store: StageStore) -> DataFrame:
    return rules.rule_rows(rules.apply_rules(_numbered(spark, folder)), [*RECORD, "generator", "variant"])


#: What the reviewer has flagged: some records of the generations that go to review.
_REVIEWED = "generation IN (0, 5) AND ID % 7 = 3"


def _reviewer_rows(spark: SparkSession, folder: str, store: StageStore) -> DataFrame:
    return _numbered(spark, folder).filter(_REVIEWED)


def _size_rows(spark: SparkSession, folder: str, store: StageStore) -> DataFrame:
    return _folded(spark, folder, "synthetic").groupBy("folder", "generation", *_CHAIN, "variant").agg(F.count(F.lit(1)).alias("n_rows"))


#: Every metric of the printed table, as whole numbers of the events, so that both engines sum alike.
_METRIC_VALUES = [f"(CAST(floor(value * 100) AS BIGINT) * {k} + user_id) % 1000" for k in range(1, len(m.TABLE_METRICS) + 1)]


def _metric_rows(spark: SparkSession, folder: str, store: StageStore) -> DataFrame:
    events_of = v.table(spark, folder, "events").selectExpr(
        "CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END AS generator",
        "CAST(floor(user_id / 4D) AS BIGINT) % 3 AS dseed", "CAST(floor(user_id / 4D) AS BIGINT) % 5 AS mseed",
        "CAST(floor((day(ts) - 1) * 20 / 30D) AS BIGINT) AS generation", "user_id", "value",
    )
    sums = [F.sum(F.expr(e)).alias(f"s{k}") for k, e in enumerate(_METRIC_VALUES)]
    wide = events_of.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *sums)
    long = F.array(*[F.struct(F.lit(name).alias("metric"), (F.col(f"s{k}") / (F.col("n") * 997.0)).alias("value")) for k, name in enumerate(m.TABLE_METRICS)])
    return wide.select(*KEYS, F.inline(long))


_BUILD = {
    "flags": _flag_rows, "rule_detail": _detail_rows, "reviewer_flags": _reviewer_rows, "file_sizes": _size_rows, "metrics": _metric_rows,
    "flags_sorted": lambda spark, folder, store: _store(spark, folder, "flags").read("flags"),
}


STORED_SQL = f"""{report.OVERLAP_SQL.replace('marked AS (SELECT f.*, hit', f'marked AS (SELECT f.*, {_FOLDER_SQL} AS folder, hit')},
stored AS (SELECT folder, generation, ID, generator, variant, novel, unnest(list_filter([CASE WHEN impossible THEN 'Expert_impossible' END, CASE WHEN suspicious THEN 'Expert_suspicious' END,
  CASE WHEN any_rule THEN 'Expert_any' END, CASE WHEN novel THEN '{_NOVEL}' END], lambda x: x IS NOT NULL)) AS metric FROM marked)"""


@query(f"WITH {STORED_SQL} SELECT folder, generation, ID, generator, variant, metric FROM stored")
def stored_flags(spark: SparkSession, folder: str) -> DataFrame:
    """All flags as the store has them."""
    return _store(spark, folder, "flags").read("flags").select(*_FLAGS)


@query(f"WITH {STORED_SQL} SELECT folder, generation, ID, generator, variant, metric FROM stored WHERE generation = 3 AND folder = 'ARF_1_2'")
def stored_flags_of_chain(spark: SparkSession, folder: str) -> DataFrame:
    """One file's flags from the clustered table, of which only files that can hold them are opened."""
    return _store(spark, folder, "flags_sorted").read_where("flags_sorted", generation=3, folder="ARF_1_2").select(*_FLAGS)


_OVER_SQL = """SELECT {keys}, {ratio}, {miss}, count(*) AS n_cells, CAST(sum(d) AS BIGINT) AS pooled_denom_ids, CAST(sum(d) - sum(o) AS BIGINT) AS pooled_missed_ids
  FROM (SELECT {keys}, folder, generation, count(*) AS d, count_if(novel) AS o FROM {source} GROUP BY ALL) c GROUP BY {keys}"""


def _over_sql(source: str, keys: str) -> str:
    return _OVER_SQL.format(keys=keys, source=source, ratio=s6("sum(o) / sum(d)", "pooled_ratio"), miss=s6("1 - sum(o) / sum(d)", "pooled_miss_rate"))


@query(f"WITH {STORED_SQL}, wanted AS (SELECT * FROM stored WHERE metric IN ('Expert_any', 'Expert_impossible')) {_over_sql('wanted', 'variant, metric')}")
def overlap_headline_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Headline overlap on all features, from stored flags that meet bucket by bucket."""
    store = _store(spark, folder, "flags")
    cells = overlap.stored_overlap(store.family("flags", ["Expert_any", "Expert_impossible"]), store.family("flags", [_NOVEL]), ["folder", "generation"], ["variant", "metric"])
    return report._pooled_out(overlap.pooled_overlap(cells, ["variant", "metric"]), ["variant", "metric"])


_DETAIL_SQL = """details AS (SELECT folder, generation, ID, generator, variant, novel, 'impossible' AS category, unnest(imp) AS rule FROM marked
  UNION ALL SELECT folder, generation, ID, generator, variant, novel, 'suspicious', unnest(sus) FROM marked)"""


@query(f"WITH {STORED_SQL}, {_DETAIL_SQL} {_over_sql('details', 'generator, category, rule')}")
def overlap_by_rule_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of every rule per generator, on all features, from two stored tables."""
    store, over = _store(spark, folder, "flags", "rule_detail"), ["generator", "category", "rule"]
    cells = overlap.stored_overlap(store.read("rule_detail"), store.family("flags", [_NOVEL]), ["folder", "generation"], over)
    return report._pooled_out(overlap.pooled_overlap(cells, over), over)


@query(f"""WITH {STORED_SQL}, {_DETAIL_SQL},
a AS (SELECT variant, count(*) AS any_total FROM stored WHERE metric = 'Expert_any' AND NOT (variant = 'core' AND ID % 19 = 5) GROUP BY variant),
u AS (SELECT variant, count(DISTINCT (folder, generation, ID)) AS union_total FROM details GROUP BY variant)
SELECT variant, any_total, union_total, any_total = union_total AS consistent FROM a FULL JOIN u USING (variant)""")
def rule_any_crosscheck_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The check on flags of which some were lost: it must say so."""
    store = _store(spark, folder, "flags", "rule_detail")
    kept = store.family("flags", ["Expert_any"]).filter("NOT (variant = 'core' AND ID % 19 = 5)")
    return overlap.any_crosscheck(kept, store.read("rule_detail"), ["variant"], list(RECORD))


@query(f"""WITH {STORED_SQL}
SELECT {KEY_SQL}, ID, icd9, heartrate FROM marked WHERE NOT any_rule AND generation IN (0, 5) AND ({cq._OUTSIDE})""")
def review_candidates_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Records worth a review that no stored rule flag excludes."""
    flagged = _store(spark, folder, "flags").family("flags", ["Expert_any"])
    records = _numbered(spark, folder).filter("generation IN (0, 5)")
    return review.worth_review(review.without_flagged(records, flagged, list(RECORD))).select(*KEYS, "ID", "icd9", "heartrate")


# --------------------------------------------------------------- trajectories
@query(f"""WITH {STORED_SQL},
s AS (SELECT folder, generation, count(*) AS n_rows, count_if(novel) AS hr, count_if(any_rule) AS any_n, count_if(any_rule OR ({_REVIEWED})) AS both_n, count_if({_REVIEWED}) AS seen FROM marked GROUP BY ALL)
SELECT folder, generation, 'hr_b5' AS metric, n_rows, hr AS n_flagged, {s6('hr / n_rows', 'value')} FROM s
UNION ALL SELECT folder, generation, 'expert_any', n_rows, any_n, {s6('any_n / n_rows', 'value')} FROM s
UNION ALL SELECT folder, generation, 'expert_llm', n_rows, both_n, {s6('both_n / n_rows', 'value')} FROM s WHERE seen > 0""")
def chain_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """Per-chain rates of novelty, of any rule, and of rules and reviewer together.

    Files without a flag count as 0; the combined rate stands only where the
    reviewer has seen a file.
    """
    store = _store(spark, folder, "flags", "reviewer_flags", "file_sizes")
    keys, sizes = ["folder", "generation"], store.read("file_sizes")
    out = None
    for metric, name in ((_NOVEL, "hr_b5"), ("Expert_any", "expert_any")):
        rates = trajectories.chain_rates(store.family("flags", [metric]), sizes.select(*keys, "n_rows"), keys)
        part = rates.select(*keys, F.lit(name).alias("metric"), "n_rows", "n_flagged", r6("value"))
        out = part if out is None else out.unionByName(part)
    combined = trajectories.combined_rates(store.family("flags", ["Expert_any"]), store.read("reviewer_flags"), sizes.select(*keys, "n_rows"), keys)
    rows = combined.join(sizes.select(*keys, "n_rows"), keys)
    return out.unionByName(rows.select(*keys, F.lit("expert_llm").alias("metric"), "n_rows", "n_flagged", r6("value")))


_LOW = 0.3
MARKS_SQL = f"""{v.TRAJECTORY_SQL},
marks AS (SELECT {KEY_SQL}, flag_rate, auroc_like, positive_share, least(positive_share, 1 - positive_share) = 0 AS class_collapse, coalesce(auroc_like <= {_LOW}, FALSE) AS low_auroc FROM trajectory)"""


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    wide = v.trajectory(spark, folder)
    share = F.least(F.col("positive_share"), 1.0 - F.col("positive_share"))
    balance = wide.select(*KEYS, F.when(share == 0, 1).otherwise(2).alias("n_classes"), share.alias("minority_fraction"))
    return trajectories.with_marks(labels.attach_collapse(wide, balance, KEYS), "auroc_like", _LOW)


@query(f"WITH {MARKS_SQL} SELECT generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, {s6('flag_rate')}, {s6('auroc_like')}, class_collapse, low_auroc FROM marks")
def chain_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories with their collapse and low-utility marks."""
    return _marks(spark, folder).select(*v.CHAIN, long_of("generation"), r6("flag_rate"), r6("auroc_like"), "class_collapse", "low_auroc")


@query(f"""WITH {MARKS_SQL}
SELECT generator, dseed, mseed, kind, CAST(generation AS BIGINT) AS generation, {s6('auroc_like')} FROM (
  SELECT 'class_collapse' AS kind, * FROM marks WHERE class_collapse UNION ALL SELECT 'low_auroc', * FROM marks WHERE low_auroc) x
QUALIFY row_number() OVER (PARTITION BY kind, generator, dseed, mseed ORDER BY generation) = 1""")
def chain_first_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Where each chain is first marked."""
    rows = _marks(spark, folder)
    parts = [trajectories.first_flagged(rows, v.CHAIN, F.col(k)).select(*v.CHAIN, F.lit(k).alias("kind"), long_of("generation"), r6("auroc_like")) for k in ("class_collapse", "low_auroc")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {v.TRAJECTORY_SQL} SELECT generator, CAST(generation AS BIGINT) AS generation, {s6('avg(flag_rate)', 'mean_value')}, count(flag_rate) AS n FROM trajectory GROUP BY ALL")
def chain_mean_curve(spark: SparkSession, folder: str) -> DataFrame:
    out = trajectories.chain_mean(v.trajectory(spark, folder), ["generator", "generation"], "flag_rate")
    return out.select("generator", long_of("generation"), r6("mean_value"), "n")


@query(f"""WITH {MARKS_SQL}, shares AS (SELECT generator, generation, avg(CAST(class_collapse AS INT)) AS mean FROM marks GROUP BY ALL)
SELECT generator, CAST(min(generation) AS BIGINT) AS first_generation FROM shares WHERE mean > 0 GROUP BY generator""")
def first_collapse_of_mean(spark: SparkSession, folder: str) -> DataFrame:
    """First generation in which any chain of a generator has collapsed."""
    shares = _marks(spark, folder).withColumn("value", F.col("class_collapse").cast("double"))
    pooled = pooling.pooled(shares, ["generator", "generation"], "value")
    return onset.first_positive_mean(pooled, ["generator"]).select("generator", long_of("first_generation"))


@query(f"""WITH {tq.EVENTS_SQL},
low AS (SELECT {tq.CHAIN_SQL}, max(generation) FILTER (auroc_like > 0.3) AS last_g FROM trajectory GROUP BY ALL),
share AS (SELECT {tq.CHAIN_SQL}, min(generation) FILTER (value = 0) AS collapse_g FROM minority GROUP BY ALL),
r AS (SELECT last_g - collapse_g AS diff, collapse_g FROM low FULL JOIN share USING ({tq.CHAIN_SQL}))
SELECT count_if(collapse_g IS NULL) AS n_never_collapsed, count(diff) AS n_with_both, count_if(diff <= 0) AS n_at_or_before_collapse, count_if(diff > 0) AS n_after_collapse FROM r""")
def coverage_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Is missing utility explained by collapse?  The counts of the report."""
    wide = v.trajectory(spark, folder)
    known = v.metric_rows(wide, "auroc_like").withColumn("value", F.when(F.col("value") > 0.3, F.col("value")))
    return events.coverage_verdict(events.coverage_reconciliation(known, v.minority(wide)))


@query(f"""WITH {tq.EVENTS_SQL},
e AS (SELECT * FROM events_of WHERE NOT (generator = 'ARF' AND mseed = 1)), o AS (SELECT * FROM onsets WHERE metric = 'flag_rate' AND NOT (generator = 'DDPM' AND mseed > 2))
SELECT {tq.CHAIN_SQL}, e.time AS failure_time, e.event AS failure_event, CAST(o.onset_generation AS BIGINT) AS onset_generation,
  CASE WHEN e.time IS NULL THEN 'onsets' WHEN o.metric IS NULL THEN 'events' ELSE 'both' END AS found_in FROM e FULL JOIN o USING ({tq.CHAIN_SQL})""")
def dissociation_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Failure events and onsets where either table lacks chains of the other."""
    failures = tq._events(spark, folder).filter("NOT (generator = 'ARF' AND mseed = 1)")
    onsets = tq._onsets(spark, folder).filter("metric = 'flag_rate' AND NOT (generator = 'DDPM' AND mseed > 2)")
    return events.join_onset(failures, onsets).select(*v.CHAIN, long_of("failure_time"), long_of("failure_event"), long_of("onset_generation"), "found_in")


@query(f"""WITH {tq.EVENTS_SQL} SELECT DISTINCT {tq.CHAIN_SQL} FROM trajectory WHERE NOT (generator = 'DDPM' AND mseed > 2) AND generator = 'ARF' AND mseed = 1""")
def summary_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Chains that one summary has and the other lacks, for the merge report."""
    wide = v.trajectory(spark, folder)
    return pooling.keys_only_in(wide.filter("NOT (generator = 'DDPM' AND mseed > 2)"), wide.filter("NOT (generator = 'ARF' AND mseed = 1)"), v.CHAIN)


# ---------------------------------------------------------------- print tables
_ALL_METRICS_SQL = f"""
chained AS (SELECT CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END AS generator, CAST(floor(user_id / 4.0::DOUBLE) AS BIGINT) % 3 AS dseed,
   CAST(floor(user_id / 4.0::DOUBLE) AS BIGINT) % 5 AS mseed, CAST(floor((extract(DAY FROM ts) - 1) * 20 / 30.0::DOUBLE) AS BIGINT) AS generation, user_id, value FROM events),
wide_of AS (SELECT {KEY_SQL}, count(*) AS n, {', '.join(f'sum({e}) AS s{k}' for k, e in enumerate(_METRIC_VALUES))} FROM chained GROUP BY ALL),
long_of AS ({' UNION ALL '.join(f"SELECT {KEY_SQL}, '{name}' AS metric, s{k}::DOUBLE / (n * 997.0::DOUBLE) AS value FROM wide_of" for k, name in enumerate(m.TABLE_METRICS))}),
g AS (SELECT metric, generator, generation, count(*) AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM long_of GROUP BY ALL)"""
_TABLE_GENERATIONS = [*range(11), 15, 19]


@query(f"""WITH {T_CTE}, {_ALL_METRICS_SQL},
pooled AS (SELECT g.*, 2 * coalesce(tcrit, 0) * sqrt(var) / sqrt(n) AS width FROM g LEFT JOIN tq ON tq.df = n - 1)
SELECT metric, generator, {', '.join(f"coalesce(max(printf('%.4f ± %.4f', mean, width)) FILTER (generation = {g}), '') AS gen_{g}" for g in _TABLE_GENERATIONS)} FROM pooled GROUP BY metric, generator""")
def metric_table_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics and generations of the printed table, from the partitions of the metrics table."""
    store = _store(spark, folder, "metrics")
    chosen, missing = pooling.resolve_panel(store.values("metrics"), [("metric", name) for name in m.TABLE_METRICS])
    if missing:
        raise ValueError(f"no partition for {missing}")
    pooled = pooling.pooled(store.family("metrics", chosen), ["metric", "generator", "generation"], "value")
    return tables.metric_table(pooled, _TABLE_GENERATIONS)


@query(f"""WITH {_ALL_METRICS_SQL.lstrip()}
SELECT metric, generator, generation, n, {s6('mean')} FROM g WHERE metric IN ('MemorizedFR', 'alpha_authenticity_OC', 'alpha_delta_coverage_OC', 'alpha_delta_precision_OC', 'detection_gmm', 'detection_linear', 'detection_mlp', 'detection_xgb')""")
def metric_panels(spark: SparkSession, folder: str) -> DataFrame:
    """The curves of a panel set: two families by prefix without an ignored metric, one by name, one that isn't there."""
    store = _store(spark, folder, "metrics")
    chosen, missing = pooling.resolve_panel(store.values("metrics"), [("prefix", "alpha"), ("prefix", "detection"), ("metric", "MemorizedFR"), ("metric", "absent")], {"detection_avg"})
    assert missing == ["absent"]
    pooled = pooling.pooled(store.family("metrics", chosen), ["metric", "generator", "generation"], "value")
    return pooled.select("metric", "generator", "generation", "n", r6("mean"))


# Novelty rates of the narrow profile, rule rates of all records, and reviewer rates of two generations.
_LLM_SQL = f"""
llm AS (SELECT generator, dseed, mseed, generation, avg(CAST(ID % 11 = 3 AS INT)) AS only_rate, avg(CAST(any_rule OR ID % 11 = 3 AS INT)) AS both_rate FROM flagged WHERE generation IN (0, 5) GROUP BY ALL),
llm_pooled AS (SELECT generator, generation, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, count(*) AS n FROM (
  SELECT generator, generation, 'LLM' AS metric, only_rate AS value FROM llm UNION ALL SELECT generator, generation, 'LLM_accumulated', both_rate FROM llm) x GROUP BY ALL),
llm_ci AS (SELECT p.*, coalesce(tcrit, 0) * sd / sqrt(n) AS half FROM llm_pooled p LEFT JOIN tq ON tq.df = n - 1),
exact AS (SELECT generator, generation, printf('%.1f%% (%.1f%%–%.1f%%)', 100 * median(both_rate), 100 * min(both_rate), 100 * max(both_rate)) AS cell FROM llm WHERE generator NOT LIKE '%CORE' GROUP BY ALL HAVING count(*) > 1),
reviewer_cells AS (
  SELECT generator, generation, 'LLM only %' AS metric, printf('%.1f%% ± %.1f%%', 100 * mean, 100 * half) AS cell FROM llm_ci WHERE metric = 'LLM'
  UNION ALL SELECT c.generator, c.generation, 'Expert rules + LLM %', coalesce(e.cell, printf('%.1f%% ± %.1f%% [mean±CI - no raw chain values found] (n=%d)', 100 * mean, 100 * half, n))
    FROM llm_ci c LEFT JOIN exact e ON e.generator = c.generator AND e.generation = c.generation WHERE metric = 'LLM_accumulated')"""


def _pooled_review(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    masked = rules.flags(rq.masked_records(spark, folder, ids=True, generations=[0, 5]))
    rates = masked.groupBy(*KEYS).agg(
        F.avg(F.expr("CAST(ID % 11 = 3 AS INT)")).alias("LLM"), F.avg(F.expr("CAST(any_rule OR ID % 11 = 3 AS INT)")).alias("LLM_accumulated")
    )
    rates = sinks.reliable(rates)
    pooled = pooling.pooled_metrics(rates, ["generator", "generation"], ["LLM", "LLM_accumulated"])
    return pooled, rates.filter("generator NOT LIKE '%CORE'").select("generator", "generation", F.col("LLM_accumulated").alias("value"))


@query(f"""WITH {report.FLAG_TABLE_SQL}, {_LLM_SQL}, {rq.NOVEL_SQL},
factor AS (SELECT bin, ln(n) / (3 * ln(bin) + ln(c1) + ln(c2)) AS f FROM bins, (SELECT count(*) AS n, count(DISTINCT {rq._norm_sql('c1')}) AS c1, count(DISTINCT {rq._norm_sql('c2')}) AS c2 FROM profile WHERE role = 'population') x),
hr AS (SELECT generator, generation, 'HR' AS metric, bin, novelty_rate AS value FROM rates
       UNION ALL SELECT generator, generation, 'HR*', bin, CASE WHEN f > 1 THEN novelty_rate ELSE novelty_rate * f END FROM rates JOIN factor USING (bin)),
hr_pooled AS (SELECT generator, generation, metric || ' (bin=' || bin || ')' AS metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, count(*) AS n FROM hr GROUP BY ALL),
hr_cells AS (SELECT generator, generation, metric, printf('%.1f%% ± %.1f%%', 100 * mean, 100 * coalesce(tcrit, 0) * sd / sqrt(n)) AS cell FROM hr_pooled LEFT JOIN tq ON tq.df = n - 1),
every_cell AS (SELECT generator, generation, metric, cell FROM cells_of UNION ALL SELECT * FROM hr_cells UNION ALL SELECT * FROM reviewer_cells)
SELECT metric, generator, {', '.join(f"coalesce(max(cell) FILTER (generation = {g}), '') AS gen_{g}" for g in range(7))} FROM every_cell GROUP BY metric, generator""")
def flag_rate_table_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the flag-rate table: HR and HR* at six resolutions, rules, reviewer, and both."""
    pop = novelty.Population.learn(v.profile(spark, folder, "population"), v.PROFILE_NUMERIC, v.PROFILE_CATEGORICAL).with_cardinality()
    rates = novelty.adjust_novelty(novelty.novelty_by_file(v.profile(spark, folder, "synthetic"), pop, KEYS), pop)
    long = rates.withColumnsRenamed({"novelty_rate": "HR", "novelty_adjusted": "HR_adjusted"}).unpivot(["generator", "generation", "bin"], ["HR", "HR_adjusted"], "metric", "value")
    rule_long = rq.rule_rates_long(rules.rule_rates(rq.masked_records(spark, folder), KEYS))
    reviewer, per_chain = _pooled_review(spark, folder)
    return tables.flag_rate_table(
        pooling.pooled(long, ["generator", "generation", "bin", "metric"], "value"), pooling.pooled(rule_long, ["generator", "generation", "metric"], "value"),
        reviewer, per_chain, list(range(7)),
    )
