"""Print tables in their printed order, the tables of the second claim, and small steps on the way to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.keys import generation_label, generation_number
from tabaudit.operators import ids, onset, paired, pooling, review, rules, subsets, utility
from tabaudit.plans import chain_queries as cq
from tabaudit.plans import record_queries as rq
from tabaudit.plans import report_queries as report
from tabaudit.plans import statistic_queries as tq
from tabaudit.plans import tables
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, T_CTE, pooled_out, pooled_sql, r6, s6

registry = Registry()
query = registry.query
KEYS, KEY_SQL = v.FILE, rq.KEY_SQL


def _sql_of(source, name: str) -> str:
    return source.registry.entries[name].sql


# ------------------------------------------------------------------ print order
@query(f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pooled_ratio, expert_metric) AS position FROM ({_sql_of(report, 'overlap_headline')}) t")
def overlap_headline_printed(spark: SparkSession, folder: str) -> DataFrame:
    """Lowest overlap first within a scope."""
    found = report.overlap_headline(spark, folder)
    return tables.in_print_order(found, ["scope"], [F.col("pooled_ratio"), F.col("expert_metric")])


@query(f"SELECT *, row_number() OVER (PARTITION BY generator ORDER BY pooled_ratio, rule) AS position FROM ({_sql_of(report, 'overlap_by_generator_rule')}) t")
def overlap_by_rule_printed(spark: SparkSession, folder: str) -> DataFrame:
    found = report.overlap_by_generator_rule(spark, folder)
    return tables.in_print_order(found, ["generator"], [F.col("pooled_ratio"), F.col("rule")])


@query(f"SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY count DESC, rule) AS position FROM ({_sql_of(rq, 'rule_summary')}) t")
def rule_summary_printed(spark: SparkSession, folder: str) -> DataFrame:
    """Rules by count, most frequent first in their bucket."""
    return tables.in_print_order(rq.rule_summary(spark, folder), ["bucket"], [F.desc("count"), F.col("rule")])


# ------------------------------------------------------------------- claim two
_DIRECTIONS = ", ".join(f"('{n}', {t}, '{tables.DIRECTION_LABELS[d]}')" for n, (t, d) in v.ONSETS.items())


@query(f"""WITH {tq.INCLINE_SQL}, listed(metric, threshold, direction) AS (VALUES {_DIRECTIONS})
SELECT metric AS "Metric", CAST(threshold AS DOUBLE) AS "Threshold", direction AS "Direction of change at onset", count_if(crossed) AS "N chains crossed", count(o.generator) AS "N chains total"
FROM listed LEFT JOIN onsets o USING (metric) GROUP BY ALL""")
def table_of_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return tables.crossing_table(onset.crossing_counts(tq._onsets(spark, folder), ["metric"]), v.ONSETS)


_TEXT_SQL = ", ".join(
    f'{report._text_sql(value, *instead)} AS "{name}"'
    for value, name, instead in (
        ("tau", "Kendall's tau", (report._FEW, report._FLAT)), ("tau_p", "Kendall's tau p-value", (report._FEW, report._FLAT)),
        ("w", "Wilcoxon statistic", (report._FEW, report._SAME)), ("wilcoxon_p", "Wilcoxon p-value", (report._FEW, report._SAME)), ("med", "Median offset (generations)", (report._FEW,)),
    )
)


@query(f"""WITH RECURSIVE {tq.INCLINE_SQL}, {tq._METRIC_PAIRS.lstrip()}, {tq._subset_sql('universe', 'qa_metric')}, {tq.EXACT_SQL.lstrip()}, {tq._tested_sql('qa_metric')}
SELECT qa_metric AS "QA metric", subset AS "Subset", n_pairs AS "N with both onsets defined", {_TEXT_SQL} FROM tested""")
def table_of_metric_timing(spark: SparkSession, folder: str) -> DataFrame:
    """Onset of the flag rate against that of each quality metric, per subset."""
    chains = paired.onset_onset_chains(tq._onsets(spark, folder), "flag_rate", ["positive_share", "auroc_like"])
    return tables.metric_timing_table(paired.paired_timing(chains, ["qa_metric"]), {"qa_metric": "QA metric"})


@query(f"""WITH RECURSIVE {tq.INCLINE_SQL}, {tq._METRIC_PAIRS.lstrip()}, {tq._subset_sql('universe', 'qa_metric, generator')}, {tq.EXACT_SQL.lstrip()}, {tq._tested_sql('qa_metric, generator')},
crossed_of AS (SELECT generator, metric, count(*) AS n, count_if(crossed) AS k FROM onsets GROUP BY ALL)
SELECT t.generator AS "Generator", qa_metric AS "QA metric", a.n AS "N chains total", a.k AS "N with hallucination onset", b.k AS "N with QA-metric onset", subset AS "Subset", n_pairs AS "N with both onsets defined", {_TEXT_SQL}
FROM tested t JOIN crossed_of a ON a.generator = t.generator AND a.metric = 'flag_rate' JOIN crossed_of b ON b.generator = t.generator AND b.metric = qa_metric WHERE subset = 'Full population'""")
def table_of_generator_timing(spark: SparkSession, folder: str) -> DataFrame:
    """The same per generator, with the chains that have either onset."""
    onsets = tq._onsets(spark, folder)
    chains = paired.onset_onset_chains(onsets, "flag_rate", ["positive_share", "auroc_like"], by_generator=True)
    timing = paired.paired_timing(chains, ["qa_metric", "generator"]).filter(F.col("subset") == subsets.FULL)
    counts = onset.crossing_counts(onsets, ["metric", "generator"])
    own = counts.filter("metric = 'flag_rate'").select("generator", F.col("n_total").alias("N chains total"), F.col("n_crossed").alias("N with hallucination onset"))
    other = counts.select("generator", F.col("metric").alias("qa_metric"), F.col("n_crossed").alias("N with QA-metric onset"))
    facts = ["N chains total", "N with hallucination onset", "N with QA-metric onset"]
    return tables.metric_timing_table(timing.join(own, "generator").join(other, ["generator", "qa_metric"]), {"generator": "Generator", "qa_metric": "QA metric"}, facts)


# ------------------------------------------------------------------ small steps
@query(f"WITH {v.TRAJECTORY_SQL} SELECT generator, 'gen_' || generation AS label, CAST(generation AS BIGINT) AS generation, CAST(dseed AS BIGINT) AS dseed, CAST(mseed AS BIGINT) AS mseed, {s6('flag_rate')} FROM trajectory QUALIFY row_number() OVER (PARTITION BY generator, generation ORDER BY dseed, mseed) = 1")
def first_rows_printed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per generator and generation of a summary that repeats them, under printed generation labels."""
    wide = v.trajectory(spark, folder).select("generator", generation_label(F.col("generation")).alias("label"), "dseed", "mseed", "flag_rate")
    first = ids.keep_first(wide, ["generator", "label"], [F.col("dseed"), F.col("mseed")])
    return first.select("generator", "label", generation_number(F.col("label")).cast("bigint").alias("generation"), "dseed", "mseed", r6("flag_rate"))


@query(f"""WITH {v.PATCH_SQL}, {T_CTE},
patched AS (SELECT t.generator, t.generation, coalesce(p.metric_value, t.flag_rate) AS flag_rate, t.auroc_like FROM trajectory t LEFT JOIN (SELECT * FROM patch WHERE metric_name = 'flag_rate') p USING ({KEY_SQL})),
metric_rows AS (SELECT generator, generation, 'flag_rate' AS metric, flag_rate AS value FROM patched UNION ALL SELECT generator, generation, 'auroc_like', auroc_like FROM patched)
{pooled_sql('metric_rows', 'generator, generation, metric', 'value')}""")
def pooled_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """A pooled summary in which one patched metric is pooled anew."""
    wide = v.trajectory(spark, folder)
    patched = utility.patch_overlay(wide, v.patch(spark, folder), KEYS, ["flag_rate"])
    old = pooling.pooled_metrics(wide, ["generator", "generation"], ["flag_rate", "auroc_like"])
    return pooled_out(utility.refresh_pooled(old, patched, ["flag_rate"]), ["generator", "generation", "metric"])


@query(f"WITH {cq.REVIEW_RATES_SQL} SELECT max(combined_rate) <= 1.0 AS rates_are_fractions FROM review_rates")
def review_rate_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Are the reviewer's rates fractions although percentages are expected?"""
    return review.looks_like_fractions(cq._review_rates(spark, folder))


@query(f"WITH {rq.RULED_SQL} SELECT generator, category, rule, count(*) AS n FROM detail GROUP BY ALL")
def rule_tags_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts from joined tag texts, taken apart again."""
    tagged = rules.tags(rules.flags(rq.masked_records(spark, folder)).filter("any_rule"))
    parts = [tagged.select("generator", F.lit(k).alias("category"), F.explode(rules.split_tags(F.col(f"{k}_tags"))).alias("rule")) for k in ("impossible", "suspicious")]
    return parts[0].unionByName(parts[1]).groupBy("generator", "category", "rule").agg(F.count(F.lit(1)).alias("n"))


_CORE = [c for c in m.FEATURES if c in m.CORE_FEATURES]


@query(f"WITH {v.RECORDS_SQL} SELECT {KEY_SQL}, ID, {', '.join(_CORE)} FROM synthetic WHERE variant = 'core'")
def core_records(spark: SparkSession, folder: str) -> DataFrame:
    """The core variants' records in the columns that they have."""
    rows = v.records(spark, folder, "synthetic", ids=True).filter("variant = 'core'")
    return rows.select(*KEYS, "ID", *m.feature_columns("core"))
