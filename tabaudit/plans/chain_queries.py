"""Queries on review hand-off, summaries, trajectories, labels, utility and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.operators import labels, novelty, pooling, review, rules, trajectories, utility
from tabaudit.plans import record_queries as rq
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, T_CTE, long_of, pooled_out, pooled_sql, r6, s6

registry = Registry()
query = registry.query
KEYS = v.FILE
KEY_SQL = rq.KEY_SQL
_half_even = rq._half_even
REVIEWED_GENERATIONS = [0, 5]

# ------------------------------------------------------------------- review
_OUTSIDE = " OR ".join(f"coalesce({c} < {lo} OR {c} > {hi}, FALSE)" for c, (lo, hi) in m.NORMAL_RANGE.items())
CANDIDATES_SQL = f"""{rq.RULED_SQL},
candidates AS (SELECT * FROM flagged WHERE NOT any_rule AND generation IN (0, 5) AND ({_OUTSIDE})),
batched AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY ID) AS position,
                   CAST((row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY ID) - 1) // 20 AS BIGINT) AS batch FROM candidates)"""


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    masked = rq.masked_records(spark, folder, ids=True, generations=REVIEWED_GENERATIONS)
    # the masks are on the row; without_flagged is for flags that are stored apart
    clean = masked.filter("impossible_mask = 0 AND suspicious_mask = 0").drop("impossible_mask", "suspicious_mask")
    return review.worth_review(clean)


@query(f"WITH {CANDIDATES_SQL} SELECT {KEY_SQL}, ID, icd9, heartrate FROM candidates")
def review_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select(*KEYS, "ID", "icd9", "heartrate")


@query(f"WITH {CANDIDATES_SQL} SELECT {KEY_SQL}, ID, position, batch FROM batched")
def review_batches(spark: SparkSession, folder: str) -> DataFrame:
    return review.review_batches(_candidates(spark, folder), KEYS, batch_rows=20).select(*KEYS, "ID", "position", "batch")


def _cell_sql(c: str) -> str:
    if c in m.BOOLEAN_FEATURES:
        return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' ELSE '' END"
    if c in m.ONE_DECIMAL_FEATURES:
        return f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"coalesce(CAST({c} AS VARCHAR), '')"


_LINE = " || ',' || ".join(_cell_sql(c) for c in m.REVIEW_COLUMNS)
_HEAD = m.REVIEW_HEADER.replace("'", "''")


@query(f"""WITH {CANDIDATES_SQL}
SELECT {KEY_SQL}, batch, count(*) AS n_rows,
       '{_HEAD}' || chr(10) || chr(10) || 'CSV:' || chr(10) || '{",".join(m.REVIEW_COLUMNS)}' || chr(10) ||
       string_agg({_LINE}, chr(10) ORDER BY position) || chr(10) AS payload
FROM batched GROUP BY ALL""")
def review_payload(spark: SparkSession, folder: str) -> DataFrame:
    batched = review.review_batches(_candidates(spark, folder), KEYS, batch_rows=20)
    return review.batch_payloads(batched, KEYS)


# Each document text is read as a reviewer's answer about the documents of its source.
_TOKENS = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[0-9]+'))"
PARSE_SQL = f"""
parsed AS (SELECT doc_id, source, CASE WHEN len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: lower(t) = 'none')) > 0
                  THEN CAST([] AS BIGINT[]) ELSE list_distinct(list_filter(list_transform({_TOKENS}, lambda t: TRY_CAST(t AS BIGINT)), lambda x: x IS NOT NULL)) END AS ids
           FROM documents)"""


@query(f"WITH {PARSE_SQL} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(list_sum(ids) % 1000000007 AS BIGINT) AS id_sum FROM parsed WHERE len(ids) > 0")
def review_parse(spark: SparkSession, folder: str) -> DataFrame:
    docs = v.table(spark, folder, "documents").select("doc_id", review.named_ids(F.col("text")).alias("ids"))
    named = docs.filter(F.size("ids") > 0)
    total = F.aggregate(F.transform("ids", lambda x: x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return named.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), (total % 1000000007).cast("bigint").alias("id_sum"))


@query(f"""WITH {PARSE_SQL}, named AS (SELECT source, unnest(ids) AS ID FROM parsed)
SELECT DISTINCT named.source AS folder, ID FROM named JOIN documents d ON d.source = named.source AND d.doc_id = named.ID""")
def review_flagged(spark: SparkSession, folder: str) -> DataFrame:
    docs = v.table(spark, folder, "documents")
    responses = docs.select(F.col("source").alias("folder"), F.col("text").alias("response"))
    known = docs.select(F.col("source").alias("folder"), F.col("doc_id").alias("ID"))
    return review.flagged_by_reviewer(responses, known, ["folder"]).distinct()


_PERCENT = {n: f"{_half_even(f'{c} / n * 100.0::DOUBLE * 10000.0::DOUBLE')} / 10000.0::DOUBLE" for n, c in
            (("expert_any_rate", "e"), ("llm_rate", "l"), ("combined_rate", "b"))}
REVIEW_RATES_SQL = f"""{v.REVIEW_SQL},
counted AS (SELECT folder, generation, count(*) AS n, count_if(rule_flag) AS e, count_if(coalesce(reviewer_flag, FALSE)) AS l,
                   count_if(rule_flag OR coalesce(reviewer_flag, FALSE)) AS b FROM review GROUP BY ALL),
review_rates AS (SELECT folder, generation, n AS total_rows, e AS expert_flagged, l AS llm_flagged,
                   {', '.join(f'{x} AS {n}' for n, x in _PERCENT.items())} FROM counted)"""


def _review_rates(spark: SparkSession, folder: str) -> DataFrame:
    return review.review_rates(v.review(spark, folder), ["folder", "generation"], "rule_flag", "reviewer_flag")


@query(f"WITH {REVIEW_RATES_SQL} SELECT * FROM review_rates")
def review_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _review_rates(spark, folder)


@query(f"WITH {REVIEW_RATES_SQL} SELECT folder, generation, {s6('abs(expert_any_rate + llm_rate - combined_rate)', 'residual')} FROM review_rates WHERE abs(expert_any_rate + llm_rate - combined_rate) > 0.02")
def review_validation(spark: SparkSession, folder: str) -> DataFrame:
    return review.rate_problems(_review_rates(spark, folder)).select("folder", "generation", r6("residual"))


@query(f"""WITH {REVIEW_RATES_SQL}, {T_CTE},
rate_long AS (SELECT generation, 'LLM' AS metric, llm_rate / 100.0::DOUBLE AS value FROM review_rates
              UNION ALL SELECT generation, 'LLM_accumulated', combined_rate / 100.0::DOUBLE FROM review_rates)
{pooled_sql('rate_long', 'generation, metric', 'value')}""")
def review_by_generation(spark: SparkSession, folder: str) -> DataFrame:
    rates = _review_rates(spark, folder).selectExpr(
        "generation", "inline(array(named_struct('metric', 'LLM', 'value', llm_rate / 100D), named_struct('metric', 'LLM_accumulated', 'value', combined_rate / 100D)))"
    )
    return pooled_out(pooling.pooled(rates, ["generation", "metric"], "value"), ["generation", "metric"])


@query(f"""WITH usage AS (SELECT conv_id % 10 AS run, CASE WHEN role = 'user' THEN 'input' WHEN role = 'assistant' THEN 'output' ELSE 'cache_read' END AS kind,
                 length(text) AS tokens FROM conversations)
SELECT run, kind, CAST(sum(tokens) AS BIGINT) AS tokens,
       {s6("sum(tokens) / 1000000.0::DOUBLE * CASE kind WHEN 'input' THEN 3.0 WHEN 'output' THEN 15.0 WHEN 'cache_write' THEN 3.75 ELSE 0.3 END::DOUBLE", 'cost_usd')}
FROM usage GROUP BY run, kind""")
def cost_ledger(spark: SparkSession, folder: str) -> DataFrame:
    usage = v.table(spark, folder, "conversations").selectExpr(
        "conv_id % 10 AS run",
        "CASE WHEN role = 'user' THEN 'input' WHEN role = 'assistant' THEN 'output' ELSE 'cache_read' END AS kind",
        "length(text) AS tokens",
    )
    return review.cost_ledger(usage, ["run"]).select("run", "kind", "tokens", r6("cost_usd"))


# ---------------------------------------------------------------- summaries
@query(f"""WITH {rq.NOVEL_SQL}, {v.TRAJECTORY_SQL},
base AS (SELECT generation, bin, avg(novelty_rate) AS HR_mean FROM rates GROUP BY ALL),
block AS (SELECT CAST(generation AS BIGINT) AS generation, avg(flag_rate) AS LLM_mean FROM trajectory WHERE generation % 2 = 0 GROUP BY ALL)
SELECT generation, CAST(bin AS BIGINT) AS bin, {s6('HR_mean')}, {s6('LLM_mean')} FROM base LEFT JOIN block USING (generation)""")
def summary_merge(spark: SparkSession, folder: str) -> DataFrame:
    rates, _ = rq._rates(spark, folder)
    base = rates.groupBy("generation", "bin").agg(F.avg("novelty_rate").alias("HR_mean")).withColumn("LLM_mean", F.lit(-1.0))
    block = v.trajectory(spark, folder).filter("generation % 2 = 0").groupBy(long_of("generation")).agg(F.avg("flag_rate").alias("LLM_mean"))
    merged = pooling.attach_owned(base, block, ["generation"], ("LLM_",))
    return merged.select("generation", long_of("bin"), r6("HR_mean"), r6("LLM_mean"))


@query(f"""WITH {v.TRAJECTORY_SQL},
old AS (SELECT generator, dseed, mseed, generation, flag_rate AS value, 1 AS run FROM trajectory WHERE generation < 12),
new AS (SELECT generator, dseed, mseed, generation, auroc_like AS value, 2 AS run FROM trajectory WHERE generation >= 8),
both_runs AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, {s6('value')}, CAST(run AS BIGINT) AS run FROM both_runs
QUALIFY row_number() OVER (PARTITION BY generator, dseed, mseed, generation ORDER BY run DESC) = 1""")
def summary_upsert(spark: SparkSession, folder: str) -> DataFrame:
    wide = v.trajectory(spark, folder)
    old = wide.filter("generation < 12").selectExpr(*KEYS, "flag_rate AS value", "1 AS run")
    new = wide.filter("generation >= 8").selectExpr(*KEYS, "auroc_like AS value", "2 AS run")
    out = pooling.upsert(old, new, KEYS, "run")
    return out.select(*v.CHAIN, long_of("generation"), r6("value"), long_of("run"))


@query(f"""WITH {v.REVIEW_SQL}
SELECT DISTINCT folder, generation FROM review r WHERE NOT EXISTS (
  SELECT 1 FROM review d WHERE d.reviewer_flag AND d.folder = r.folder AND d.generation = r.generation)""")
def resume_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.review(spark, folder)
    keys = ["folder", "generation"]
    return pooling.still_to_do(rows.select(*keys).distinct(), rows.filter("reviewer_flag"), keys)


# ------------------------------------------------------------- trajectories
# Every rule is a flag of its own; many files never fire a given one.
_RULE_NAMES = ", ".join(f"('{r.name}')" for r in rules.RULES)
SPARSE_SQL = f"""{rq.RULED_SQL},
names(rule) AS (VALUES {_RULE_NAMES}),
sizes AS (SELECT {KEY_SQL}, rule, n_rows FROM (SELECT {KEY_SQL}, count(*) AS n_rows FROM synthetic GROUP BY ALL) f, names),
counts AS (SELECT {KEY_SQL}, rule, count(*) AS n_flagged FROM detail GROUP BY ALL)"""
RULE_CHAIN = ["rule", *v.CHAIN]
RULE_KEYS = ["rule", *KEYS]


def _sparse(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Counts per rule and file that fired, and row counts per rule and file."""
    table = rules.rule_table(rq.masked_records(spark, folder), KEYS)
    return table.filter("n > 0").select(*RULE_KEYS, F.col("n").alias("n_flagged")), table.select(*RULE_KEYS, "n_rows")


@query(f"""WITH {SPARSE_SQL}
SELECT rule, {KEY_SQL}, n_rows, coalesce(n_flagged, 0) AS n_flagged, {s6('coalesce(n_flagged, 0) / n_rows', 'value')}
FROM sizes LEFT JOIN counts USING (rule, {KEY_SQL})""")
def chain_rates(spark: SparkSession, folder: str) -> DataFrame:
    hits, sizes = _sparse(spark, folder)
    return trajectories.chain_rates(hits, sizes, RULE_KEYS).select(*RULE_KEYS, "n_rows", "n_flagged", r6("value"))


_GATE = """
chains AS (SELECT DISTINCT rule, generator, dseed, mseed FROM sizes),
gate AS (SELECT rule, generation FROM counts GROUP BY rule, generation HAVING count(*) / (SELECT count(DISTINCT (generator, dseed, mseed)) FROM sizes) >= 0.5)"""


@query(f"""WITH {SPARSE_SQL}, {_GATE}
SELECT rule, generator, dseed, mseed, generation, coalesce(n_flagged, 0) AS n_flagged, {s6('coalesce(n_flagged, 0) / n_rows', 'value')}
FROM chains JOIN gate USING (rule) LEFT JOIN counts USING (rule, {KEY_SQL}) LEFT JOIN sizes USING (rule, {KEY_SQL})""")
def chain_rates_coverage_gated(spark: SparkSession, folder: str) -> DataFrame:
    hits, sizes = _sparse(spark, folder)
    out = trajectories.chain_rates_gated(hits, sizes, RULE_CHAIN, sizes, per=["rule"])
    return out.select(*RULE_KEYS, "n_flagged", r6("value"))


@query(f"""WITH {SPARSE_SQL},
chains AS (SELECT DISTINCT rule, generator, dseed, mseed FROM sizes),
totals AS (SELECT rule, generator, count(*) AS n_chains FROM chains GROUP BY rule, generator),
gate AS (SELECT rule, generator, generation FROM counts JOIN totals USING (rule, generator) GROUP BY rule, generator, generation, n_chains HAVING count(*) / n_chains >= 0.5)
SELECT rule, generator, dseed, mseed, generation, coalesce(n_flagged, 0) AS n_flagged, {s6('coalesce(n_flagged, 0) / n_rows', 'value')}
FROM chains JOIN gate USING (rule, generator) LEFT JOIN counts USING (rule, {KEY_SQL}) LEFT JOIN sizes USING (rule, {KEY_SQL})""")
def chain_rates_gated_per_generator(spark: SparkSession, folder: str) -> DataFrame:
    hits, sizes = _sparse(spark, folder)
    out = trajectories.chain_rates_gated(hits, sizes, RULE_CHAIN, sizes, per=["rule", "generator"])
    return out.select(*RULE_KEYS, "n_flagged", r6("value"))


@query(f"WITH {SPARSE_SQL} SELECT rule, {KEY_SQL}, n_flagged, {s6('n_flagged / n_rows', 'value')} FROM counts JOIN sizes USING (rule, {KEY_SQL})")
def chain_rates_unfilled(spark: SparkSession, folder: str) -> DataFrame:
    hits, sizes = _sparse(spark, folder)
    return trajectories.chain_rates_unfilled(hits, sizes, RULE_KEYS).select(*RULE_KEYS, "n_flagged", r6("value"))


@query(f"""WITH {v.REVIEW_SQL},
covered AS (SELECT DISTINCT folder, generation FROM review WHERE reviewer_flag),
united AS (SELECT folder, generation, ID FROM review SEMI JOIN covered USING (folder, generation) WHERE rule_flag
           UNION SELECT folder, generation, ID FROM review WHERE reviewer_flag),
sizes AS (SELECT folder, generation, count(*) AS n_rows FROM review GROUP BY ALL)
SELECT folder, generation, count(*) AS n_flagged, {s6('count(*) / max(n_rows)', 'value')} FROM united JOIN sizes USING (folder, generation) GROUP BY folder, generation""")
def combined_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.review(spark, folder)
    keys = ["folder", "generation"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    out = trajectories.combined_rates(rows.filter("rule_flag"), rows.filter("reviewer_flag"), sizes, keys)
    return out.select(*keys, "n_flagged", r6("value"))


_CHECK = f"""{rq.RULED_SQL},
ours AS (SELECT generator, generation, avg(any_rate) AS value FROM file_rates GROUP BY ALL),
official AS (SELECT generator, generation, count_if(impossible) / count(*) AS official_mean FROM flagged GROUP BY ALL)"""


@query(f"WITH {_CHECK} SELECT generator, generation, {s6('abs(value - official_mean)', 'diff')} FROM ours JOIN official USING (generator, generation) WHERE abs(value - official_mean) > 0.10")
def rate_cross_check(spark: SparkSession, folder: str) -> DataFrame:
    masked = rq.masked_records(spark, folder)
    rates = rules.rule_rates(masked, KEYS)
    ours = rates.groupBy("generator", "generation").agg(F.avg("any_rate").alias("value"))
    official = rates.groupBy("generator", "generation").agg((F.sum("n_impossible") / F.sum("n_rows")).alias("official_mean"))
    return trajectories.cross_check(ours, official, ["generator", "generation"]).select("generator", "generation", r6("diff"))


# -------------------------------------------------------------- class balance
# One file per chain and generation of the event stream; its label says whether
# an event is a purchase.  The files are small, so single-class files exist.
LABELS_SQL = """
labelled_rows AS (SELECT CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END AS generator,
    CAST(floor(user_id / 4.0::DOUBLE) AS BIGINT) % 3 AS dseed, CAST(floor(user_id / 4.0::DOUBLE) AS BIGINT) AS mseed,
    CAST(floor((extract(DAY FROM ts) - 1) * 20 / 30.0::DOUBLE) AS BIGINT) AS generation, event_type = 'purchase' AS positive, event_type FROM events)"""
BALANCE_SQL = f"""{LABELS_SQL},
balance AS (SELECT {KEY_SQL}, count(*) AS n_rows, count_if(positive) AS n_positive, count_if(positive) / count(*) AS positive_share,
                   least(count_if(positive) / count(*), 1 - count_if(positive) / count(*)) AS minority_share,
                   count(DISTINCT positive) AS n_classes FROM labelled_rows GROUP BY ALL)"""


def _labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return v.table(spark, folder, "events").selectExpr(
        "CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END AS generator",
        "CAST(floor(user_id / 4D) AS BIGINT) % 3 AS dseed", "CAST(floor(user_id / 4D) AS BIGINT) AS mseed",
        "CAST(floor((day(ts) - 1) * 20 / 30D) AS BIGINT) AS generation",
        "CASE WHEN event_type = 'purchase' THEN ' Yes' ELSE 'n' END AS Readmitted",
    )


def _balance(spark: SparkSession, folder: str) -> DataFrame:
    return labels.class_balance(_labelled_rows(spark, folder), KEYS)


@query(f"WITH {BALANCE_SQL} SELECT {KEY_SQL}, n_rows, n_positive, {s6('positive_share')}, {s6('minority_share')}, n_classes FROM balance")
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return _balance(spark, folder).select(*KEYS, "n_rows", "n_positive", r6("positive_share"), r6("minority_share"), "n_classes")


@query("""WITH per_file AS (SELECT l_orderkey, l_linenumber, count_if(l_returnflag = 'A') AS n_positive FROM lineitem GROUP BY ALL)
SELECT l_orderkey, min(n_positive) AS n_positive, count(*) AS n_generations FROM per_file GROUP BY l_orderkey HAVING count(DISTINCT n_positive) <= 1""")
def class_balance_frozen(spark: SparkSession, folder: str) -> DataFrame:
    """Orders stand for chains and line numbers for generations: many never change."""
    rows = v.table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber AS generation", "l_returnflag = 'A' AS target")
    balance = labels.class_balance(rows, ["l_orderkey", "generation"])
    return labels.frozen_chains(balance, ["l_orderkey"])


@query(f"""WITH {BALANCE_SQL}, first_hit AS (SELECT generator, dseed, mseed, min(generation) AS g FROM balance WHERE minority_share = 0 GROUP BY ALL)
SELECT generator, count(*) AS n_chains, min(g) AS first_min, {s6('median(g)', 'first_median')}, max(g) AS first_max FROM first_hit GROUP BY generator""")
def class_collapse_first(spark: SparkSession, folder: str) -> DataFrame:
    out = labels.first_collapse(_balance(spark, folder), v.CHAIN, ["generator"])
    return out.select("generator", "n_chains", "first_min", r6("first_median"), "first_max")


@query(f"WITH {v.TRAJECTORY_SQL} SELECT generator, dseed, mseed, count(*) AS n_generations FROM trajectory GROUP BY ALL HAVING count(*) < 20")
def short_chains(spark: SparkSession, folder: str) -> DataFrame:
    return labels.short_chains(v.trajectory(spark, folder), v.CHAIN)


@query(f"""WITH {v.RECORDS_SQL},
per_level AS (SELECT {KEY_SQL}, bmi, count(*) AS k FROM synthetic GROUP BY ALL)
SELECT {KEY_SQL}, count(bmi) AS n_classes, {s6('min(k) FILTER (bmi IS NOT NULL) / sum(k) FILTER (bmi IS NOT NULL)', 'minority_fraction')} FROM per_level GROUP BY {KEY_SQL}""")
def label_balance(spark: SparkSession, folder: str) -> DataFrame:
    out = labels.label_balance(v.records(spark, folder, "synthetic"), KEYS, "bmi")
    return out.select(*KEYS, "n_classes", r6("minority_fraction"))


@query(f"""WITH {BALANCE_SQL}
SELECT generator, generation, count(*) AS n_files, count_if(n_classes <= 1) AS n_collapsed FROM balance GROUP BY ALL""")
def collapse_marks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled_rows(spark, folder)
    balance = labels.label_balance(rows, KEYS, "Readmitted")
    marked = labels.attach_collapse(rows.select(*KEYS).distinct(), balance, KEYS)
    return marked.groupBy("generator", "generation").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("class_collapse").alias("n_collapsed")
    )


@query(f"WITH {v.RECORDS_SQL}, c AS (SELECT DISTINCT generator, dseed, mseed FROM synthetic) SELECT generator, count(*) AS n_chains, count(*) = 15 AS as_expected FROM c GROUP BY generator")
def chain_count_check(spark: SparkSession, folder: str) -> DataFrame:
    return labels.chain_count_check(v.records(spark, folder, "synthetic"), ["generator"], ["dseed", "mseed"])


# ------------------------------------------------------------------- utility
# Utility documents assembled as JSON text from event aggregates.
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
DOCUMENT_SQL = """
cells AS (SELECT user_id % 4 AS generator_id, CAST(floor(user_id / 4.0::DOUBLE) AS BIGINT) AS mseed, CAST((extract(DAY FROM ts) - 1) // 10 AS BIGINT) AS generation,
            count_if(event_type = 'view') AS tn, count_if(event_type = 'click') AS fp, count_if(event_type = 'error') AS fn,
            count_if(event_type = 'purchase') AS tp, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k
          FROM events GROUP BY ALL)"""
_RATES = [
    ("tstr_auroc", "CAST(k % 100 AS DOUBLE) / 128"), ("trtr_auroc", "CAST(k % 64 AS DOUBLE) / 64"),
    ("tstr_f1", "CAST(k % 8 AS DOUBLE) / 8"), ("tstr_tn", "CAST(tn AS DOUBLE)"), ("tstr_tp", "CAST(tp AS DOUBLE)"),
    ("tstr_fpr", "CAST(fp AS DOUBLE) / nullif(fp + tn, 0)"), ("tstr_fnr", "CAST(fn AS DOUBLE) / nullif(fn + tp, 0)"),
    ("tstr_tnr", "CAST(tn AS DOUBLE) / nullif(tn + fp, 0)"),
    ("utility_gap", "CAST(k % 64 AS DOUBLE) / 64 - CAST(k % 100 AS DOUBLE) / 128"),
]
_UTILITY_NAMES = [n for n, _ in _RATES]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per (generator_id, mseed, generation)."""
    cells = v.table(spark, folder, "events").selectExpr(
        "user_id % 4 AS generator_id", "CAST(floor(user_id / 4D) AS BIGINT) AS mseed",
        "CAST(floor((day(ts) - 1) / 10D) AS BIGINT) AS generation", "event_type",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    ).groupBy("generator_id", "mseed", "generation").agg(
        *[F.count_if(F.col("event_type") == e).alias(n) for n, e in (("tn", "view"), ("fp", "click"), ("fn", "error"), ("tp", "purchase"))],
        F.sum("k").alias("k"),
    )
    matrix = "named_struct('tn', tn, 'fp', fp, 'fn', fn, 'tp', tp)"
    return cells.selectExpr(
        "generator_id", "mseed", "generation",
        f"""to_json(named_struct(
            'tstr_metrics', named_struct('auroc', (k % 100) / 128D, 'f1_score', (k % 8) / 8D, 'confusion_matrix', {matrix}),
            'trtr_metrics', named_struct('auroc', (k % 64) / 64D), 'ignored', array(1, 2))) AS document""",
    )


_DOC_KEYS = ["generator_id", "mseed", "generation"]


@query(f"WITH {DOCUMENT_SQL} SELECT generator_id, mseed, generation, {', '.join(s6(e, n) for n, e in _RATES)} FROM cells")
def utility_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = utility.parse_utility(_documents(spark, folder), "document", _DOC_KEYS)
    return out.select(*_DOC_KEYS, *[r6(n) for n in _UTILITY_NAMES])


_LONG_UTILITY = " UNION ALL ".join(f"SELECT generator_id, generation, '{n}' AS metric, {e} AS value FROM cells" for n, e in _RATES)


@query(f"WITH {DOCUMENT_SQL}, {T_CTE}, metric_rows AS ({_LONG_UTILITY}) {pooled_sql('metric_rows', 'generator_id, generation, metric', 'value')}")
def utility_pooled(spark: SparkSession, folder: str) -> DataFrame:
    wide = utility.parse_utility(_documents(spark, folder), "document", _DOC_KEYS)
    keys = ["generator_id", "generation", "metric"]
    return pooled_out(pooling.pooled_metrics(wide, keys[:2], _UTILITY_NAMES), keys)


@query(f"""WITH {DOCUMENT_SQL}
SELECT generator_id, mseed, generation, path, {s6('value')} FROM (
  SELECT generator_id, mseed, generation, 'tstr_metrics.auroc' AS path, CAST(k % 100 AS DOUBLE) / 128 AS value FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'trtr_metrics.auroc', CAST(k % 64 AS DOUBLE) / 64 FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'tstr_metrics.f1_score', CAST(k % 8 AS DOUBLE) / 8 FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'tstr_metrics.confusion_matrix.tn', tn FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'tstr_metrics.confusion_matrix.fp', fp FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'tstr_metrics.confusion_matrix.fn', fn FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'tstr_metrics.confusion_matrix.tp', tp FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'ignored[0]', 1 FROM cells
  UNION ALL SELECT generator_id, mseed, generation, 'ignored[1]', 2 FROM cells) x""")
def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    out = utility.flat_numbers(_documents(spark, folder), "document", _DOC_KEYS)
    return out.select(*_DOC_KEYS, "path", r6("value"))


@query(f"""WITH {v.PATCH_SQL},
wide AS (SELECT generator, dseed, mseed, generation, max(CASE WHEN metric_name = 'flag_rate' THEN metric_value END) AS p_flag,
                max(CASE WHEN metric_name = 'extra_cost' THEN metric_value END) AS extra_cost FROM patch GROUP BY ALL)
SELECT generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, n_rows, {s6('coalesce(p_flag, flag_rate)', 'flag_rate')},
       {s6('auroc_like')}, {s6('extra_cost')}
FROM trajectory LEFT JOIN wide USING ({KEY_SQL})""")
def patch_overlay(spark: SparkSession, folder: str) -> DataFrame:
    base = v.trajectory(spark, folder)
    out = utility.patch_overlay(base, v.patch(spark, folder), KEYS, ["flag_rate", "extra_cost"])
    return out.select(*v.CHAIN, long_of("generation"), "n_rows", r6("flag_rate"), r6("auroc_like"), r6("extra_cost"))


@query(f"""WITH {v.PATCH_SQL}
SELECT metric_name, count(metric_value) AS n_matched, (SELECT count(*) FROM trajectory) AS n_rows FROM patch GROUP BY metric_name""")
def patch_matches(spark: SparkSession, folder: str) -> DataFrame:
    return utility.patch_matches(v.trajectory(spark, folder), v.patch(spark, folder), KEYS, ["flag_rate", "extra_cost"])


@query(f"""WITH {v.TIDY_SQL}
SELECT generator, dseed, mseed, 'd' || dseed || ' / m' || mseed AS chain, CAST(generation AS BIGINT) AS generation, metric, {s6('value')} FROM tidy""")
def tidy_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = utility.tidy(v.trajectory(spark, folder), v.TRAJECTORY_METRICS)
    return out.select(*v.CHAIN, "chain", long_of("generation"), "metric", r6("value"))


@query(f"""WITH {v.TRAJECTORY_SQL}, {v.RECORDS_SQL},
q AS (SELECT generator, generation, avg(CAST(age AS DOUBLE)) AS mean FROM synthetic GROUP BY ALL),
u AS (SELECT generator, generation, avg(auroc_like) AS mean FROM trajectory GROUP BY ALL)
SELECT generator, CAST(generation AS BIGINT) AS generation, {s6('q.mean', 'mean')}, {s6('u.mean', 'mean_tstr_dup')} FROM q FULL JOIN u USING (generator, generation)""")
def quality_utility_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A metric of the records beside the utility of the trajectories; each has generators and generations of its own."""
    quality = v.records(spark, folder, "synthetic").groupBy("generator", "generation").agg(F.avg(F.col("age").cast("double")).alias("mean"))
    other = v.trajectory(spark, folder).groupBy("generator", "generation").agg(F.avg("auroc_like").alias("mean"))
    out = utility.merge_quality_and_utility(quality, other, ["generator", "generation"])
    return out.select("generator", long_of("generation"), r6("mean"), r6("mean_tstr_dup"))
