"""Queries on record tables: normalisation, novelty, copies, rules, range checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.keys import with_chain_keys
from tabaudit.functions.normalise import normalise_records
from tabaudit.operators import novelty, pooling, rules
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, T_CTE, long_of, pooled_out, pooled_sql, r6, s6
from tabaudit.sources.scans import spread

registry = Registry()
query = registry.query
KEYS = v.FILE
KEY_SQL = "generator, dseed, mseed, generation"
BINS_SQL = "bins(bin) AS (VALUES (5), (7), (10), (15), (20), (30))"


# ------------------------------------------------------------ normalisation
# Raw-export shaped rows: text numbers, coded ordinals, mixed spellings.
_RAW = {
    "readmission": "CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN ' True' ELSE 'false' END",
    "prior_icu": "CASE WHEN c % 29 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 2 END",
    "age": "CASE WHEN c % 23 = 0 THEN 'n/a' ELSE CAST(c % 120 AS STRING) || '.5' END",
    "gender": "CASE l_orderkey % 8 WHEN 0 THEN ' m' WHEN 1 THEN 'F' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'false' WHEN 4 THEN '0' WHEN 5 THEN '1 ' WHEN 6 THEN 'x' ELSE NULL END",
    "bmi": "l_partkey % 7 - 2",
    "albumin": "CAST(l_quantity AS BIGINT) % 5 - 1",
    "cholesterol": "l_orderkey % 5 - 1",
    "nt-probnp": "c % 5 - 1",
    "insurance": "'dropped'",
    "glucose": "CAST(c AS DOUBLE) / 8",
    "sodium": "c % 300",
    "creatinine": "CAST(c % 30 AS STRING) || '.' || lpad(CAST(l_partkey % 100 AS STRING), 2, '0')",
    "potassium": "CASE WHEN c % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(c % 977 AS DOUBLE) / 40 END",
}
_FOLDER = (
    "CASE WHEN l_partkey % 50 = 0 THEN 'other_run' ELSE 'Step7pf' || CASE l_linestatus WHEN 'O' THEN 'a' ELSE 'p' END || '_dseed' || "
    "CAST(l_suppkey % 3 AS STRING) || '_synthcity_' || CASE l_returnflag WHEN 'A' THEN 'arf' WHEN 'N' THEN 'ctgan' ELSE 'ddpm' END || "
    "'_mseed' || CAST(l_suppkey % 5 AS STRING) END"
)


def _half_even(x: str) -> str:
    return (
        f"(floor({x}) + CASE WHEN ({x}) - floor({x}) < 0.5 THEN 0 WHEN ({x}) - floor({x}) > 0.5 THEN 1 "
        f"ELSE abs(CAST(floor({x}) AS BIGINT) % 2) END)"
    )


def _ordinal_sql(name: str, column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{label}'" for k, label in m.ORDINAL_LABELS[name].items())
    return f"CASE {column} {cases} END AS {name}"


_RAW_SQL = ", ".join(f'{e.replace("STRING", "VARCHAR")} AS "{n}"' for n, e in _RAW.items())


@query(f"""
WITH raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS ID, {_FOLDER.replace("STRING", "VARCHAR")} AS folder, {_RAW_SQL}
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) x)
SELECT ID, folder,
  CASE WHEN folder = 'other_run' THEN NULL ELSE CAST(regexp_extract(folder, 'dseed([0-9]+)', 1) AS BIGINT) END AS dseed,
  CASE WHEN folder = 'other_run' THEN NULL ELSE CAST(regexp_extract(folder, 'mseed([0-9]+)', 1) AS BIGINT) END AS mseed,
  CASE WHEN folder = 'other_run' THEN NULL ELSE upper(split_part(folder, '_', 4)) || CASE WHEN folder LIKE 'Step7pfp%' THEN '_CORE' ELSE '' END END AS generator,
  CASE WHEN folder = 'other_run' THEN folder ELSE 'd' || regexp_extract(folder, 'dseed([0-9]+)', 1) || ' / m' || regexp_extract(folder, 'mseed([0-9]+)', 1) END AS chain,
  lower(trim(readmission)) IN ('1', 'true') AS readmission,
  prior_icu = 1 AS prior_icu,
  CASE WHEN age = 'n/a' THEN NULL ELSE CAST({_half_even('CAST(age AS DOUBLE)')} AS BIGINT) END AS age,
  CASE upper(trim(gender)) WHEN 'M' THEN 'M' WHEN 'FALSE' THEN 'M' WHEN '0' THEN 'M' WHEN 'F' THEN 'F' WHEN 'TRUE' THEN 'F' WHEN '1' THEN 'F' END AS gender,
  {_ordinal_sql('bmi', 'bmi')}, {_ordinal_sql('bnp', '"nt-probnp"')},
  {_ordinal_sql('cholesterol', 'cholesterol')}, {_ordinal_sql('albumin', 'albumin')},
  CAST({_half_even('glucose')} AS BIGINT) AS glucose, sodium,
  {_half_even('CAST(creatinine AS DOUBLE) * 10.0::DOUBLE')} / 10.0::DOUBLE AS creatinine,
  CASE WHEN isnan(potassium) THEN NULL ELSE {_half_even('potassium * 10.0::DOUBLE')} / 10.0::DOUBLE END AS potassium
FROM raw""")
def records_normalised(spark: SparkSession, folder: str) -> DataFrame:
    table = spread(v.table(spark, folder, "lineitem"), "l_orderkey", "l_partkey")
    lines = table.withColumn("c", F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)"))
    raw = lines.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("ID"), F.expr(_FOLDER).alias("folder"),
        *[F.expr(e).alias(n) for n, e in _RAW.items()],
    )
    clean = with_chain_keys(normalise_records(raw))
    return clean.select(
        "ID", "folder", "dseed", "mseed", "generator", "chain", "readmission", "prior_icu", "age", "gender",
        "bmi", "bnp", "cholesterol", "albumin", "glucose", "sodium", "creatinine", "potassium",
    )


# ------------------------------------------------------------------ novelty
def _population(spark: SparkSession, folder: str) -> novelty.Population:
    return novelty.Population.learn(
        v.profile(spark, folder, "population"), v.PROFILE_NUMERIC, v.PROFILE_CATEGORICAL
    )


def _norm_sql(c: str) -> str:
    key = f"lower(trim({c}))"
    return (
        f"CASE WHEN {c} IS NULL OR {key} IN ('nan', 'null', 'none', '') THEN 'Missing' "
        f"WHEN {key} IN ('true', '1') THEN '1' WHEN {key} IN ('false', '0') THEN '0' ELSE {c} END"
    )


def _bin_sql(c: str) -> str:
    low, high = f"min_{c}", f"max_{c}"
    return (
        f"CASE WHEN {c} IS NULL THEN 0 WHEN {low} = {high} THEN 1 ELSE "
        f"CAST(least(greatest(floor(({c} - {low}) / nullif({high} - {low}, 0) * CAST(bin AS DOUBLE)) + 1, 1), bin) AS INT) END"
    )


_CELLS = ", ".join([f"{_bin_sql(c)} AS b_{c}" for c in v.PROFILE_NUMERIC] + [f"{_norm_sql(c)} AS b_{c}" for c in v.PROFILE_CATEGORICAL])
_CELL_NAMES = ", ".join(f"b_{c}" for c in v.PROFILE_NUMERIC + v.PROFILE_CATEGORICAL)
_BOUNDS = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in v.PROFILE_NUMERIC)
NOVEL_SQL = f"""{v.PROFILE_SQL},
{BINS_SQL},
bounds AS (SELECT {_BOUNDS} FROM profile WHERE role = 'population'),
celled AS (SELECT profile.*, bin, {_CELLS} FROM profile, bounds, bins),
known AS (SELECT DISTINCT bin, {_CELL_NAMES}, TRUE AS hit FROM celled WHERE role = 'population'),
tested AS (SELECT c.*, hit IS NULL AS novel
           FROM (SELECT * FROM celled WHERE role = 'synthetic') c LEFT JOIN known USING (bin, {_CELL_NAMES})),
rates AS (SELECT {KEY_SQL}, bin, count(*) AS n_rows, count_if(novel) AS n_novel,
                 count_if(novel) / count(*) AS novelty_rate FROM tested GROUP BY ALL)"""


@query(f"""
WITH {v.PROFILE_SQL}
SELECT feature, {s6('low')}, {s6('high')} FROM (
  SELECT 'n1' AS feature, min(n1) AS low, max(n1) AS high FROM profile WHERE role = 'population'
  UNION ALL SELECT 'n2', min(n2), max(n2) FROM profile WHERE role = 'population'
  UNION ALL SELECT 'n3', min(n3), max(n3) FROM profile WHERE role = 'population') x""")
def population_bounds(spark: SparkSession, folder: str) -> DataFrame:
    found = novelty.population_bounds(v.profile(spark, folder, "population"), v.PROFILE_NUMERIC)
    return found.select("feature", r6("low"), r6("high"))


@query(f"""
WITH {v.PROFILE_SQL}
SELECT 'c1' AS feature, count(DISTINCT c1) AS n_levels FROM profile WHERE role = 'population'
UNION ALL SELECT 'c2', count(DISTINCT c2) FROM profile WHERE role = 'population'""")
def level_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return novelty.level_cardinality(v.profile(spark, folder, "population"), v.PROFILE_CATEGORICAL)


def _rates(spark: SparkSession, folder: str) -> tuple[DataFrame, novelty.Population]:
    pop = _population(spark, folder)
    return novelty.novelty_by_file(v.profile(spark, folder, "synthetic"), pop, KEYS), pop


@query(f"WITH {NOVEL_SQL} SELECT {KEY_SQL}, CAST(bin AS BIGINT) AS bin, n_rows, n_novel, {s6('novelty_rate')} FROM rates")
def novelty_rate_by_file(spark: SparkSession, folder: str) -> DataFrame:
    rates, _ = _rates(spark, folder)
    return rates.select(*KEYS, long_of("bin"), "n_rows", "n_novel", r6("novelty_rate"))


@query(f"WITH {NOVEL_SQL}, {T_CTE} SELECT * REPLACE (CAST(bin AS BIGINT) AS bin) FROM ({pooled_sql('rates', 'generator, generation, bin', 'novelty_rate')}) x")
def novelty_rate_by_generation(spark: SparkSession, folder: str) -> DataFrame:
    rates, _ = _rates(spark, folder)
    keys = ["generator", "generation", "bin"]
    return pooled_out(pooling.pooled(rates, keys, "novelty_rate"), keys).withColumn("bin", F.col("bin").cast("bigint"))


_FACTOR_SQL = """,
shape AS (SELECT count(*) AS p, count(DISTINCT c1) AS k1, count(DISTINCT c2) AS k2 FROM profile WHERE role = 'population'),
factors AS (SELECT bin, ln(p) / (3 * ln(bin) + ln(k1) + ln(k2)) AS ratio FROM shape, bins)"""


@query(f"""WITH {NOVEL_SQL}{_FACTOR_SQL}
SELECT {KEY_SQL}, CAST(bin AS BIGINT) AS bin, {s6('novelty_rate')},
       {s6('novelty_rate * CASE WHEN ratio > 1 THEN 1.0 ELSE ratio END', 'novelty_adjusted')}
FROM rates JOIN factors USING (bin)""")
def novelty_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    rates, pop = _rates(spark, folder)
    out = novelty.adjust_novelty(rates, pop.with_cardinality())
    return out.select(*KEYS, long_of("bin"), r6("novelty_rate"), r6("novelty_adjusted"))


@query(f"""WITH {NOVEL_SQL}{_FACTOR_SQL},
per_generation AS (SELECT generator, generation, bin, avg(novelty_rate) AS m, avg(novelty_rate * CASE WHEN ratio > 1 THEN 1.0 ELSE ratio END) AS a
                   FROM rates JOIN factors USING (bin) GROUP BY ALL)
SELECT generator, CAST(bin AS BIGINT) AS bin, {s6('avg(m)', 'mean_novelty')}, {s6('avg(a)', 'mean_adjusted')}, count(*) AS n_generations
FROM per_generation GROUP BY generator, bin""")
def novelty_bin_resolution(spark: SparkSession, folder: str) -> DataFrame:
    rates, pop = _rates(spark, folder)
    adjusted = novelty.adjust_novelty(rates, pop.with_cardinality())
    per_generation = adjusted.groupBy("generator", "generation", "bin").agg(
        F.avg("novelty_rate").alias("m"), F.avg("novelty_adjusted").alias("a")
    )
    out = per_generation.groupBy("generator", "bin").agg(
        F.avg("m").alias("mean_novelty"), F.avg("a").alias("mean_adjusted"), F.count(F.lit(1)).alias("n_generations")
    )
    return out.select("generator", long_of("bin"), r6("mean_novelty"), r6("mean_adjusted"), "n_generations")


@query(f"WITH {NOVEL_SQL} SELECT {KEY_SQL}, 'HR_b' || bin AS metric, ID FROM tested WHERE novel")
def novelty_ids(spark: SparkSession, folder: str) -> DataFrame:
    return novelty.novel_rows(v.profile(spark, folder, "synthetic", ids=True), _population(spark, folder), [*KEYS, "ID"])


@query(f"WITH {NOVEL_SQL} SELECT {KEY_SQL}, CAST(bin AS BIGINT) AS bin, n_rows, n_novel FROM rates")
def novelty_rate_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The form for populations too large to broadcast."""
    out = novelty.novelty_by_file(
        v.profile(spark, folder, "synthetic"), _population(spark, folder), KEYS, broadcast=False
    )
    return out.select(*KEYS, long_of("bin"), "n_rows", "n_novel")


@query(f"WITH {NOVEL_SQL} SELECT {KEY_SQL}, 'HR_b' || bin AS metric, ID FROM tested WHERE novel")
def novelty_ids_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    return novelty.novel_rows(
        v.profile(spark, folder, "synthetic", ids=True), _population(spark, folder), [*KEYS, "ID"], broadcast=False
    )


# ------------------------------------------------------------------- copies
_ROUND = ", ".join(f"{_half_even(c)} AS r_{c}" for c in v.PROFILE_NUMERIC)
_LOWER = ", ".join(f"lower(trim({c})) AS r_{c}" for c in v.PROFILE_CATEGORICAL)
_ROUNDED_NAMES = ", ".join(f"r_{c}" for c in v.PROFILE_NUMERIC + v.PROFILE_CATEGORICAL)
_MATCH = " AND ".join(f"s.r_{c} IS NOT DISTINCT FROM t.r_{c}" for c in v.PROFILE_NUMERIC + v.PROFILE_CATEGORICAL)
COPY_SQL = f"""{v.PROFILE_SQL},
rounded AS (SELECT *, {_ROUND}, {_LOWER} FROM profile),
taught AS (SELECT DISTINCT generator, dseed, mseed, {_ROUNDED_NAMES} FROM rounded WHERE role = 'training'),
hits AS (SELECT s.* FROM rounded s SEMI JOIN taught t ON t.generator = s.generator AND t.dseed = s.dseed AND t.mseed = s.mseed AND {_MATCH}
         WHERE s.role = 'synthetic')"""


@query(f"""WITH {COPY_SQL},
n AS (SELECT {KEY_SQL}, count(*) AS n_rows FROM profile WHERE role = 'synthetic' GROUP BY ALL),
c AS (SELECT {KEY_SQL}, count(*) AS n FROM hits GROUP BY ALL)
SELECT {KEY_SQL}, n_rows, coalesce(c.n, 0) AS n_copies, {s6('coalesce(c.n, 0) / n_rows', 'copy_rate')} FROM n LEFT JOIN c USING ({KEY_SQL})""")
def copy_rate_by_file(spark: SparkSession, folder: str) -> DataFrame:
    out = novelty.copy_counts(
        v.profile(spark, folder, "synthetic"), v.profile(spark, folder, "training"), v.CHAIN, KEYS,
        v.PROFILE_NUMERIC, v.PROFILE_CATEGORICAL,
    )
    return out.select(*KEYS, "n_rows", "n_copies", r6("copy_rate"))


@query(f"WITH {COPY_SQL} SELECT {KEY_SQL}, 'Copy' AS metric, ID FROM hits")
def copy_ids(spark: SparkSession, folder: str) -> DataFrame:
    out = novelty.copied_rows(
        v.profile(spark, folder, "synthetic", ids=True), v.profile(spark, folder, "training"), v.CHAIN,
        v.PROFILE_NUMERIC, v.PROFILE_CATEGORICAL,
    )
    return out.select(*KEYS, F.lit("Copy").alias("metric"), "ID")


# -------------------------------------------------------------------- rules
def _ne(c: str) -> str:
    low, high = m.EXTREME_BOUND[c]
    parts = [f"{c} > {low}"] if low is not None else []
    parts += [f"{c} < {high}"] if high is not None else []
    return "(" + " AND ".join(parts) + ")"


def _nm(c: str) -> str:
    low, high = m.NORMAL_RANGE[c]
    return f"({c} BETWEEN {low} AND {high})"


def _crossed(bounds: dict, names: list[str]) -> list[str]:
    out = []
    for c in names:
        low, high = bounds.get(c, (None, None))
        if low is not None:
            out.append(f"coalesce({c} <= {low}, FALSE)")
        if high is not None:
            out.append(f"coalesce({c} >= {high}, FALSE)")
    return out


_PP = "(systolic_bp - diastolic_bp)"
_RATIO = "(blood_urea_nitro / nullif(creatinine, 0))"
_FATAL_EACH = [
    "CAST(" + " OR ".join(_crossed(m.FATAL_BOUND, [c])) + " AS INT)" for c in m.FATAL_BOUND
]
_N_FATAL = "(" + " + ".join(_FATAL_EACH) + ")"
_FATAL_VITAL = "(" + " OR ".join(_crossed(m.FATAL_BOUND, m.PRIMARY_VITALS)) + ")"
_DISTURBED = "(" + " OR ".join(_crossed(m.EXTREME_BOUND, m.PRIMARY_VITALS)) + ")"
_N_EXTREME = "(" + " + ".join(f"CAST({p} AS INT)" for p in _crossed(m.EXTREME_BOUND, list(m.EXTREME_BOUND))) + ")"
_WASTE = "('Neoplasms', 'Genitourinary', 'Digestive', 'Blood disorders')"
_NOT_IN = " OR ".join(
    f"coalesce({c} NOT IN ({', '.join(repr(x) for x in levels)}), FALSE)" for c, levels in m.ALLOWED_LEVELS.items()
)
_TAME3 = f"coalesce({_ne('heartrate')} AND {_ne('respiratory_rate')} AND {_ne('spo2')}, FALSE)"
RULE_PREDICATES = {
    "reality_limit": " OR ".join(f"coalesce({c} < {lo} OR {c} > {hi}, FALSE)" for c, (lo, hi) in m.MEASURABLE_RANGE.items()),
    "bad_category": _NOT_IN,
    "dbp_ge_sbp": "diastolic_bp >= systolic_bp",
    "pp_zero": f"diastolic_bp < systolic_bp AND {_PP} <= 2 AND {_TAME3}",
    "buncr_ratio_impossible": f"creatinine > 0 AND {_RATIO} < 1",
    "rr_spo2_impossible": "respiratory_rate <= 3 AND spo2 >= 98",
    "fatal_constellation_impossible": f"{_N_FATAL} >= 3 AND {_FATAL_VITAL} AND NOT {_DISTURBED}",
    "preg_male": "icd9 = 'Pregnancy' AND gender = 'M'",
    "preg_age": "icd9 = 'Pregnancy' AND (age < 8 OR age > 60)",
    "pp_low": f"diastolic_bp < systolic_bp AND NOT ({_PP} <= 2 AND {_TAME3}) AND {_PP} < 5 AND {_nm('heartrate')} AND {_nm('respiratory_rate')} AND {_nm('spo2')} AND {_nm('systolic_bp')}",
    "pp_wide": f"{_PP} > 150 AND systolic_bp < 200 AND age < 60",
    "pp_htn_narrow": f"diastolic_bp < systolic_bp AND systolic_bp >= 200 AND {_PP} < 10",
    "buncr_ratio_high": f"creatinine > 0 AND {_RATIO} > 100 AND blood_urea_nitro > 80 AND hemoglobin >= 11",
    "low_cr": "creatinine <= 0.1 AND age >= 18",
    "comp_anemia": f"hemoglobin <= 5 AND {_nm('heartrate')} AND systolic_bp < 90 AND respiratory_rate <= 22",
    "comp_shock": f"systolic_bp < 50 AND {_nm('heartrate')} AND respiratory_rate <= 22",
    "comp_hyperk": f"potassium >= 7.5 AND {_nm('heartrate')} AND creatinine < 1",
    "comp_hypona": "sodium < 110 AND systolic_bp < 90 AND (heartrate < 60 OR heartrate > 120)",
    "pair_cardiogenic": f"heartrate <= 40 AND systolic_bp <= 60 AND {_ne('spo2')} AND {_ne('respiratory_rate')}",
    "pair_htn_brady": "systolic_bp >= 200 AND heartrate <= 40",
    "pair_tachy_htn": "heartrate >= 150 AND systolic_bp >= 200",
    "fatal_constellation_suspicious": f"{_N_FATAL} >= 3 AND {_FATAL_VITAL} AND {_DISTURBED}",
    "extreme_count": f"{_N_EXTREME} >= 5",
    "elderly_f_highhb": "age > 60 AND gender = 'F' AND hemoglobin >= 18",
    "preg_hb": "icd9 = 'Pregnancy' AND hemoglobin > 15",
    "pregnancy_elective": "icd9 = 'Pregnancy' AND admission_type = 'ELECTIVE'",
    "unknown_extremelabs": "icd9 = 'UNKNOWN' AND (coalesce(bnp = 'Critical', FALSE) OR coalesce(creatinine >= 8, FALSE) OR coalesce(potassium >= 7.5, FALSE) OR coalesce(hemoglobin <= 5, FALSE))",
    "circ_nomarkers": f"icd9 = 'Circulatory system' AND cholesterol = 'Lowrisk' AND bnp = 'Normal' AND {_nm('heartrate')} AND {_nm('systolic_bp')}",
    "nut_chol_maln": "cholesterol = 'Highrisk' AND bmi = 'Underweight' AND albumin = 'Low' AND hemoglobin <= 7",
    "nut_obese_hypo": "bmi IN ('Obese', 'Morbidly obese') AND systolic_bp <= 90 AND albumin = 'Low' AND bnp = 'Normal'",
    "alb_obese_anemia": f"albumin = 'Low' AND bmi IN ('High', 'Obese', 'Morbidly obese') AND hemoglobin <= 5 AND NOT coalesce(icd9 IN {_WASTE}, FALSE)",
    "alb_high_underwt": "albumin = 'High' AND bmi = 'Underweight'",
    "alb_high_wasting": f"albumin = 'High' AND icd9 IN {_WASTE}",
    "severe_hypok": f"potassium <= 2 AND {_nm('heartrate')}",
}
_BUCKET = {r.name: r.bucket for r in rules.RULES}


def _tag_list(bucket: str) -> str:
    picked = [n for n in RULE_PREDICATES if _BUCKET[n] == bucket]
    cases = ", ".join(f"CASE WHEN {RULE_PREDICATES[n]} THEN '{n}' END" for n in picked)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)" if picked else "CAST([] AS VARCHAR[])"


RULED_SQL = f"""{v.RECORDS_SQL},
ruled AS (SELECT *, {_tag_list('impossible')} AS imp, {_tag_list('suspicious')} AS sus FROM synthetic),
flagged AS (SELECT *, len(imp) > 0 AS impossible, len(sus) > 0 AS suspicious, len(imp) + len(sus) > 0 AS any_rule FROM ruled),
detail AS (SELECT {KEY_SQL}, ID, 'impossible' AS category, unnest(imp) AS rule FROM ruled
           UNION ALL SELECT {KEY_SQL}, ID, 'suspicious', unnest(sus) FROM ruled),
file_rates AS (SELECT {KEY_SQL}, count(*) AS n_rows, count_if(impossible) AS n_impossible, count_if(suspicious) AS n_suspicious,
                 count_if(any_rule) AS n_any, avg(CAST(impossible AS INT)) AS impossible_rate,
                 avg(CAST(suspicious AS INT)) AS suspicious_rate, avg(CAST(any_rule AS INT)) AS any_rate,
                 CAST(sum(len(imp)) AS BIGINT) AS impossible_violations, CAST(sum(len(sus)) AS BIGINT) AS suspicious_violations
               FROM flagged GROUP BY ALL)"""


def masked_records(spark: SparkSession, folder: str, ids: bool = False, inputs: dict[str, str] | None = None, generations: list[int] | None = None) -> DataFrame:
    return rules.apply_rules(v.records(spark, folder, "synthetic", ids, inputs, generations))


@query(f"WITH {RULED_SQL} SELECT {KEY_SQL}, ID, array_to_string(imp, '; ') AS impossible_tags, array_to_string(sus, '; ') AS suspicious_tags FROM flagged WHERE any_rule")
def rule_flags(spark: SparkSession, folder: str) -> DataFrame:
    masked = rules.flags(masked_records(spark, folder, ids=True)).filter("any_rule")
    return rules.tags(masked).select(*KEYS, "ID", "impossible_tags", "suspicious_tags")


@query(f"""WITH {RULED_SQL}
SELECT {KEY_SQL}, ID, 'Expert_impossible' AS metric FROM flagged WHERE impossible
UNION ALL SELECT {KEY_SQL}, ID, 'Expert_suspicious' FROM flagged WHERE suspicious
UNION ALL SELECT {KEY_SQL}, ID, 'Expert_any' FROM flagged WHERE any_rule""")
def rule_flag_ids(spark: SparkSession, folder: str) -> DataFrame:
    return rules.flag_rows(masked_records(spark, folder, ids=True), [*KEYS, "ID"])


@query(f"WITH {RULED_SQL} SELECT {KEY_SQL}, ID, category, rule FROM detail")
def rule_detail(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_rows(masked_records(spark, folder, ids=True), [*KEYS, "ID"])


_DESCRIBED = ", ".join(f"('{r.name}', '{r.description}')" for r in rules.RULES)


@query(f"""WITH {RULED_SQL}, described(rule, description) AS (VALUES {_DESCRIBED})
SELECT category AS bucket, rule, count(*) AS count,
       {_half_even("100.0::DOUBLE * count(*) / (SELECT count(*) FROM synthetic) * 1000.0::DOUBLE")} / 1000.0::DOUBLE AS pct_rows, description
FROM detail JOIN described USING (rule) GROUP BY category, rule, description""")
def rule_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_summary(masked_records(spark, folder))


@query(f"""WITH {RULED_SQL}
SELECT {KEY_SQL}, n_rows, n_impossible, n_suspicious, n_any, {s6('impossible_rate')}, {s6('suspicious_rate')}, {s6('any_rate')},
       impossible_violations, suspicious_violations, impossible_violations + suspicious_violations AS any_violations FROM file_rates""")
def rule_rates_by_file(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.rule_rates(masked_records(spark, folder), KEYS)
    return out.select(
        *KEYS, "n_rows", "n_impossible", "n_suspicious", "n_any", r6("impossible_rate"), r6("suspicious_rate"),
        r6("any_rate"), "impossible_violations", "suspicious_violations", "any_violations",
    )


_RATE_LONG = " UNION ALL ".join(
    f"SELECT generator, generation, '{label}' AS metric, {column} AS value FROM file_rates"
    for label, column in (("Expert_impossible", "impossible_rate"), ("Expert_suspicious", "suspicious_rate"), ("Expert_any", "any_rate"))
)


def rule_rates_long(rates: DataFrame) -> DataFrame:
    return rates.withColumnsRenamed(
        {"impossible_rate": "Expert_impossible", "suspicious_rate": "Expert_suspicious", "any_rate": "Expert_any"}
    ).unpivot(KEYS, ["Expert_impossible", "Expert_suspicious", "Expert_any"], "metric", "value")


@query(f"WITH {RULED_SQL}, {T_CTE}, rate_long AS ({_RATE_LONG}) {pooled_sql('rate_long', 'generator, generation, metric', 'value')}")
def rule_rates_by_generation(spark: SparkSession, folder: str) -> DataFrame:
    rates = rule_rates_long(rules.rule_rates(masked_records(spark, folder), KEYS))
    keys = ["generator", "generation", "metric"]
    return pooled_out(pooling.pooled(rates, keys, "value"), keys)


ZERO_FILLED_SQL = f"""
fired AS (SELECT {KEY_SQL}, rule, count(*) AS k FROM detail GROUP BY ALL),
grid AS (SELECT f.generator, f.dseed, f.mseed, f.generation, r.rule
         FROM (SELECT DISTINCT {KEY_SQL} FROM synthetic) f
         JOIN (SELECT DISTINCT generator, generation, rule FROM fired) r USING (generator, generation)),
filled AS (SELECT grid.*, coalesce(k, 0) AS k FROM grid LEFT JOIN fired USING ({KEY_SQL}, rule))"""


@query(f"""WITH {RULED_SQL}, {T_CTE}, {ZERO_FILLED_SQL}
SELECT generator, generation, rule, {s6('mean')}, {s6('mean - coalesce(tcrit, 0) * sd / sqrt(n)', 'low')},
       {s6('mean + coalesce(tcrit, 0) * sd / sqrt(n)', 'high')}, {s6('sd')}, n
FROM (SELECT generator, generation, rule, avg(k) AS mean, coalesce(stddev_samp(k), 0) AS sd, count(*) AS n FROM filled GROUP BY ALL) g
LEFT JOIN tq ON tq.df = g.n - 1""")
def rule_counts_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    masked = masked_records(spark, folder)
    counts = rules.rule_counts(masked, KEYS)
    files = masked.select(*KEYS).distinct()
    out = pooling.zero_filled_counts(counts, files, ["generator", "generation"], ["dseed", "mseed"], "rule", "n")
    return out.select("generator", "generation", "rule", r6("mean"), r6("low"), r6("high"), r6("sd"), "n")


# ------------------------------------------------- range check and silence
_RANGE_BOUNDS = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in m.RANGE_CHECK_NUMERIC)
_POP_LEVELS = ", ".join(f"list(DISTINCT {c}) AS lv_{c}" for c in m.RANGE_CHECK_CATEGORICAL)
_OFFENDERS = ", ".join(
    [f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN '{c}' END" for c in m.RANGE_CHECK_NUMERIC]
    + [f"CASE WHEN {c} IS NOT NULL AND NOT list_contains(lv_{c}, {c}) THEN '{c}' END" for c in m.RANGE_CHECK_CATEGORICAL]
)
OUT_OF_POPULATION_SQL = f"""WITH {v.RECORDS_SQL},
pop AS (SELECT {_RANGE_BOUNDS}, {_POP_LEVELS} FROM records WHERE role = 'population'),
checked AS (SELECT {KEY_SQL}, ID, array_to_string(list_filter([{_OFFENDERS}], lambda x: x IS NOT NULL), '; ') AS offenders FROM synthetic, pop)
SELECT * FROM checked WHERE offenders <> ''"""


def _out_of_population(spark: SparkSession, folder: str, literal_limit: int) -> DataFrame:
    population = v.records(spark, folder, "population")
    pop = novelty.Population.learn(population, m.RANGE_CHECK_NUMERIC, [])
    levels = novelty.feature_levels(population, m.RANGE_CHECK_CATEGORICAL)
    out = rules.out_of_population(
        v.records(spark, folder, "synthetic", ids=True), pop.bounds, levels, [*KEYS, "ID"], literal_limit=literal_limit
    )
    return out.filter(F.col("offenders") != "")


@query(OUT_OF_POPULATION_SQL)
def out_of_population(spark: SparkSession, folder: str) -> DataFrame:
    return _out_of_population(spark, folder, literal_limit=5000)


@query(OUT_OF_POPULATION_SQL)
def out_of_population_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The form for level sets too large for a literal set."""
    return _out_of_population(spark, folder, literal_limit=0)


_HAS = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in m.FEATURES)
_ALL_NULL = ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in m.FEATURES)
_ROW = ", ".join(m.FEATURES)
SILENT_SQL = f"""{v.CALM_SQL},
judged AS (SELECT *, len({_tag_list('impossible')}) + len({_tag_list('suspicious')}) AS fired FROM synthetic),
quiet AS (SELECT {KEY_SQL} FROM judged GROUP BY ALL HAVING sum(fired) = 0),
evidence AS (
  SELECT {KEY_SQL}, count(*) AS n_rows, count(DISTINCT ({_ROW})) AS unique_rows, CAST(sum({_HAS}) AS BIGINT) AS usable,
         array_to_string(list_filter([{_ALL_NULL}], lambda x: x IS NOT NULL), ';') AS all_null_columns
  FROM judged SEMI JOIN quiet USING ({KEY_SQL}) GROUP BY ALL),
diagnosis AS (
  SELECT {KEY_SQL}, n_rows, unique_rows,
    {_half_even('100.0::DOUBLE * unique_rows / n_rows * 1000.0::DOUBLE')} / 1000.0::DOUBLE AS unique_row_pct,
    {_half_even('100.0::DOUBLE * usable / (n_rows * 23) * 1000.0::DOUBLE')} / 1000.0::DOUBLE AS usable_value_pct,
    all_null_columns, '' AS numeric_stored_as_text, '' AS missing_columns,
    CASE WHEN usable / (n_rows * 23) < 0.5 THEN 'unusable values — rate is NOT a real zero'
         WHEN all_null_columns <> '' THEN 'all-NaN columns (' || len(string_split(all_null_columns, ';')) || ') — those rules cannot fire'
         WHEN unique_rows <= greatest(5, 0.001 * n_rows) THEN 'mode collapse — few unique rows'
         ELSE 'values usable and varied — no rule triggered' END AS likely_cause
  FROM evidence)"""


def _diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return rules.diagnose_silent(rules.apply_rules(v.records(spark, folder, "synthetic", inputs=v.CALM)), KEYS)


@query(f"WITH {SILENT_SQL} SELECT * FROM diagnosis")
def silent_file_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnosis(spark, folder)


@query(f"WITH {SILENT_SQL} SELECT generator, dseed, mseed, count(*) AS silent_files, min(generation) AS first_silent_generation FROM diagnosis GROUP BY ALL")
def silent_files_by_chain(spark: SparkSession, folder: str) -> DataFrame:
    return rules.silent_by_folder(_diagnosis(spark, folder), v.CHAIN)
