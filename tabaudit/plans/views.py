"""Audit-shaped views over the test tables.

``records``     all 23 features of generated, training and population rows
``profile``     a narrow record table for novelty and copies
``trajectory``  per-chain metric trajectories with gaps
``review``      records with rule flags and partial external review
``patch``       corrections to some trajectory metrics

Record IDs are numbered only on request (``ids=True``), as they cost a shuffle.
Each view has a Spark builder and the same definition as SQL text (``*_SQL``)
for the independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.keys import chain_label
from tabaudit.operators.ids import number_within
from tabaudit.sources.scans import spread

FILE = ["generator", "dseed", "mseed", "generation"]
CHAIN = ["generator", "dseed", "mseed"]
# Order keys per slice when rows of a file are numbered.
ORDER_SLICE = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BASE = "CASE l_returnflag WHEN 'A' THEN 'ARF' WHEN 'N' THEN 'CTGAN' ELSE 'DDPM' END"
_VARIANT = "CASE l_linestatus WHEN 'O' THEN 'full' ELSE 'core' END"
_ROLE = "CASE l_orderkey % 10 WHEN 0 THEN 'population' WHEN 1 THEN 'training' ELSE 'synthetic' END"
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _keyed_lines(spark: SparkSession, folder: str, columns: list[str], ids: bool, generations: list[int] | None = None) -> DataFrame:
    lines = table(spark, folder, "lineitem").selectExpr(
        *LINE_ORDER, f"{_BASE} AS base_generator", f"{_VARIANT} AS variant",
        "l_suppkey % 3 AS dseed", "l_suppkey % 5 AS mseed", "CAST(l_linenumber - 1 AS BIGINT) AS generation",
        f"{_ROLE} AS role", f"{_BASE} || CASE WHEN l_linestatus = 'O' THEN '' ELSE '_CORE' END AS generator",
    )
    if generations is not None:
        # whole files drop out, so the IDs of the others are what they were
        lines = lines.filter(F.col("generation").isin(generations))
    if not ids:
        numbered = spread(lines, "l_orderkey", "l_partkey").withColumn("ID", F.lit(None).cast("bigint"))
    else:
        numbered = number_within(lines, FILE, LINE_ORDER, f"floor(l_orderkey / {ORDER_SLICE})")
    orders = table(spark, folder, "orders").select("o_orderkey", *columns)
    return numbered.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def profile(spark: SparkSession, folder: str, role: str | None = None, ids: bool = False) -> DataFrame:
    rows = _keyed_lines(spark, folder, ["o_orderpriority", "o_orderstatus"], ids).select(
        *FILE, "base_generator", "variant", "role", "ID",
        F.col("l_quantity").alias("n1"), F.col("l_discount").alias("n2"), F.col("l_tax").alias("n3"),
        F.col("o_orderpriority").alias("c1"), F.col("o_orderstatus").alias("c2"),
    )
    return rows.filter(F.col("role") == role) if role else rows


PROFILE_NUMERIC, PROFILE_CATEGORICAL = ["n1", "n2", "n3"], ["c1", "c2"]

_GENERATOR_SQL = "base_generator || CASE WHEN variant = 'core' THEN '_CORE' ELSE '' END AS generator"

PROFILE_SQL = f"""
profile AS (SELECT {_GENERATOR_SQL}, * FROM (
  SELECT {_BASE} AS base_generator, {_VARIANT} AS variant, l_suppkey % 3 AS dseed, l_suppkey % 5 AS mseed,
         CAST(l_linenumber - 1 AS BIGINT) AS generation, {_ROLE} AS role,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey % 3, l_suppkey % 5, l_linenumber
                            ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS ID,
         l_quantity AS n1, l_discount AS n2, l_tax AS n3, o_orderpriority AS c1, o_orderstatus AS c2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) v)"""

# Feature expressions over o, p, s, q, c (order, part, supplier, quantity, price in cents).
_CRISIS = "c % 17 = 0"
_FEATURES = {
    "readmission": "(p + q) % 8 = 0",
    "prior_icu": "(o + q) % 5 = 0",
    "age": "CASE WHEN c % 23 = 0 THEN NULL ELSE 5 + (p + o) % 92 END",
    "gender": "CASE WHEN (o + q) % 2 = 0 THEN 'M' ELSE 'F' END",
    "icd9": "CASE (p + 3 * q) % 9 WHEN 0 THEN 'Pregnancy' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'Neoplasms' "
            "WHEN 3 THEN 'Digestive' WHEN 4 THEN NULL WHEN 5 THEN 'Respiratory' ELSE 'Circulatory system' END",
    "ethnicity": "CASE (o + p) % 4 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'BLACK' WHEN 2 THEN 'ASIAN' ELSE 'OTHER' END",
    "admission_type": "CASE WHEN c % 211 = 0 THEN 'WALKIN' WHEN q % 3 = 0 THEN 'ELECTIVE' WHEN q % 3 = 1 THEN 'EMERGENCY' ELSE 'URGENT' END",
    "first_careunit": "CASE p % 5 WHEN 0 THEN 'CCU' WHEN 1 THEN 'CSRU' WHEN 2 THEN 'MICU' WHEN 3 THEN 'SICU' ELSE 'TSICU' END",
    "bmi": "CASE (o + c) % 7 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Underweight' WHEN 3 THEN 'High' "
           "WHEN 4 THEN 'Obese' WHEN 5 THEN 'Morbidly obese' ELSE NULL END",
    "bnp": "CASE (p + c) % 4 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Acute' ELSE 'Critical' END",
    "cholesterol": "CASE (q + c) % 4 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Lowrisk' WHEN 2 THEN 'Intermediate' ELSE 'Highrisk' END",
    "albumin": "CASE (o + 2 * c) % 4 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Low' WHEN 2 THEN 'Normal' ELSE 'High' END",
    "blood_urea_nitro": "CASE WHEN c % 31 = 0 THEN 50 + (p * 5) % 400 ELSE 4 + c % 40 END",
    "glucose": f"CASE WHEN {_CRISIS} THEN 3 + (o * 11) % 2700 ELSE 70 + c % 120 END",
    "sodium": f"CASE WHEN c % 37 = 0 OR {_CRISIS} THEN 88 + (p * 3) % 115 ELSE 134 + c % 13 END",
    "respiratory_rate": f"CASE WHEN c % 11 = 0 OR {_CRISIS} THEN 2 + (p * 13) % 105 ELSE 11 + c % 12 END",
    "heartrate": f"CASE WHEN c % 19 = 0 THEN NULL WHEN {_CRISIS} THEN 10 + (p + o) % 255 ELSE 55 + c % 55 END",
    "systolic_bp": f"CASE WHEN {_CRISIS} OR c % 41 = 0 THEN 25 + (p * 3 + q) % 240 ELSE 85 + (c + q) % 70 END",
    "diastolic_bp": "CASE WHEN c % 13 = 0 THEN 8 + (p * 7) % 200 ELSE 50 + (c * 3 + q) % 35 END",
    "spo2": f"CASE WHEN {_CRISIS} THEN 28 + (p * 17) % 74 ELSE 93 + c % 8 END",
    "creatinine": f"CASE WHEN c % 43 = 0 THEN 1 + (p * 9) % 320 WHEN {_CRISIS} THEN 1 + (p * 9) % 220 WHEN c % 47 = 0 THEN 1 ELSE 6 + c % 10 END / CAST(10 AS DOUBLE)",
    "potassium": f"CASE WHEN {_CRISIS} OR c % 53 = 0 THEN 8 + (q * 3 + p) % 115 ELSE 34 + c % 18 END / CAST(10 AS DOUBLE)",
    "hemoglobin": f"CASE WHEN c % 29 = 0 THEN 10 + (p + q) % 60 WHEN {_CRISIS} THEN 10 + (p * 7) % 250 ELSE 90 + c % 95 END / CAST(10 AS DOUBLE)",
}


# Folded inputs: few distinct records, of which the population knows two thirds of the prices' range,
# so that novelty over all features is partial at any scale factor.
FOLDED = {"o": "o % 3", "p": "p % 3", "q": "q % 2", "c": "c % CASE role WHEN 'population' THEN 40 ELSE 60 END"}
# Calm inputs: files of some chains that break no rule, by one repeated row, by few varied rows, or with a column that is never filled.
_CALM = "(dseed + mseed) % 3 = 2 AND generation % 4 < 3"
CALM = {n: f"CASE WHEN {_CALM} THEN {e} ELSE {n} END" for n, e in {"o": "4", "p": "5", "q": "0", "c": "CASE generation % 4 WHEN 0 THEN 5 WHEN 1 THEN 1 + c % 16 ELSE 23 END"}.items()}


def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that have an order, by file, in the columns that ``numbered`` and ``features`` need.

    Where every line has exactly one order, as it should, the join changes nothing: only keys are shuffled to see that.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey")
    met = F.col("l_orderkey") == F.col("o_orderkey")
    counted = orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("__n"))
    if not lines.select("l_orderkey").distinct().join(counted, met, "left").filter("__n IS NULL OR __n > 1").isEmpty():
        lines = lines.join(orders, met)
    return lines.selectExpr(
        f"{_BASE} || CASE WHEN {_VARIANT} = 'core' THEN '_CORE' ELSE '' END AS generator",
        "l_suppkey % 3 AS dseed", "l_suppkey % 5 AS mseed", "CAST(l_linenumber - 1 AS BIGINT) AS generation", *LINE_ORDER,
    )


def numbered(lines: DataFrame) -> DataFrame:
    """``file_lines`` with their IDs, file by file in the order of IDs; a file is numbered in one task, as it is written in one."""
    return lines.withColumns({
        "ID": F.row_number().over(Window.partitionBy(*FILE).orderBy(*LINE_ORDER)).cast("bigint"),
        "base_generator": F.split_part("generator", F.lit("_"), F.lit(1)),
        "variant": F.expr("CASE WHEN generator LIKE '%CORE' THEN 'core' ELSE 'full' END"), "role": F.expr(_ROLE),
    })


def records(spark: SparkSession, folder: str, role: str | None = None, ids: bool = False, inputs: dict[str, str] | None = None, generations: list[int] | None = None) -> DataFrame:
    return features(_keyed_lines(spark, folder, [], ids, generations), role, inputs)


def features(lines: DataFrame, role: str | None = None, inputs: dict[str, str] | None = None) -> DataFrame:
    """The records that numbered lines stand for."""
    rows = lines.selectExpr(
        *FILE, "base_generator", "variant", "role", "ID", "l_orderkey AS o", "l_partkey AS p", "l_suppkey AS s",
        "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_extendedprice * 100) AS BIGINT) AS c",
    )
    if role:
        rows = rows.filter(F.col("role") == role)
    if inputs:
        rows = rows.withColumns({n: F.expr(e) for n, e in inputs.items()})
    return rows.selectExpr(
        *FILE, "base_generator", "variant", "role", "ID", *[f"{e} AS {n}" for n, e in _FEATURES.items()]
    )


_FEATURES_SQL = ",\n  ".join(f"{e} AS {n}" for n, e in _FEATURES.items())
RECORDS_SQL = f"""
lines AS (
  SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln, l_discount AS disc, l_tax AS tax,
         {_BASE} AS base_generator, {_VARIANT} AS variant, l_suppkey % 3 AS dseed, l_suppkey % 5 AS mseed,
         CAST(l_linenumber - 1 AS BIGINT) AS generation, {_ROLE} AS role,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
records AS (SELECT {_GENERATOR_SQL}, base_generator, variant, dseed, mseed, generation, role,
  row_number() OVER (PARTITION BY base_generator, variant, dseed, mseed, generation ORDER BY o, p, s, c, q, disc, tax) AS ID,
  {_FEATURES_SQL}
  FROM lines),
synthetic AS (SELECT * FROM records WHERE role = 'synthetic')"""
_ID_SQL = "row_number() OVER (PARTITION BY base_generator, variant, dseed, mseed, generation ORDER BY o, p, s, c, q, disc, tax) AS ID"


def records_sql(inputs: dict[str, str]) -> str:
    """``RECORDS_SQL`` over changed inputs; IDs are numbered as without the change."""
    changed = ", ".join(f"{e} AS {n}" for n, e in inputs.items())
    steps = f"numbered AS (SELECT *, {_ID_SQL} FROM lines),\nchanged AS (SELECT * REPLACE ({changed}) FROM numbered),\nrecords AS ("
    return RECORDS_SQL.replace(f"{_ID_SQL},", "ID,").replace("FROM lines)", "FROM changed)").replace("records AS (", steps, 1)


FOLDED_SQL, CALM_SQL = records_sql(FOLDED), records_sql(CALM)


# A chain's label is rarer with every generation, at a pace of its own (some keep it), and its signal fades
# likewise, so both kinds of failure come early, late or never at any scale factor.
_POSITIVE = "value > 35 + 4 * generation * ((dseed + mseed + user_id % 4) % 6)"
_SIGNAL = "(100 + 2 * generation * ((dseed + mseed) % 4))"


def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """Wide trajectory: n_rows, flag_rate, positive_share and auroc_like per chain and generation.

    Users are folded to three data and five model seeds, as in the crossed design.
    """
    unit = F.floor(F.col("user_id") / F.lit(4.0)).cast("bigint")
    return (
        table(spark, folder, "events")
        .select(
            F.expr("CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END").alias("generator"),
            (unit % 3).alias("dseed"), (unit % 5).alias("mseed"),
            F.floor((F.dayofmonth("ts") - 1) * 20 / F.lit(30.0)).cast("int").alias("generation"),
            "event_type", "value", "user_id",
        )
        .groupBy(*FILE)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg((F.col("event_type") == "error").cast("double")).alias("flag_rate"),
            F.avg(F.expr(_POSITIVE).cast("double")).alias("positive_share"),
            (F.avg("value") / F.first(F.expr(_SIGNAL)).cast("double")).alias("auroc_like"),
        )
    )


TRAJECTORY_SQL = f"""
trajectory AS (
  SELECT generator, dseed, mseed, generation, count(*) AS n_rows,
         avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) AS flag_rate,
         avg(CASE WHEN {_POSITIVE} THEN 1e0 ELSE 0e0 END) AS positive_share,
         avg(value) / CAST(any_value({_SIGNAL}) AS DOUBLE) AS auroc_like
  FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END AS generator,
               CAST(floor(user_id / CAST(4 AS DOUBLE)) AS BIGINT) % 3 AS dseed,
               CAST(floor(user_id / CAST(4 AS DOUBLE)) AS BIGINT) % 5 AS mseed,
               CAST(floor((extract(DAY FROM ts) - 1) * 20 / CAST(30 AS DOUBLE)) AS INT) AS generation, event_type, value, user_id
        FROM events) e
  GROUP BY generator, dseed, mseed, generation)"""

TRAJECTORY_METRICS = ["flag_rate", "positive_share", "auroc_like"]
# Thresholds of the onset queries on the trajectory metrics.
ONSETS = {"flag_rate": (0.05, "increase"), "positive_share": (0.0478, "decrease"), "auroc_like": (0.0254, "increase")}


def minority(wide: DataFrame) -> DataFrame:
    return wide.select(*FILE, F.least(F.col("positive_share"), 1.0 - F.col("positive_share")).alias("value"))


def metric_rows(wide: DataFrame, name: str) -> DataFrame:
    return wide.select(*FILE, F.col(name).alias("value"))


def tidy_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory(spark, folder).unpivot(FILE, TRAJECTORY_METRICS, "metric", "value")


TIDY_SQL = TRAJECTORY_SQL + """,
tidy AS (
  SELECT generator, dseed, mseed, generation, 'flag_rate' AS metric, flag_rate AS value FROM trajectory
  UNION ALL SELECT generator, dseed, mseed, generation, 'positive_share', positive_share FROM trajectory
  UNION ALL SELECT generator, dseed, mseed, generation, 'auroc_like', auroc_like FROM trajectory)"""


def review(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: rule flag and, where reviewed, the reviewer's flag."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("folder"), (F.col("doc_id") % 20).alias("generation"), F.col("doc_id").alias("ID"),
        "lang", "n_chars",
        ((F.col("n_chars") < 200) | (F.col("n_chars") > 12000)).alias("rule_flag"),
        (F.col("toxic") == 1).alias("reviewer_flag"), F.col("toxic").isNotNull().alias("reviewed"),
    )


REVIEW_SQL = """
review AS (
  SELECT source AS folder, doc_id % 20 AS generation, doc_id AS ID, lang, n_chars,
         (n_chars < 200 OR n_chars > 12000) AS rule_flag, toxic = 1 AS reviewer_flag, toxic IS NOT NULL AS reviewed
  FROM documents LEFT JOIN labels USING (doc_id))"""


def patch(spark: SparkSession, folder: str) -> DataFrame:
    """Long patch: flag_rate is corrected for every fifth model seed, extra_cost is new."""
    wide = trajectory(spark, folder).filter(F.col("mseed") % 5 == 0)
    return wide.select(
        *FILE,
        F.inline(
            F.array(
                F.struct(
                    F.lit("flag_rate").alias("metric_name"),
                    F.when(F.col("generation") % 2 == 0, F.col("flag_rate") / 2).alias("metric_value"),
                ),
                F.struct(F.lit("extra_cost").alias("metric_name"), F.col("n_rows").cast("double").alias("metric_value")),
            )
        ),
    )


PATCH_SQL = TRAJECTORY_SQL + """,
patch AS (
  SELECT generator, dseed, mseed, generation, 'flag_rate' AS metric_name,
         CASE WHEN generation % 2 = 0 THEN flag_rate / 2 END AS metric_value FROM trajectory WHERE mseed % 5 = 0
  UNION ALL
  SELECT generator, dseed, mseed, generation, 'extra_cost', CAST(n_rows AS DOUBLE) FROM trajectory WHERE mseed % 5 = 0)"""


def label_of_chain(df: DataFrame) -> DataFrame:
    return df.withColumn("chain", chain_label(F.col("dseed"), F.col("mseed")))
