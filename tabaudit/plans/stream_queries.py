"""The streaming operators over arrivals made from the test tables, in disorder, against their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.operators import novelty
from tabaudit.plans import record_queries as rq
from tabaudit.plans import statistic_queries as tq
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, long_of, r6, s6
from tabaudit.sources import sinks
from tabaudit.streaming import membership, stateful

registry = Registry()
query = registry.query
_PARTS = 3


def _folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _arrivals(rows: DataFrame, name: str, parts: list[str], whole: list[str] = []) -> DataFrame:
    """A stream of ``rows``: the rows of each condition come together, one after the other, those equal in ``whole`` in one file."""
    spark, path = rows.sparkSession, _folder(rows.sparkSession, name)
    for part in parts:
        some = rows.filter(part)
        some = some.repartition(*whole) if whole else some
        some.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 40).parquet(path)


@query(f"""WITH {rq.NOVEL_SQL} SELECT generator || '_' || dseed || '_' || mseed AS folder, CAST(generation AS BIGINT) AS generation, 'HR_b' || bin AS metric, ID FROM tested WHERE novel
UNION ALL SELECT * FROM (WITH {rq.COPY_SQL} SELECT generator || '_' || dseed || '_' || mseed, CAST(generation AS BIGINT), 'Copy', ID FROM hits) c""")
def stream_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Novelty and copies of records that come late, twice and out of order."""
    named = F.concat_ws("_", "generator", F.col("dseed").cast("string"), F.col("mseed").cast("string"))
    rows = sinks.reliable(v.profile(spark, folder, "synthetic", ids=True).withColumn("folder", named))
    # last generations first, some of them once more
    arrivals = _arrivals(rows, "arrivals", ["generation >= 4", "generation IN (1, 5)", "generation < 4"], membership.FILE)
    pop = novelty.Population.learn(v.profile(spark, folder, "population"), v.PROFILE_NUMERIC, v.PROFILE_CATEGORICAL)
    target = _folder(spark, "flags")
    membership.flag_arrivals(arrivals, pop, sinks.reliable(v.profile(spark, folder, "training")), v.CHAIN, target, _folder(spark, "state"))
    return spark.read.parquet(target).select("folder", long_of("generation"), "metric", "ID")


_FLAGGED = "CASE user_id % 4 WHEN 0 THEN 'ARF' WHEN 1 THEN 'CTGAN' WHEN 2 THEN 'DDPM' ELSE 'RTVAE' END"


@query(f"""SELECT {_FLAGGED} AS generator, epoch_ms(date_trunc('day', ts)) AS window_start, count(*) AS n_rows, count_if(event_type = 'error') AS n_flagged, {s6("count_if(event_type = 'error') / count(*)", 'rate')}
FROM events GROUP BY ALL""")
def stream_window_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Flag rates per day of events that come out of order, within the delay."""
    rows = v.table(spark, folder, "events").select(
        F.expr(_FLAGGED).alias("generator"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("flag")
    )
    # one far beyond the others closes all windows
    last = rows.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("generator"), F.expr("ts + INTERVAL 400 DAYS").alias("ts"), F.lit(False).alias("flag"))
    rows = sinks.reliable(rows.unionByName(last))
    arrivals = _arrivals(rows, "events", ["generator <> 'end' AND day(ts) >= 12", "generator <> 'end' AND day(ts) < 12", "generator = 'end'"])
    target = _folder(spark, "rates")
    stateful.run(stateful.window_rates(arrivals, "generator", "ts", "flag", "1 day", "60 days"), target, _folder(spark, "state"))
    found = spark.read.parquet(target).filter("kind = 'closed'")
    return found.select(F.col("key").alias("generator"), "window_start", "n_rows", "n_flagged", r6(F.col("n_flagged") / F.col("n_rows"), "rate"))


@query(f"""WITH {tq.INCLINE_SQL} SELECT metric, generator || '_' || dseed || '_' || mseed AS chain, CAST(onset_generation AS BIGINT) AS onset_generation, {s6('step_size')}, crossed FROM onsets WHERE n_observed_generations > 0""")
def stream_onsets(spark: SparkSession, folder: str) -> DataFrame:
    """Onsets of trajectories whose later half comes first."""
    named = F.concat_ws("_", "generator", F.col("dseed").cast("string"), F.col("mseed").cast("string"))
    tidy = v.tidy_trajectory(spark, folder).select("metric", named.alias("chain"), "generation", "value", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("generation") * 60).alias("ts"))
    end = spark.range(1).select(F.lit(next(iter(v.ONSETS))).alias("metric"), F.lit("end").alias("chain"), F.lit(0).alias("generation"), F.lit(0.0).alias("value"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    rows = sinks.reliable(tidy.unionByName(end))
    arrivals = _arrivals(rows, "trajectories", ["chain <> 'end' AND generation > 9", "chain <> 'end' AND generation <= 9", "chain = 'end'"])
    target = _folder(spark, "onsets")
    stateful.run(stateful.onsets(arrivals, "chain", "ts", v.ONSETS), target, _folder(spark, "state"))
    found = spark.read.parquet(target).filter("chain <> 'end' AND kind <> 'late'")
    return found.select("metric", "chain", "onset_generation", r6("step_size"), (F.col("kind") == "onset").alias("crossed"))
