"""The whole audit as a sequence of stage tables.

Each stage reads tables, writes one table per result and can be rerun on its
own.  What a table holds is declared below: a stage that would write something
else fails before it runs, and one that broke off is an error for whoever reads
it.  Flags of records are bucketed by record, so flag tables meet each other
without a shuffle, and have a folder per metric.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.operators import events, labels, novelty, onset, pooling, rules, trajectories
from tabaudit.sources.stage_tables import Contract, StageStore

FILE = ["generator", "folder", "dseed", "mseed", "generation"]
RECORD = ("folder", "generation", "ID")
_CHAIN = {"generator": "string", "dseed": "bigint", "mseed": "bigint"}
_FILE = {"generator": "string", "folder": "string", "dseed": "bigint", "mseed": "bigint", "generation": "int"}
_FLAG = _FILE | {"ID": "bigint", "metric": "string"}
_STATISTICS = {c: "double" for c in ("mean", "var", "low", "high", "min", "max")} | {"n": "bigint"}
_POOLED = {"generator": "string", "generation": "int", "bin": "int", "metric": "string"} | _STATISTICS | {"step": "string"}


def _doubles(*names: str) -> dict[str, str]:
    return {n: "double" for n in names}


def _counts(*names: str) -> dict[str, str]:
    return {n: "bigint" for n in names}


def contracts(buckets: int) -> list[Contract]:
    """All stage tables of the audit."""
    by_record = {"bucket_by": RECORD, "buckets": buckets}
    flags = {"columns": _FLAG, "keys": (*RECORD, "metric"), "partition_by": ("metric",), **by_record}
    return [
        *[Contract(name, **flags) for name in PARTS["flags"]],
        Contract("rule_detail", _FILE | {"ID": "bigint", "category": "string", "rule": "string"}, keys=(*RECORD, "rule"), **by_record),
        Contract("novelty_rates", _FILE | {"n_rows": "bigint", "bin": "int", "n_novel": "bigint"} | _doubles("novelty_rate", "novelty_adjusted"), keys=("folder", "generation", "bin")),
        Contract("copy_rates", _FILE | _counts("n_rows", "n_copies") | _doubles("copy_rate"), keys=("folder", "generation")),
        *[Contract(name, _POOLED, keys=("generator", "generation", "bin", "metric")) for name in PARTS["summary"]],
        Contract(
            "rule_rates", _FILE | _counts("n_rows", "n_impossible", "n_suspicious", "n_any") | _doubles("impossible_rate", "suspicious_rate", "any_rate")
            | _counts("impossible_violations", "suspicious_violations", "any_violations"), keys=("folder", "generation"),
        ),
        Contract("rule_counts", _FILE | {"category": "string", "rule": "string", "n": "bigint"}, keys=("folder", "generation", "rule")),
        Contract("rule_summary", {"generator": "string", "generation": "int", "rule": "string"} | _doubles("mean", "low", "high", "sd") | _counts("n"), keys=("generator", "generation", "rule")),
        Contract(
            "silent_files", _FILE | _counts("n_rows", "unique_rows") | _doubles("unique_row_pct", "usable_value_pct")
            | {c: "string" for c in ("all_null_columns", "numeric_stored_as_text", "missing_columns", "likely_cause")}, keys=("folder", "generation"),
        ),
        Contract("file_sizes", _FILE | _counts("n_rows"), keys=("folder", "generation")),
        Contract("trajectories", _FILE | _counts("n_rows", "n_flagged") | _doubles("value") | {"metric": "string"}, keys=("folder", "generation", "metric"), partition_by=("metric",)),
        Contract("class_balance", _FILE | _counts("n_rows", "n_positive") | _doubles("positive_share", "minority_share") | _counts("n_classes"), keys=("folder", "generation")),
        Contract("onsets", _CHAIN | {"metric": "string", "onset_generation": "int", "step_size": "double", "crossed": "boolean", "n_observed_generations": "bigint"}, keys=(*_CHAIN, "metric"), partition_by=("metric",)),
        Contract("failure_events", _CHAIN | {"time": "int", "event": "int", "mechanism": "string", "n_tstr_datapoints": "bigint", "insufficient_tstr_data": "boolean"}, keys=tuple(_CHAIN)),
        Contract(
            "dissociation", _CHAIN | {"failure_time": "int", "failure_event": "int", "mechanism": "string", "onset_generation": "int", "onset_crossed": "boolean",
                                      "n_observed_generations": "bigint", "found_in": "string", "dissociation_category": "string"}, keys=tuple(_CHAIN),
        ),
    ]


#: Results that several stages write, each its own table.
PARTS = {"flags": ["novel_flags", "copy_flags", "rule_flags"], "summary": ["novelty_summary", "rule_rate_summary"]}


@dataclass
class Stages:
    """The stage tables of one audit below one root folder."""

    spark: SparkSession
    root: str
    buckets: int = 64
    store: StageStore = field(init=False)

    def __post_init__(self) -> None:
        self.store = StageStore(self.spark, self.root).declare(*contracts(self.buckets))

    def read(self, name: str) -> DataFrame:
        """A table, or all tables of a result that several stages write."""
        out: DataFrame | None = None
        for part in PARTS.get(name, [name]):
            rows = self.store.read(part)
            out = rows if out is None else out.unionByName(rows)
        return out

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.store.write(name, df)


def novelty_stage(
    stages: Stages, records: DataFrame, training: DataFrame, population: DataFrame,
    numeric: list[str], categorical: list[str], resolutions: list[int] = m.BIN_RESOLUTIONS,
) -> None:
    """Flag IDs, per-file rates and the pooled summary of novelty and copies."""
    pop = novelty.Population.learn(population, numeric, categorical).with_cardinality()
    flagged = novelty.novel_rows(records, pop, [*FILE, "ID"], resolutions)
    stages.write(flagged, "novel_flags")
    chain = ["generator", "dseed", "mseed"]
    copies = novelty.copied_rows(records, training, chain, numeric, categorical)
    stages.write(copies.select(*FILE, "ID", F.lit("Copy").alias("metric")), "copy_flags")
    rates = novelty.adjust_novelty(novelty.novelty_by_file(records, pop, FILE, resolutions), pop, resolutions)
    file_rates = stages.write(rates, "novelty_rates")
    copy_rates = stages.write(novelty.copy_counts(records, training, chain, FILE, numeric, categorical), "copy_rates")
    long = (
        file_rates.withColumnsRenamed({"novelty_rate": "HR", "novelty_adjusted": "HR_adjusted"})
        .unpivot(["generator", "generation", "bin"], ["HR", "HR_adjusted"], "metric", "value")
        .unionByName(copy_rates.selectExpr("generator", "generation", "CAST(NULL AS INT) AS bin", "'Copy' AS metric", "copy_rate AS value"))
    )
    summary = pooling.pooled(long, ["generator", "generation", "bin", "metric"], "value")
    stages.write(summary.withColumn("step", F.lit("novelty")), "novelty_summary")


def rule_stage(stages: Stages, records: DataFrame, rule_list: list[rules.Rule] = rules.RULES) -> None:
    """Flag IDs, rule detail, rates, zero-filled rule counts and the silent-file report."""
    masked = rules.apply_rules(records, rule_list)
    stages.write(rules.flag_rows(masked, [*FILE, "ID"]), "rule_flags")
    stages.write(rules.rule_rows(masked, [*FILE, "ID"], rule_list), "rule_detail")
    rates = stages.write(rules.rule_rates(masked, FILE), "rule_rates")
    counts = stages.write(rules.rule_counts(masked, FILE, rule_list), "rule_counts")
    zero_filled = pooling.zero_filled_counts(
        counts, rates.select(*FILE), ["generator", "generation"], ["dseed", "mseed"], "rule", "n"
    )
    stages.write(zero_filled, "rule_summary")
    stages.write(rules.diagnose_silent(masked, FILE), "silent_files")
    long = rates.withColumnsRenamed(
        {"impossible_rate": "Expert_impossible", "suspicious_rate": "Expert_suspicious", "any_rate": "Expert_any"}
    ).unpivot(["generator", "generation"], ["Expert_impossible", "Expert_suspicious", "Expert_any"], "metric", "value")
    summary = pooling.pooled(long, ["generator", "generation", "metric"], "value").withColumn("bin", F.lit(None).cast("int"))
    stages.write(summary.withColumn("step", F.lit("rules")), "rule_rate_summary")


def trajectory_stage(stages: Stages, records: DataFrame, reviewer_flags: DataFrame | None = None) -> None:
    """Per-chain trajectories of the flag rates, of rules and reviewer together, and of the minority share.

    ``reviewer_flags`` has the records that the reviewer flagged, where one was asked.
    """
    sizes = stages.write(records.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_rows")), "file_sizes")
    by_rule = stages.store.family("rule_flags", ["Expert_any"])
    parts = {
        "hr_b5": trajectories.chain_rates(stages.store.family("novel_flags", [f"HR_b{m.HEADLINE_BINS}"]), sizes, FILE),
        "expert_any": trajectories.chain_rates(by_rule, sizes, FILE),
    }
    if reviewer_flags is not None:
        parts["expert_llm"] = trajectories.combined_rates(by_rule, reviewer_flags, sizes, FILE).join(sizes, FILE)
    balance = stages.write(labels.class_balance(records, FILE), "class_balance")
    rows = balance.select(*FILE, "n_rows", F.lit(None).cast("bigint").alias("n_flagged"), F.col("minority_share").alias("value"), F.lit("minority_share").alias("metric"))
    for metric, part in parts.items():
        rows = rows.unionByName(part.select(*FILE, "n_rows", "n_flagged", "value", F.lit(metric).alias("metric")))
    stages.write(rows, "trajectories")


def event_stage(stages: Stages, utility: DataFrame, quality: DataFrame | None = None) -> None:
    """Onsets of all metrics, failure events and their categories.

    ``utility`` is the tidy AUROC trajectory, whose chains are the registry;
    ``quality`` further tidy trajectories named as in the onset registry.
    """
    keys = ["generator", "dseed", "mseed", "generation", "metric", "value"]
    rows = stages.read("trajectories").select(*keys)
    if quality is not None:
        rows = rows.unionByName(quality.select(*keys))
    registry = onset.chain_registry(utility)
    onsets = stages.write(onset.incline_onset(rows, registry), "onsets")
    minority = rows.filter(F.col("metric") == "minority_share")
    failures = stages.write(events.failure_events(utility, minority), "failure_events")
    joined = events.join_onset(failures, onsets.filter(F.col("metric") == "expert_any"))
    stages.write(events.dissociation(joined), "dissociation")
