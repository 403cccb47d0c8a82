"""Utility metric documents, quality metrics and raw-data patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.columns import safe_ratio
from tabaudit.functions.keys import chain_label, generator_of, variant_of
from tabaudit.operators.ids import assert_unique
from tabaudit.operators.pooling import pooled

_CELLS = ", ".join(f"{c}: double" for c in m.UTILITY_CELLS)
_BLOCK = "struct<" + ", ".join(f"{s}: double" for s in m.UTILITY_SCALARS) + f", confusion_matrix: struct<{_CELLS}>>"
# Schema of one utility document; unknown fields of a document are ignored.
UTILITY_SCHEMA = f"tstr_metrics {_BLOCK}, trtr_metrics {_BLOCK}"


def utility_metrics(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Flat utility metrics per document.

    Adds the rates a confusion matrix implies (null where their denominator is
    zero) and utility_gap, real-trained minus synthetic-trained AUROC.
    """
    out: list[Column] = []
    for block in ("tstr", "trtr"):
        root = f"{block}_metrics"
        for name in m.UTILITY_SCALARS:
            printed = "f1" if name == "f1_score" else name
            out.append(F.col(f"{root}.{name}").alias(f"{block}_{printed}"))
        tn, fp, fn, tp = (F.col(f"{root}.confusion_matrix.{c}") for c in m.UTILITY_CELLS)
        out += [c.alias(f"{block}_{n}") for n, c in zip(m.UTILITY_CELLS, (tn, fp, fn, tp))]
        out += [
            safe_ratio(fp, fp + tn).alias(f"{block}_fpr"),
            safe_ratio(fn, fn + tp).alias(f"{block}_fnr"),
            safe_ratio(tn, tn + fp).alias(f"{block}_tnr"),
        ]
    gap = F.col("trtr_metrics.auroc") - F.col("tstr_metrics.auroc")
    return documents.select(*keys, *out, gap.alias("utility_gap"))


def parse_utility(raw: DataFrame, json_column: str, keys: list[str]) -> DataFrame:
    """Utility metrics from a column of JSON text."""
    parsed = raw.select(*keys, F.from_json(F.col(json_column), UTILITY_SCHEMA).alias("__d"))
    return utility_metrics(parsed.select(*keys, "__d.*"), keys)


def flat_numbers(raw: DataFrame, json_column: str, keys: list[str], depth: int = 12) -> DataFrame:
    """(keys, path, value) of every number in a JSON column, with dotted paths.

    Expands one nesting level per step, leaves stay; array positions are
    written as [i].  A document nested deeper than ``depth`` fails the job.
    """
    def containers(text: Column) -> tuple[Column, Column]:
        members = F.map_entries(F.when(text.startswith("{"), F.from_json(text, "map<string,string>")))
        return members, F.when(text.startswith("["), F.from_json(text, "array<string>"))

    level = raw.select(*keys, F.lit("").alias("path"), F.col(json_column).alias("__json"))
    for _ in range(depth):
        members, elements = containers(F.trim(F.col("__json")))
        dotted = F.transform(
            members,
            lambda e: F.struct(
                F.concat(F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit("."))), e["key"]).alias("path"),
                e["value"].alias("__json"),
            ),
        )
        indexed = F.transform(
            elements,
            lambda v, i: F.struct(
                F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("__json")
            ),
        )
        leaf = F.array(F.struct(F.col("path"), F.col("__json")))
        level = level.select(*keys, F.inline(F.coalesce(dotted, indexed, leaf)))
    left = F.coalesce(*[F.size(c) for c in containers(F.trim(F.col("__json")))])
    value = F.when(left > 0, F.raise_error(F.format_string("JSON below %s is nested deeper than " + str(depth), F.col("path"))).cast("double")).otherwise(
        F.col("__json").try_cast("double")
    )
    return level.select(*keys, "path", value.alias("value")).filter(F.col("value").isNotNull())


def tidy(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide per-chain metrics to tidy trajectories, one row per metric.

    Metrics a table does not have are skipped.
    """
    present = [c for c in metrics if c in wide.columns]
    labelled = wide.withColumn("chain", chain_label(F.col("dseed"), F.col("mseed")))
    keys = ["generator", "dseed", "mseed", "chain", "generation"]
    return labelled.unpivot(keys, [F.col(c).cast("double").alias(c) for c in present], "metric", "value")


def patch_keys(patch: DataFrame) -> DataFrame:
    """Long patch rows (variant token, model) keyed by generator."""
    generator = generator_of(F.col("model"), variant_of(F.col("variant")))
    return patch.select(
        generator.alias("generator"), "dseed", "mseed", "generation", "metric_name",
        F.col("metric_value").cast("double").alias("metric_value"),
    )


def patch_wide(patch: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long patch to one column per metric; a duplicate patch row is an error."""
    checked = assert_unique(patch, [*keys, "metric_name"], "patch")
    return checked.groupBy(*keys).pivot("metric_name", metrics).agg(F.first("metric_value"))


def patch_overlay(base: DataFrame, patch: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Left-join a long patch onto wide metrics; patch values win where present.

    Metrics the base lacks become new columns.  Applying the same patch again
    changes nothing.
    """
    wide = patch_wide(patch, keys, metrics).withColumnsRenamed({c: f"__p_{c}" for c in metrics})
    joined = base.join(wide, keys, "left")
    fixed = {
        c: F.coalesce(F.col(f"__p_{c}"), F.col(c).cast("double")) if c in base.columns else F.col(f"__p_{c}")
        for c in metrics
    }
    return joined.withColumns(fixed).drop(*[f"__p_{c}" for c in metrics])


def patch_matches(base: DataFrame, patch: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """metric_name, n_matched, n_rows: how many base rows each patched metric reached."""
    wide = patch_wide(patch, keys, metrics)
    counted = base.select(*keys).join(wide, keys, "left").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in metrics]
    )
    return counted.unpivot(["n_rows"], metrics, "metric_name", "n_matched").select("metric_name", "n_matched", "n_rows")


def refresh_pooled(pooled_rows: DataFrame, patched: DataFrame, metrics: list[str]) -> DataFrame:
    """Replace the pooled rows of patched metrics, matched by exact name."""
    long = patched.unpivot(["generator", "generation"], [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value")
    fresh = pooled(long, ["generator", "generation", "metric"], "value")
    kept = pooled_rows.filter(~F.col("metric").isin(*metrics))
    return kept.unionByName(fresh, allowMissingColumns=True)


def merge_quality_and_utility(quality: DataFrame, utility: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two pooled wide tables on their keys."""
    clash = [c for c in utility.columns if c in quality.columns and c not in keys]
    return quality.join(utility.withColumnsRenamed({c: f"{c}_tstr_dup" for c in clash}), keys, "full_outer")
