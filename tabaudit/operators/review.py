"""Hand-off to an external reviewer: candidates, batches, answers, rates.

The reviewer itself is outside the engine: batches go out as a table of
payload texts, answers come back as a table of response texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.columns import label_map, round_half_even
from tabaudit.operators.ids import number_within
from tabaudit.operators.rules import either, with_readable
from tabaudit.sources.sinks import reliable

# Length of an ID slice when rows of one file are numbered; a multiple of every
# sensible batch size is not required, offsets are exact.
ID_SLICE = 100_000


def worth_review(df: DataFrame) -> DataFrame:
    """Records with a measured value outside its normal range; missing values say nothing."""
    source, record, columns = with_readable(df)
    outside = either([record.outside(c, *limits) for c, limits in m.NORMAL_RANGE.items() if c in columns])
    return source.filter(outside or "false").select(*columns)


def without_flagged(records: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Records that are not in the flag table (keys include the record ID)."""
    return records.join(flagged.select(*keys), keys, "left_anti")


def review_batches(
    candidates: DataFrame, file_keys: list[str], order: str = "ID", batch_rows: int = m.REVIEW_BATCH_ROWS
) -> DataFrame:
    """Add ``position`` (1..n per file) and ``batch`` (0-based slices of ``batch_rows``).

    Numbering reads the candidates twice, for offsets and for ranks; they are
    few beside the records they were picked from, so they are kept once.
    """
    numbered = number_within(
        reliable(candidates), file_keys, [order], f"floor({order} / {ID_SLICE})", name="position"
    )
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / F.lit(batch_rows)).cast("bigint"))


def _csv_cell(value: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return round_half_even(value, 1).cast("string")
    text = value.cast("string")
    if kind == "boolean":
        text = F.initcap(text)
    if kind == "string":
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text)
    return text


def batch_payloads(batched: DataFrame, file_keys: list[str], columns: list[str] = m.REVIEW_COLUMNS) -> DataFrame:
    """file_keys, batch, n_rows, payload: header line, column line, one CSV line per record.

    At most one batch of rows meets in a group, so the collected list is
    bounded by the batch size.
    """
    present = [c for c in columns if c in batched.columns]
    kinds = dict(batched.dtypes)
    cells = [F.coalesce(_csv_cell(F.col(c), kinds[c]), F.lit("")) for c in present]
    line = F.concat_ws(",", *cells)
    head = m.REVIEW_HEADER + "\n\nCSV:\n" + ",".join(present) + "\n"
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda r: r["line"]), "\n"
    )
    return batched.groupBy(*file_keys, "batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.concat(F.lit(head), body, F.lit("\n")).alias("payload")
    )


def named_ids(response: Column) -> Column:
    """Whole numbers named in a reviewer's answer, as an array.

    The word NONE anywhere (any case) means nothing was flagged, even when
    numbers follow it.
    """
    none = response.isNull() | response.rlike(r"(?i)(?<![\p{L}\p{N}_])NONE(?![\p{L}\p{N}_])")
    numbers = F.regexp_extract_all(response, F.lit(r"(?<![\p{L}\p{N}_])([0-9]+)(?![\p{L}\p{N}_])"), F.lit(1))
    parsed = F.array_compact(F.transform(numbers, lambda t: t.try_cast("bigint")))
    return F.when(none, F.array().cast("array<bigint>")).otherwise(F.array_distinct(parsed))


def flagged_by_reviewer(
    responses: DataFrame, batched: DataFrame, batch_keys: list[str], record_id: str = "ID"
) -> DataFrame:
    """batch_keys + ID of the records named in the answer to their own batch."""
    named = responses.select(*batch_keys, F.explode(named_ids(F.col("response"))).alias(record_id))
    return named.join(batched.select(*batch_keys, record_id), [*batch_keys, record_id], "left_semi")


def review_rates(rows: DataFrame, file_keys: list[str], rule_flag: str, reviewer_flag: str) -> DataFrame:
    """Per file: totals, flag counts and rates in percent (4 decimals, half to even)."""
    rule, reviewer = (F.coalesce(F.col(c), F.lit(False)) for c in (rule_flag, reviewer_flag))
    counted = rows.groupBy(*file_keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(rule).alias("expert_flagged"),
        F.count_if(reviewer).alias("llm_flagged"),
        F.count_if(rule | reviewer).alias("__both"),
    )

    def percent(n: str) -> Column:
        return round_half_even(F.col(n) / F.col("total_rows") * F.lit(100.0), 4)

    return counted.select(
        *file_keys, "total_rows", "expert_flagged", "llm_flagged",
        percent("expert_flagged").alias("expert_any_rate"),
        percent("llm_flagged").alias("llm_rate"),
        percent("__both").alias("combined_rate"),
    )


def rate_problems(rates: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Files whose rule and reviewer rates do not add up to the combined rate.

    They overlap when a reviewer saw records that rules had already flagged.
    """
    residual = F.abs(F.col("expert_any_rate") + F.col("llm_rate") - F.col("combined_rate"))
    return rates.withColumn("residual", residual).filter(F.col("residual") > tolerance)


def looks_like_fractions(rates: DataFrame) -> DataFrame:
    """One row: are the rates fractions although percentages are expected?"""
    return rates.agg((F.max("combined_rate") <= 1.0).alias("rates_are_fractions"))


def cost_ledger(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Token totals and cost per key; usage has columns kind and tokens."""
    price = label_map(m.TOKEN_PRICES, F.col("kind"))
    return usage.groupBy(*keys, "kind").agg(F.sum("tokens").alias("tokens")).withColumn(
        "cost_usd", F.col("tokens") / F.lit(1_000_000.0) * price
    )
