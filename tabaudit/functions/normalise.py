"""Record normalisation and the value normalisers of the membership tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.columns import as_number, label_map, round_half_even

MISSING = "Missing"


def gender_label(raw: Column) -> Column:
    """M/F from text, boolean or 0/1 spellings; anything else is null."""
    return label_map(m.GENDER_TOKENS, F.upper(F.trim(raw.cast("string"))))


def boolean_value(types: dict[str, str], name: str) -> Column:
    """0/1 exports (numbers or text) to boolean; missing stays missing."""
    if types[name] == "boolean":
        return F.col(name)
    text = F.lower(F.trim(F.col(name).cast("string")))
    return (
        F.when(text == "true", F.lit(True))
        .when(text == "false", F.lit(False))
        .otherwise(text.try_cast("double").try_cast("int") != 0)
    )


def normalise_records(df: DataFrame, record_id: Column | None = None) -> DataFrame:
    """Raw export rows to readable records, in one projection.

    Columns a file does not have are skipped, columns outside the record
    layout are dropped, context columns that are not features (chain keys,
    role, ...) pass through in front.  ``record_id`` supplies the surrogate
    ID; an ``ID`` already present in the input is kept.
    """
    for raw, clean in m.RENAMED_AT_INGEST.items():
        if raw in df.columns:
            df = df.withColumnRenamed(raw, clean)
    types = dict(df.dtypes)
    have = set(types)

    def feature(name: str) -> Column:
        if name in m.BOOLEAN_FEATURES:
            return boolean_value(types, name)
        if name == "gender":
            return gender_label(F.col(name))
        if name in m.ORDINAL_FEATURES:
            code = as_number(types, name)
            whole = F.when(code == F.rint(code), code.try_cast("int"))
            return label_map(m.ORDINAL_LABELS[name], whole)
        if name in m.ONE_DECIMAL_FEATURES:
            return round_half_even(as_number(types, name), 1)
        if name in m.WHOLE_NUMBER_FEATURES:
            return round_half_even(as_number(types, name)).try_cast("bigint")
        return F.col(name)

    if record_id is None and "ID" in have:
        record_id = F.col("ID")
    context = [
        F.col(c)
        for c in types
        if c not in m.RECORD_COLUMNS and c not in m.DROPPED_RAW_COLUMNS
    ]
    ids = [record_id.cast("bigint").alias("ID")] if record_id is not None else []
    feats = [feature(c).alias(c) for c in m.FEATURES if c in have]
    return df.select(*context, *ids, *feats)


def membership_text(name: str) -> str:
    """SQL text of the comparable form of a cell value.

    Missing spellings collapse to one value and booleans to 1/0; every other
    value keeps its exact original text (neither trimmed nor lowered).
    """
    text = f"CAST(`{name}` AS STRING)"
    key = f"lower(trim({text}))"
    return (
        f"CASE WHEN {text} IS NULL OR {key} IN ('nan', 'null', 'none', '') THEN '{MISSING}' "
        f"WHEN {key} IN ('true', '1') THEN '1' WHEN {key} IN ('false', '0') THEN '0' ELSE {text} END"
    )


def membership_value(name: str) -> Column:
    return F.expr(membership_text(name))


def bin_text(value: str, low: float, high: float, bins: int) -> str:
    """SQL text of the 1-based equal-width bin of ``value``, clipped to [1, bins].

    0 stands for missing, and a feature without spread has the single bin 1.
    The operation order (scale by the span first, then multiply) decides
    boundary values, so it must not be rearranged.
    """
    if low == high:
        return f"CASE WHEN {value} IS NULL THEN 0 ELSE 1 END"
    place = f"floor(({value} - double('{low!r}')) / (double('{high!r}') - double('{low!r}')) * double('{bins}')) + 1"
    return f"CAST(CASE WHEN {value} IS NULL THEN 0 ELSE least(greatest({place}, 1), {bins}) END AS INT)"


def copy_number_text(value: str) -> str:
    """Numeric side of the exact-copy comparison: whole numbers, half to even (-0.0 is 0.0)."""
    return f"rint({value}) + 0D"


def copy_label_text(name: str) -> str:
    """Categorical side of the exact-copy comparison."""
    return f"lower(trim(CAST(`{name}` AS STRING)))"


def binary_label(value: Column, kind: str) -> Column:
    """Outcome label to 0/1 however it was written; unknown text is an error.

    A missing number counts as not positive, like any value that is not > 0.
    """
    if kind == "boolean":
        return F.coalesce(value.cast("int"), F.lit(0))
    if kind != "string":
        return F.coalesce((value > 0).cast("int"), F.lit(0))
    text = F.lower(F.trim(value))
    return (
        F.when(text.isin(*m.TRUE_TOKENS), F.lit(1))
        .when(text.isin(*m.FALSE_TOKENS), F.lit(0))
        .otherwise(
            F.raise_error(F.concat(F.lit("unrecognised label value: "), F.coalesce(value, F.lit("<null>")))).cast("int")
        )
    )
