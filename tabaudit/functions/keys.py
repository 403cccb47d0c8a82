"""Chain and generation keys parsed from paths and folder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.columns import label_map

# Fixed naming patterns of run folders and data files.
FOLDER_PATTERN = r"(?i)^(Step7pf[ap])_dseed(\d+)_synthcity_([A-Za-z0-9]+)_mseed(\d+)$"
FOLDER_PATTERN_SQL = FOLDER_PATTERN.replace("\\", "\\\\")
GENERATION_IN_NAME = r"gen_(\d+)"
GENERATION_IN_FILE = r"_gen_(\d+)(?:[_.]|$)"


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def generation_of(name: Column, pattern: str = GENERATION_IN_NAME) -> Column:
    """Generation number in a file name; null when the name carries none."""
    return _group(name, pattern, 1).try_cast("int")


def generation_number(label: Column) -> Column:
    """10, '10' and 'gen_10' all give 10."""
    return _group(label.cast("string"), r"(\d+)", 1).try_cast("int")


def generation_label(generation: Column) -> Column:
    return F.concat(F.lit("gen_"), generation.cast("string"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def chain_label(dseed: Column, mseed: Column) -> Column:
    return F.concat(F.lit("d"), dseed.cast("string"), F.lit(" / m"), mseed.cast("string"))


def variant_of(token: Column) -> Column:
    """full/core from any known spelling; an unknown spelling fails the job."""
    found = label_map(m.VARIANT_TOKENS, F.lower(F.trim(token)))
    return F.when(token.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(found, F.raise_error(F.concat(F.lit("unknown variant token: "), token)).cast("string"))
    )


def generator_of(base: Column, variant: Column) -> Column:
    return F.concat(F.upper(base), F.when(F.lower(variant) == "core", F.lit("_CORE")).otherwise(F.lit("")))


def with_chain_keys(df: DataFrame, folder: str = "folder") -> DataFrame:
    """Add generator, base_generator, variant, dseed, mseed and chain.

    A folder that does not follow the naming pattern keeps null keys and its
    own name as chain label, so it can be reported instead of vanishing.
    """
    # one match per row decides; the parts are then cut at fixed places
    parts = f"CASE WHEN `{folder}` RLIKE '{FOLDER_PATTERN_SQL}' THEN split(`{folder}`, '_') END AS __parts"
    variants = ", ".join(f"'{token}', '{variant}'" for token, variant in m.VARIANT_TOKENS.items())
    core = "CASE WHEN variant = 'core' THEN '_CORE' ELSE '' END"
    columns = [f"`{c}`" for c in df.columns]
    split = df.selectExpr("*", parts).selectExpr(
        *columns,
        "upper(__parts[3]) AS base_generator",
        f"try_element_at(map({variants}), lower(__parts[0])) AS variant",
        "try_cast(substring(__parts[1], 6) AS BIGINT) AS dseed",
        "try_cast(substring(__parts[4], 6) AS BIGINT) AS mseed",
    )
    return split.selectExpr(
        "*", f"base_generator || {core} AS generator",
        f"coalesce('d' || CAST(dseed AS STRING) || ' / m' || CAST(mseed AS STRING), `{folder}`) AS chain",
    )
