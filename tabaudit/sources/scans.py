"""Scans of run folders: records, training files, population, labels, metrics.

A scan is one distributed read of a glob; chain and generation come from the
file path of each row, never from a loop over folders.  Where exactly one file
is expected the check is an aggregation over distinct paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit import model as m
from tabaudit.functions.columns import as_number, finite
from tabaudit.functions.keys import (
    FOLDER_PATTERN, GENERATION_IN_FILE, file_name, generation_of, with_chain_keys,
)
from tabaudit.functions.normalise import boolean_value
from tabaudit.sources.files import with_header
from tabaudit.sources.sinks import reliable
from tabaudit.sources.tree_index import bare_path, label_file, scan_by_header, single

_PATH = "_metadata.file_path"


def record_schema(columns: list[str] | None = None) -> T.StructType:
    """Schema of readable record files; every column optional, ``nt-probnp`` under its file name."""
    raw = {clean: name for name, clean in m.RENAMED_AT_INGEST.items()}
    fields = []
    for c in columns or m.RECORD_COLUMNS:
        if c in m.BOOLEAN_FEATURES:
            kind = T.BooleanType()
        elif c in m.NUMERIC_FEATURES:
            kind = T.DoubleType()
        elif c == "ID":
            kind = T.LongType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(raw.get(c, c), kind))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, **options) -> DataFrame:
    """CSV with header.  With a schema, every file's header must show the same columns in the same order."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").options(**options)
    if schema is None:
        return reader.csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def read_variants(
    spark: SparkSession, root: str, below: str, pattern: str, generators: list[str] | None = None, file_depth: int = 3
) -> DataFrame:
    """All files ``root/<generator>/*/<below>/<pattern>`` as text columns.

    Files of one generator variant share their columns, taken from one header
    and checked against all others; variants with fewer columns get nulls.
    A variant without files is left out.
    """
    out: DataFrame | None = None
    for generator in generators or list(m.GENERATOR_VARIANTS):
        glob = f"{root}/{generator}/*/{below}"
        try:
            columns = read_csv(spark, glob, pathGlobFilter=pattern).columns
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
                continue
            raise
        if not columns:
            continue
        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = _path_parts(read_csv(spark, glob, text, pathGlobFilter=pattern), file_depth)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {below}/{pattern} below {root}")
    return out


def typed_records(text: DataFrame) -> DataFrame:
    """Text columns of readable records to their types; unreadable numbers are null."""
    df = text.withColumnsRenamed(m.RENAMED_AT_INGEST)
    types = dict(df.dtypes)
    out = []
    for c in types:
        if c in m.NUMERIC_FEATURES:
            kind = "bigint" if c in m.WHOLE_NUMBER_FEATURES else "double"
            out.append(as_number(types, c).try_cast(kind).alias(c))
        elif c in m.BOOLEAN_FEATURES:
            out.append(boolean_value(types, c).alias(c))
        else:
            out.append(as_number(types, c).try_cast("bigint").alias(c) if c == "ID" else F.col(c))
    return df.select(*out)


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(m.RENAMED_AT_INGEST)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and the infinities become null at ingest."""
    return df.withColumns({c: finite(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def _path_parts(df: DataFrame, file_depth: int) -> DataFrame:
    """Add file, role folder and chain folder of a row's path."""
    parts = F.split(F.col(_PATH), "/")
    return df.select(
        "*", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("role_folder"),
        F.element_at(parts, -file_depth).alias("folder"),
    )


def scan_records(spark: SparkSession, root: str, generators: list[str] | None = None) -> DataFrame:
    """Generated records below ``root/<generator>/<chain>/SD``.

    Files whose name has no generation are skipped.
    """
    rows = read_variants(spark, root, "SD", "*gen_[0-9]*.csv", generators)
    keyed = with_chain_keys(rows.withColumn("generation", generation_of(F.col("file"))))
    return typed_records(keyed.drop("role_folder"))


def training_choice(files: DataFrame) -> DataFrame:
    """The training file of each chain: one naming gen_0 first, else the first by name."""
    usable = files.filter(F.col("file").startswith("reference_") & F.col("file").endswith("_clin.csv"))
    best = F.min(F.struct((~F.col("file").contains("gen_0")).alias("other"), F.col("file").alias("file")))
    return usable.groupBy("folder").agg(best.alias("__b")).select("folder", "__b.file")


def scan_training(spark: SparkSession, root: str, generators: list[str] | None = None) -> DataFrame:
    """Training records below ``root/<generator>/<chain>/RD``; chains without a file have no rows."""
    rows = read_variants(spark, root, "RD", "reference_*_clin.csv", generators)
    chosen = training_choice(list_files(spark, f"{root}/*/*/RD/*.csv", 3))
    return typed_records(with_chain_keys(rows.join(chosen, ["folder", "file"], "left_semi").drop("role_folder")))


def raw_export_roots(spark: SparkSession, root: str) -> list[str]:
    """Names of the export folders below ``root``: one per generator variant, so a short list."""
    files = list_files(spark, f"{root}/*_export/*/data/decoded/*.csv", 5)
    return sorted(r[0] for r in files.select("folder").distinct().collect())


def _is_training(name: Column) -> Column:
    return name.startswith("reference_") & name.contains("gen_0")


def raw_training_counts(spark: SparkSession, root: str) -> DataFrame:
    """(folder, n_training_files): chains with other than one generation-0 reference file get no training rows."""
    files = list_files(spark, f"{root}/*_export/*/data/decoded/*.csv", 4)
    return files.groupBy("folder").agg(F.count_if(_is_training(F.col("file"))).alias("n_training_files"))


def scan_raw_exports(spark: SparkSession, root: str) -> DataFrame:
    """Raw exports ``root/<prefix>_<generator>_export/<chain>/data/decoded/*.csv`` with a role column.

    Every export folder has its own columns; those that one lacks are null.  A
    chain without a single generation-0 reference file keeps its synthetic
    rows and has no training rows; ``raw_training_counts`` reports it.
    """
    rows = read_variants(spark, root, "data/decoded", "*.csv", raw_export_roots(spark, root), 4).drop("role_folder")
    name = F.col("file")
    role = F.when(_is_training(name), F.lit("training")).when(name.startswith("synthetic_"), F.lit("synthetic"))
    keyed = with_chain_keys(rows.withColumns({"role": role, "generation": generation_of(name)})).filter(F.col("role").isNotNull())
    usable = raw_training_counts(spark, root).filter("n_training_files = 1").select("folder").withColumn("role", F.lit("training"))
    training = keyed.filter(F.col("role") == "training").join(usable, ["folder", "role"], "left_semi")
    return keyed.filter(F.col("role") == "synthetic").unionByName(training.select(keyed.columns))


def scan_population(spark: SparkSession, path: str) -> DataFrame:
    return typed_records(read_csv(spark, path))


def read_metadata(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names of a column-metadata JSON; plan-time metadata."""
    schema = "columns map<string, struct<sdtype: string>>"
    rows = (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.explode("columns").alias("name", "meta")).select("name", "meta.sdtype").collect()
    )
    found = {m.RENAMED_AT_INGEST.get(r["name"], r["name"]): r["sdtype"] for r in rows if r["name"] != "ID"}
    numeric = [c for c, kind in found.items() if kind == "numerical"]
    categorical = [c for c, kind in found.items() if kind in ("categorical", "boolean")]
    return numeric, categorical


def spread(df: DataFrame, *keys: str, small: int = 64) -> DataFrame:
    """Spread a table of a few splits over all cores by a hash of ``keys``.

    A table with at least as many splits as cores, or with more than ``small``
    splits, is left as it is: shuffling it would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores, *keys) if splits < min(cores, small) else df


def list_files(spark: SparkSession, glob: str, folder_depth: int = 2, recursive: bool = False) -> DataFrame:
    """path, folder, file of the files a glob matches; contents are not read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    parts = F.split(F.col("path"), "/")
    return reader.load(glob).select(
        "path", F.element_at(parts, -folder_depth).alias("folder"), file_name(F.col("path")).alias("file")
    )


def label_files(spark: SparkSession, root: str, last_generation: int = m.LAST_GENERATION) -> DataFrame:
    """Dry listing of the label scan: path, folder, generation and keep/drop per file."""
    files = list_files(spark, root, recursive=True)
    parts = F.split(F.col("path"), "/")
    folder = F.try_element_at(F.filter(parts, lambda p: p.rlike(FOLDER_PATTERN)), F.lit(1))
    return files.select(
        bare_path(F.col("path")).alias("path"), "file", folder.alias("folder"),
        generation_of(F.col("file"), GENERATION_IN_FILE).alias("generation"), label_file(parts, folder, last_generation).alias("keep"),
    )


def scan_labels(spark: SparkSession, root: str, aliases: list[str] = m.LABEL_COLUMN_ALIASES, files: DataFrame | None = None) -> DataFrame:
    """folder, chain keys, generation and ``readmission`` of every label file.

    The label may carry any of its known names in any case.  ``files`` (path,
    folder, generation, header) comes from a ``TreeIndex``; without one the
    tree is listed and first lines are read.
    """
    if files is None:
        files = reliable(with_header(label_files(spark, root).filter("keep").select("path", "folder", "generation")))
    chosen = single(files.select("path", "folder", "generation", "header"), ["folder", "generation"], "labels")

    def label(header: list[str]) -> dict[str, str] | None:
        lower = [c.lower() for c in header]
        name = next((a for a in aliases if a in lower), None)
        return None if name is None else {"readmission": header[lower.index(name)]}

    rows = scan_by_header(chosen, label, ["folder", "generation"])
    if rows is None:
        raise ValueError(f"no file below {root} has a label column")
    return with_chain_keys(rows)


def scan_utility(spark: SparkSession, root: str) -> DataFrame:
    """Utility documents ``root/*/<chain>/metrics/tstr_*_gen_<g>_*.json``, one per chain and generation."""
    from tabaudit.operators.utility import UTILITY_SCHEMA, utility_metrics

    glob = f"{root}/*/*/metrics/tstr_*_gen_*_*.json"
    rows = spark.read.schema(UTILITY_SCHEMA).option("multiLine", True).json(glob)
    parts = F.split(F.col(_PATH), "/")
    keyed = with_chain_keys(
        rows.select("*", F.element_at(parts, -3).alias("folder"), generation_of(F.element_at(parts, -1)).alias("generation"))
    )
    keys = ["generator", "dseed", "mseed", "generation"]
    from tabaudit.operators.ids import assert_unique

    return assert_unique(utility_metrics(keyed, keys), keys, "utility documents")


def quality_files(files: DataFrame) -> DataFrame:
    """The quality table of each chain: the one named like it, else the only one."""
    name = F.element_at(F.split("path", "/"), -1)
    counted = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("__n"), F.max_by(F.struct("path", "header"), name == F.concat("folder", F.lit(".csv"))).alias("__r"),
        F.bool_or(name == F.concat("folder", F.lit(".csv"))).alias("__named"),
    )
    several = F.raise_error(F.concat(F.col("folder"), F.lit(": several quality tables"))).cast("boolean")
    return counted.filter(F.when(F.col("__named") | (F.col("__n") == 1), F.lit(True)).otherwise(several)).select("folder", "__r.*")


def scan_quality(spark: SparkSession, root: str, files: DataFrame | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Long per-chain quality metrics of ``root/*/<chain>/<chain>.csv``, else of the only CSV of the folder.

    Each file keeps its own columns; with ``metrics`` no others are parsed.
    ``files`` (path, folder, header) comes from a ``TreeIndex``.
    """
    if files is None:
        files = reliable(with_header(list_files(spark, f"{root}/*/*/*.csv", 2).select(bare_path(F.col("path")).alias("path"), "folder")))
    chosen = quality_files(files.select("path", "folder", "header"))

    def numbers(header: list[str]) -> dict[str, str] | None:
        if "generation" not in header:
            return None
        return {"__generation": "generation"} | {c: c for c in header if c and c != "generation" and (metrics is None or c in metrics)}

    rows = scan_by_header(chosen, numbers, ["folder"])
    if rows is None:
        raise ValueError(f"no quality table below {root} has a generation column")
    names = [c for c in rows.columns if c not in ("folder", "__generation")]
    values = [F.struct(F.lit(c).alias("metric"), finite(F.col(f"`{c}`").try_cast("double")).alias("value")) for c in names]
    keyed = with_chain_keys(rows).withColumn("generation", F.col("__generation").try_cast("double").cast("int"))
    long = keyed.select("generator", "dseed", "mseed", "generation", F.inline(F.array(*values)))
    return long.filter(F.col("value").isNotNull())


def scan_patches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Long patch tables; a table lacking a required column is an error before anything runs."""
    required = {"variant", "dseed", "mseed", "model", "generation", "metric_name", "metric_value"}
    out: DataFrame | None = None
    for path in paths:
        try:
            table = read_csv(spark, path)
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                continue  # a partial patch set is fine
            raise
        lacking = required - set(table.columns)
        if lacking:
            raise ValueError(f"{path} lacks columns {sorted(lacking)}")
        typed = table.select(
            "variant", F.col("dseed").cast("bigint"), F.col("mseed").cast("bigint"), "model",
            F.col("generation").cast("int"), "metric_name", F.col("metric_value").try_cast("double").alias("metric_value"),
        )
        out = typed if out is None else out.unionByName(typed)
    if out is None:
        raise ValueError("none of the patch tables exists")
    return out
