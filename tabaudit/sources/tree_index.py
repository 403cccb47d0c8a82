"""An index of the files of an evaluation tree, kept between runs, and scans that go by it.

The index has a row per file: its role, generator, chain and generation, taken
from the path, its size and time, and the column names of its first line.  A
refresh lists the tree, meets the listing with the index by an anti-join and
describes only what is new or changed; what is gone is marked.  Scans group the
files by header: each distinct header is one reader with that schema, so every
file is parsed once and only in the columns that are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit import model as m
from tabaudit.functions.keys import FOLDER_PATTERN, GENERATION_IN_FILE, generation_of
from tabaudit.sources.files import with_header
from tabaudit.sources.sinks import exists

INDEX = "path string, role string, generator string, folder string, generation int, size bigint, modified timestamp, header array<string>, header_print bigint, gone boolean, batch int"

# Name filters of the label scan (fixed values).
SKIPPED_FOLDERS = ["metrics", "results", "ids", "plots", "figures", "logs"]
LABEL_FILE_PATTERN = r"(?i)^synthetic_synthcity_.*_decoded\.csv$"
SKIPPED_PREFIXES = ["reference_", "real_", "train_", "test_", "population_", "holdout_"]


def bare_path(path: Column) -> Column:
    """Paths of all listings written the same way."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def label_file(parts: Column, folder: Column, last_generation: int = m.LAST_GENERATION) -> Column:
    """Whether a file holds synthetic labels, by its name, its folders below the chain and its generation."""
    name = F.element_at(parts, -1)
    at = F.array_position(parts, folder)
    below = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at - 1, F.lit(0)).cast("int"))
    generation = generation_of(name, GENERATION_IN_FILE)
    skipped = F.exists(below, lambda p: F.lower(p).isin(*SKIPPED_FOLDERS))
    for prefix in SKIPPED_PREFIXES:
        skipped = skipped | F.lower(name).startswith(prefix)
    return F.coalesce(name.rlike(LABEL_FILE_PATTERN) & ~skipped & generation.isNotNull() & (generation <= last_generation), F.lit(False))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with its role; contents are not read.

    Roles: records, training, labels, quality, utility, raw, population,
    metadata, other.  Generation is null where a role has none.
    """
    # partition names in paths are not columns here
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    files = files.withColumn("__p", parts).withColumn("folder", F.try_element_at(F.filter("__p", lambda p: p.rlike(FOLDER_PATTERN)), F.lit(1)))
    p = F.col("__p")
    name, above, two = F.element_at(p, -1), F.try_element_at(p, F.lit(-2)), F.try_element_at(p, F.lit(-3))
    csv = F.lower(name).endswith(".csv")
    in_chain = two == F.col("folder")
    role = (
        F.when(label_file(p, F.col("folder")), "labels")
        .when(in_chain & (above == "SD") & csv & name.rlike(r"gen_\d"), "records")
        .when(in_chain & (above == "RD") & name.startswith("reference_") & name.endswith("_clin.csv"), "training")
        .when(in_chain & (above == "metrics") & name.rlike(r"^tstr_.*_gen_\d+_.*\.json$"), "utility")
        .when((above == F.col("folder")) & csv, "quality")
        .when((above == "decoded") & F.col("folder").isNotNull() & csv, "raw")
        .when((above == "POP") & csv, "population")
        .when((above == "POP") & name.endswith(".json"), "metadata")
        .otherwise("other")
    )
    return files.select(
        bare_path(F.col("path")).alias("path"), role.alias("role"),
        F.get(p, (F.array_position(p, F.col("folder")) - 2).cast("int")).alias("generator"), "folder",
        generation_of(name).alias("generation"), "size", "modified",
    )


def _latest(rows: DataFrame) -> DataFrame:
    """The newest row of each path."""
    columns = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*columns), "batch").alias("__r")).select("path", *[F.col(f"__r.{c}").alias(c) for c in columns])


class TreeIndex:
    """The index of one tree, a Parquet table at ``path`` that grows by a batch of new rows per refresh."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(self.path)

    def files(self, role: str | None = None) -> DataFrame:
        """Files that the tree holds now."""
        rows = _latest(self._rows()).filter(~F.col("gone"))
        return rows.filter(F.col("role") == role) if role else rows

    def refresh(self, root: str) -> DataFrame:
        """Describe what is new or changed below ``root``, mark what is gone; returns the added rows."""
        found, known = listing(self.spark, root), _latest(self._rows())
        batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
        same = ["path", "size", "modified"]
        new = found.join(known.filter(~F.col("gone")).select(*same), same, "left_anti")
        # only first lines are opened, a task for each share of the new files
        described = with_header(new.repartition("path")).select("*", F.xxhash64("header").alias("header_print"), F.lit(False).alias("gone"), F.lit(batch).alias("batch"))
        lost = known.filter(~F.col("gone")).join(found.select("path"), "path", "left_anti").withColumns({"gone": F.lit(True), "batch": F.lit(batch)})
        columns = [f.name for f in T._parse_datatype_string(INDEX)]
        described.select(*columns).unionByName(lost.select(*columns)).write.mode("append").parquet(self.path)
        return self._rows().filter(F.col("batch") == batch)

    def only(self, role: str, keys: list[str]) -> DataFrame:
        """The files of a role, one per key; a key with several is an error that names them."""
        return single(self.files(role), keys, role)


def single(files: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The file of each key; several for one key are an error that names them."""
    rest = [c for c in files.columns if c not in keys]
    # two names are enough to say what is wrong
    found = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__first"), F.max("path").alias("__last"), F.min_by(F.struct(*rest), "path").alias("__r"))
    label = F.concat_ws(" ", F.lit(f"{what}: several candidate files for"), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys], F.lit(":"), F.col("__first"), F.col("__last"))
    sure = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(label).cast("boolean"))
    return found.filter(sure).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def scan_by_header(files: DataFrame, wanted: Callable[[list[str]], dict[str, str] | None], keys: list[str]) -> DataFrame | None:
    """(``keys``, wanted columns as text) of the rows of ``files`` (path, header, keys).

    ``wanted`` gives for a header {output column: name in the file}, or None to
    leave its files out.  Files are read once, pruned to those columns; the
    first line of each is its header whatever the others hold.  Headers, few
    however many files there are, and the file names are what the driver sees.
    """
    spark = files.sparkSession
    groups = files.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    out: DataFrame | None = None
    for group in sorted(groups, key=lambda g: g["header"] or []):
        header = group["header"] or []
        chosen = wanted(header)
        if chosen is None:
            continue
        # by place, so that repeated and blank names do no harm
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(sorted(group["paths"]))
        part = rows.select(bare_path(F.col("_metadata.file_path")).alias("path"), *[F.col(f"c{header.index(name)}").alias(alias) for alias, name in chosen.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return None if out is None else out.join(files.select("path", *keys), "path").drop("path")
