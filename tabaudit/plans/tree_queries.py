"""Queries that go the whole way from files to tables, on a tree of run folders.

The tree is written by Spark from the test tables, each part once per session and
table folder when a query first reads it, in the layout that the scans expect: generated and training records,
label files with differing headers, quality tables, utility documents, patches,
population files and files that no scan may take.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.session import jit_friendly, shuffles_dropped
from tabaudit.operators import novelty
from tabaudit.plans import report_queries as report
from tabaudit.plans import views as v
from tabaudit.plans.base import Registry, long_of, r6, s6
from tabaudit.sources import scans, sinks
from tabaudit.sources.files import write_csv_files, write_files
from tabaudit.sources.tree_index import TreeIndex

registry = Registry()
query = registry.query
KEYS, KEY_SQL = v.FILE, "generator, dseed, mseed, generation"

_FOLDER = (
    "'Step7pf' || CASE variant WHEN 'core' THEN 'p' ELSE 'a' END || '_dseed' || CAST(dseed AS STRING) || '_synthcity_' || lower(base_generator) "
    "|| '_mseed' || CAST(mseed AS STRING)"
)
_FOLDER_SQL = _FOLDER.replace("STRING", "VARCHAR")
#: Names under which the label stands, by generation.
_LABELS = {0: "readmission", 1: "Readmitted", 2: " TARGET "}
_PRINTED = {clean: raw for raw, clean in m.RENAMED_AT_INGEST.items()}
_TREES: dict[tuple[str, str], tuple[str, set[str]]] = {}
_LINES: dict[tuple[str, str], DataFrame] = {}
#: Buckets of the stored lines at least, and lines for one more.
BUCKETS, BUCKET_LINES = 16, 1 << 19
#: Parts that the index of a tree knows.
_SEEN: dict[str, set[str]] = {}


def _chain_path(root: str, tail: str) -> Column:
    return F.expr(f"'{root}/' || generator || '/' || {_FOLDER} || '/' || {tail}")


def _run(*written: DataFrame) -> None:
    """Write files; two tasks that wrote the same one are an error."""
    for w in written:
        jit_friendly(w.sparkSession)
        with shuffles_dropped(w.sparkSession):
            twice = w.groupBy("path").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").first()
        if twice is not None:
            raise RuntimeError(f"{twice['path']}: written by {twice['__n']} tasks")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all files with their IDs; they are shuffled once per session, and stored by file."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LINES:
        # a bucket is one task, so their number grows with the table
        buckets = max(BUCKETS, v.table(spark, folder, "lineitem").count() // BUCKET_LINES)
        with shuffles_dropped(spark):
            _LINES[key] = sinks.stored_in_buckets(v.file_lines(spark, folder), "lines", v.FILE, v.LINE_ORDER, buckets)
    return v.numbered(_LINES[key])


def _numbered(spark: SparkSession, folder: str, role: str, *columns: str, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of one role under their printed names, file by file; with ``columns`` only these features.

    Other files than the records' have their rows dealt ``by`` these expressions and sorted in ``order``, before the
    features are worked out: a shuffle moves lines, not records or text.
    """
    lines = _lines(spark, folder).filter(F.col("role") == role)
    if by:
        keys = [F.expr(e) for e in by]
        lines = lines.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows = v.features(lines)
    if columns:
        rows = rows.select(*v.FILE, "base_generator", "variant", "ID", *columns)
    return rows.withColumnsRenamed(_PRINTED)


_COLUMNS = ["ID", *[_PRINTED.get(c, c) for c in m.FEATURES]]


def _write_records(spark: SparkSession, folder: str, root: str) -> None:
    _run(
        write_csv_files(_numbered(spark, folder, "synthetic"), _chain_path(root, "'SD/synthetic_gen_' || generation || '_clin.csv'"), _COLUMNS, ["ID"], dealt=True),
        # no scan may take these
        write_csv_files(_numbered(spark, folder, "training", "age", by=v.CHAIN, order=["ID"]), _chain_path(root, "'SD/notes.csv'"), ["ID", "age"], ["ID"], dealt=True),
    )


def _write_training(spark: SparkSession, folder: str, root: str) -> None:
    # the reference of generation 0 is the one to take
    path = _chain_path(root, "'RD/reference_gen_' || CASE WHEN generation % 2 = 0 THEN '0' ELSE '3' END || '_clin.csv'")
    rows = _numbered(spark, folder, "training", by=[*v.CHAIN, "generation % 2"], order=["generation", "ID"])
    _run(write_csv_files(rows, path, _COLUMNS, ["generation", "ID"], dealt=True))


def _write_population(spark: SparkSession, folder: str, root: str) -> None:
    path = F.expr(f"'{root}/POP/population_' || generator || '_' || ID % 16 || '.csv'")
    rows = _numbered(spark, folder, "population", by=["generator", "ID % 16"], order=["dseed", "mseed", "generation", "ID"])
    _run(write_csv_files(rows, path, _COLUMNS, ["dseed", "mseed", "generation", "ID"], dealt=True))
    kinds = {_PRINTED.get(c, c): {"sdtype": "numerical" if c in m.NUMERIC_FEATURES else "boolean" if c in m.BOOLEAN_FEATURES else "categorical"} for c in m.FEATURES}
    sinks.write_text(spark, f"{root}/POP/metadata.json", json.dumps({"columns": {"ID": {"sdtype": "id"}} | kinds}))


def _write_labels(spark: SparkSession, folder: str, root: str) -> None:
    generated = _numbered(spark, folder, "synthetic", "readmission", "age", "icd9")
    # no scan may take these
    _run(write_csv_files(generated, _chain_path(root, "'metrics/synthetic_synthcity_x_gen_' || generation || '_decoded.csv'"), ["readmission"], ["ID"], dealt=True))
    for k, name in _LABELS.items():
        rows = generated.filter(f"generation % 3 = {k}").withColumnRenamed("readmission", name)
        path = _chain_path(root, "'data/decoded/synthetic_synthcity_' || lower(base_generator) || '_gen_' || generation || '_decoded.csv'")
        _run(write_csv_files(rows, path, ["age", name, "icd9"] if k else [name, "ID"], ["ID"], dealt=True))


def _write_tables(spark: SparkSession, folder: str, root: str) -> None:
    wide = sinks.reliable(v.trajectory(spark, folder).withColumns({"variant": F.lit("full"), "base_generator": F.col("generator")}))
    quality = _chain_path(root, f"{_FOLDER} || '.csv'")
    document = F.to_json(F.expr(
        "named_struct('tstr_metrics', named_struct('auroc', auroc_like, 'f1_score', flag_rate, 'confusion_matrix', named_struct('tn', n_rows, 'fp', generation, 'fn', 0, 'tp', mseed)), "
        "'trtr_metrics', named_struct('auroc', positive_share), 'more', array(1))"
    ))
    patches = v.patch(spark, folder).selectExpr("'Step7pfa' AS variant", "dseed", "mseed", "generator AS model", "generation", "metric_name", "metric_value")
    _run(
        write_csv_files(wide.filter("generator IN ('ARF', 'CTGAN')"), quality, ["generation", "flag_rate", "auroc_like"], ["generation"]),
        write_csv_files(wide.filter("generator NOT IN ('ARF', 'CTGAN')"), quality, ["positive_share", "generation", "flag_rate"], ["generation"]),
        write_files(wide, _chain_path(root, "'metrics/tstr_a_gen_' || generation || '_b.json'"), document, ["generation"]),
        write_csv_files(patches, F.expr(f"'{root}/patches/patch_' || dseed || '.csv'"), patches.columns, ["model", "mseed", "generation", "metric_name"]),
    )


def _write_raw(spark: SparkSession, folder: str, root: str) -> None:
    generated = _numbered(spark, folder, "synthetic", "age", "icd9")
    # chains of data seed 1 have two references, which is one too many
    part = "CASE WHEN dseed = 1 THEN generation % 2 ELSE 0 END"
    taught = _numbered(spark, folder, "training", "age", "icd9", by=[*v.CHAIN, part], order=["generation", "ID"])
    export = f"'{root}-raw/Step7pf' || CASE variant WHEN 'core' THEN 'p' ELSE 'a' END || '_' || lower(base_generator) || '_export/' || {_FOLDER} || '/data/decoded/' || "
    _run(
        write_csv_files(generated.filter("variant = 'full'"), F.expr(export + "'synthetic_gen_' || generation || '_x.csv'"), ["ID", "age", "icd9"], ["ID"], dealt=True),
        write_csv_files(generated.filter("variant = 'core'"), F.expr(export + "'synthetic_gen_' || generation || '_x.csv'"), ["age", "ID"], ["ID"], dealt=True),
        write_csv_files(taught.filter("variant = 'full'"), F.expr(f"{export}'reference_gen_0_' || {part} || '.csv'"), ["ID", "age", "icd9"], ["generation", "ID"], dealt=True),
    )


_PARTS = {
    "records": _write_records, "training": _write_training, "population": _write_population,
    "labels": _write_labels, "tables": _write_tables, "raw": _write_raw,
}
#: What lies below the root itself; raw exports have a root of their own.
_INDEXED = [p for p in _PARTS if p != "raw"]


def tree(spark: SparkSession, folder: str, *parts: str) -> str:
    """Root of the tree with these parts written, each once: a query writes what its scan reads, not the whole tree."""
    key = (spark.sparkContext.applicationId, folder)
    root, there = _TREES.setdefault(key, (f"{sinks.checkpoint_folder(spark).rstrip('/')}/tree-{uuid.uuid4().hex}", set()))
    for part in parts:
        if part not in there:
            _PARTS[part](spark, folder, root)
            there.add(part)
    return root


def tree_index(spark: SparkSession, folder: str, *parts: str) -> TreeIndex:
    """The index of the tree with these parts; it takes up whatever was written since it was refreshed."""
    root = tree(spark, folder, *parts)
    index, now = TreeIndex(spark, f"{root}-index"), set(_TREES[spark.sparkContext.applicationId, folder][1])
    if not now <= _SEEN.get(root, set()):
        index.refresh(root)
        _SEEN[root] = now
    return index


_SHOWN = ["readmission", "prior_icu", *[c for c in m.FEATURES if c not in ("readmission", "prior_icu")]]
_TREE_SQL = f"{v.RECORDS_SQL}, foldered AS (SELECT {_FOLDER_SQL} AS folder, * FROM records)"
# trajectories know full variants only
_CHAINS_SQL = f"{v.TRAJECTORY_SQL}, chained AS (SELECT {_FOLDER_SQL} AS folder, t.* FROM (SELECT 'full' AS variant, generator AS base_generator, * FROM trajectory) t)"


@query(f"""WITH {_TREE_SQL}, {_CHAINS_SQL},
listed AS (
  SELECT DISTINCT 'records' AS role, generator, folder, generation, 'ID' AS first_column FROM foldered WHERE role = 'synthetic'
  UNION ALL SELECT DISTINCT 'training', generator, folder, CASE WHEN generation % 2 = 0 THEN 0 ELSE 3 END, 'ID' FROM foldered WHERE role = 'training'
  UNION ALL SELECT DISTINCT 'labels', generator, folder, generation, CASE WHEN generation % 3 = 0 THEN 'readmission' ELSE 'age' END FROM foldered WHERE role = 'synthetic'
  UNION ALL SELECT DISTINCT 'other', generator, folder, generation, 'readmission' FROM foldered WHERE role = 'synthetic'
  UNION ALL SELECT DISTINCT 'other', generator, folder, NULL, 'ID' FROM foldered WHERE role = 'training'
  UNION ALL SELECT DISTINCT 'quality', generator, folder, NULL, CASE WHEN generator IN ('ARF', 'CTGAN') THEN 'generation' ELSE 'positive_share' END FROM chained
  UNION ALL SELECT DISTINCT 'utility', generator, folder, generation, NULL FROM chained)
SELECT role, generator, folder, CAST(generation AS BIGINT) AS generation, first_column FROM listed""")
def index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of the chains as the index has it."""
    files = tree_index(spark, folder, *_INDEXED).files().filter(F.col("folder").isNotNull())
    return files.select("role", "generator", "folder", long_of("generation"), F.get("header", F.lit(0)).alias("first_column"))


@query(f"WITH {_TREE_SQL} SELECT DISTINCT generator, folder, CAST(generation AS BIGINT) AS generation, {len(m.FEATURES) + 1} AS n_columns FROM foldered WHERE role = 'synthetic'")
def index_chain_files(spark: SparkSession, folder: str) -> DataFrame:
    """The one record file of each chain and generation; two would be an error."""
    found = tree_index(spark, folder, "records").only("records", ["generator", "folder", "generation"])
    return found.select("generator", "folder", long_of("generation"), F.size("header").alias("n_columns"))


_FEATURE_LIST = ", ".join(_SHOWN)


@query(f"WITH {v.RECORDS_SQL} SELECT {KEY_SQL}, ID, {_FEATURE_LIST} FROM records WHERE role = 'synthetic'")
def tree_records(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_records(spark, tree(spark, folder, "records")).select(*v.CHAIN, long_of("generation"), "ID", *_SHOWN)


@query(f"WITH {v.RECORDS_SQL} SELECT generator, dseed, mseed, ID, {_FEATURE_LIST} FROM records WHERE role = 'training' AND generation % 2 = 0")
def tree_training(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_training(spark, tree(spark, folder, "training")).select(*v.CHAIN, "ID", *_SHOWN)


@query(f"WITH {_TREE_SQL} SELECT folder, generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, CAST(readmission AS VARCHAR) AS readmission, count(*) AS n FROM foldered WHERE role = 'synthetic' GROUP BY ALL")
def tree_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label counts of every label file, one reader per header and only its label column."""
    rows = scans.scan_labels(spark, tree(spark, folder, "labels"), files=tree_index(spark, folder, "labels").files("labels"))
    return rows.groupBy("folder", *v.CHAIN, long_of("generation"), "readmission").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TREE_SQL}, f AS (SELECT DISTINCT folder, generation FROM foldered WHERE role = 'synthetic')
SELECT keep, count(*) AS n_files, count(DISTINCT generation) AS n_generations FROM (SELECT TRUE AS keep, generation FROM f UNION ALL SELECT FALSE, generation FROM f) x GROUP BY keep""")
def tree_label_files(spark: SparkSession, folder: str) -> DataFrame:
    """What a label scan would take and leave among files named alike."""
    listed = scans.label_files(spark, tree(spark, folder, "labels")).filter(F.col("file").startswith("synthetic_synthcity_"))
    return listed.groupBy("keep").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("generation").alias("n_generations"))


_QUALITY_SQL = " UNION ALL ".join(
    f"SELECT {KEY_SQL}, '{name}' AS metric, {name} AS value FROM trajectory WHERE generator {side} ('ARF', 'CTGAN')"
    for side, names in (("IN", ("flag_rate", "auroc_like")), ("NOT IN", ("positive_share", "flag_rate"))) for name in names
)


@query(f"WITH {v.TRAJECTORY_SQL}, q AS ({_QUALITY_SQL}) SELECT generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, metric, {s6('value')} FROM q")
def tree_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = scans.scan_quality(spark, tree(spark, folder, "tables"), tree_index(spark, folder, "tables").files("quality"))
    return rows.select(*v.CHAIN, long_of("generation"), "metric", r6("value"))


_TREE_UTILITY = [
    ("tstr_auroc", "auroc_like"), ("tstr_f1", "flag_rate"), ("trtr_auroc", "positive_share"), ("tstr_tn", "CAST(n_rows AS DOUBLE)"),
    ("tstr_fpr", "CAST(generation AS DOUBLE) / (generation + n_rows)"), ("tstr_fnr", "CAST(0 AS DOUBLE) / nullif(mseed, 0)"), ("utility_gap", "positive_share - auroc_like"),
]


@query(f"WITH {v.TRAJECTORY_SQL} SELECT generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, {', '.join(s6(e, n) for n, e in _TREE_UTILITY)} FROM trajectory")
def tree_utility(spark: SparkSession, folder: str) -> DataFrame:
    rows = scans.scan_utility(spark, tree(spark, folder, "tables"))
    return rows.select(*v.CHAIN, long_of("generation"), *[r6(n) for n, _ in _TREE_UTILITY])


_BOUNDS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(f'min({c})', 'low')}, {s6(f'max({c})', 'high')} FROM pop" for c in m.NUMERIC_FEATURES)


@query(f"WITH {v.RECORDS_SQL}, pop AS (SELECT * FROM records WHERE role = 'population') {_BOUNDS_SQL}")
def tree_population_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of the numeric columns that the metadata names, over all population files."""
    root = tree(spark, folder, "population")
    numeric, _ = scans.read_metadata(spark, f"{root}/POP/metadata.json")
    found = novelty.population_bounds(scans.scan_population(spark, f"{root}/POP/population_*.csv"), numeric)
    return found.select("feature", r6("low"), r6("high"))


@query(f"""WITH {_TREE_SQL}
SELECT folder, 'synthetic' AS role, CAST(generation AS BIGINT) AS generation, count(*) AS n_rows, count(age) AS n_age, count(CASE WHEN variant = 'full' THEN icd9 END) AS n_icd9
FROM foldered WHERE role = 'synthetic' GROUP BY folder, generation
UNION ALL SELECT folder, 'training', 0, count(*), count(age), count(icd9) FROM foldered WHERE role = 'training' AND variant = 'full'
  AND folder IN (SELECT folder FROM (SELECT folder, dseed, count(DISTINCT generation % 2) AS k FROM foldered WHERE role = 'training' AND variant = 'full' GROUP BY ALL) y WHERE dseed <> 1 OR k = 1) GROUP BY folder""")
def tree_raw_exports(spark: SparkSession, folder: str) -> DataFrame:
    rows = scans.scan_raw_exports(spark, f"{tree(spark, folder, 'raw')}-raw")
    return rows.groupBy("folder", "role", long_of("generation")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("age").alias("n_age"), F.count("icd9").alias("n_icd9"))


@query(f"WITH {v.PATCH_SQL} SELECT generator AS model, dseed, mseed, CAST(generation AS BIGINT) AS generation, metric_name, {s6('metric_value')} FROM patch")
def tree_patches(spark: SparkSession, folder: str) -> DataFrame:
    """All patch tables that exist; a set of patches may be partial."""
    root = tree(spark, folder, "tables")
    rows = scans.scan_patches(spark, [f"{root}/patches/patch_{k}.csv" for k in (0, 1, 2, 9)])
    return rows.select("model", "dseed", "mseed", long_of("generation"), "metric_name", r6("metric_value"))


@query(f"""WITH {report.POOLED_SQL}
SELECT metric, generator, {', '.join(f"nullif(coalesce(max({report._FORMAT_SQL}) FILTER (generation = {g}), ''), '') AS gen_{g}" for g in (0, 5, 10, 19))} FROM pooled GROUP BY metric, generator""")
def exported_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A print table as its export has it, read back."""
    paths = sinks.export_tables({"metrics": report.metric_table(spark, folder)}, f"{sinks.checkpoint_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}")
    return spark.read.option("header", True).csv(paths[0])


@query(f"""WITH {v.TRAJECTORY_SQL}, q AS ({_QUALITY_SQL})
SELECT generator, dseed, mseed, CAST(generation AS BIGINT) AS generation, {s6('auroc_like')}, {s6('f.value', 'flag_rate')}
FROM trajectory LEFT JOIN (SELECT * FROM q WHERE metric = 'flag_rate') f USING ({KEY_SQL})""")
def tree_utility_with_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Utility documents beside one quality metric, of whose tables only that column is parsed."""
    root, index = tree(spark, folder, "tables"), tree_index(spark, folder, "tables")
    quality = scans.scan_quality(spark, root, index.files("quality"), metrics=["flag_rate"]).drop("metric").withColumnRenamed("value", "flag_rate")
    rows = scans.scan_utility(spark, root).select(*KEYS, F.col("tstr_auroc").alias("auroc_like")).join(quality, KEYS, "left")
    return rows.select(*v.CHAIN, long_of("generation"), r6("auroc_like"), r6("flag_rate"))
