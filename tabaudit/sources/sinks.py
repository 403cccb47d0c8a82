"""Writing stage tables, and cutting lineage where a result is reused."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tabaudit import model as m


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Taken from ``spark.checkpoint.dir``; only a local session that names none
    gets a temporary folder, because a machine-local folder would not survive
    the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; later reads do not recompute it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet below the checkpoint folder: for wide tables, of which readers take some columns."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, by: list[str], order: list[str], buckets: int) -> DataFrame:
    """``df`` as a table below the checkpoint folder, dealt ``by`` these columns: windows over them read it without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark).rstrip('/')}/{table}"
    # sorted files are smaller
    dealt = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by, *order)
    dealt.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, replace_all: bool = False) -> None:
    """Parquet stage table; a rerun replaces only the partitions it produces."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        if not replace_all:
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def printed_names(df: DataFrame) -> DataFrame:
    """Back to the column names of the exports."""
    return df.withColumnsRenamed({clean: raw for raw, clean in m.RENAMED_AT_INGEST.items()})


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; ``single_file`` only for print tables of a few rows."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def export_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder per named print table."""
    paths = []
    for name, table in tables.items():
        path = f"{folder}/{name}"
        write_csv(table, path, single_file=True)
        paths.append(path)
    return paths


def _location(spark: SparkSession, path: str):
    """The file system of ``path`` and the path on it."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _location(spark, path)
    return store.exists(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver; it appears under its name when it is whole."""
    store, final = _location(spark, path)
    _, beside = _location(spark, f"{path}.part")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(final, False)
    store.rename(beside, final)


def write_upsert(new: DataFrame, path: str, keys: list[str], run_order: str) -> None:
    """Merge ``new`` into the table at ``path``; the latest run wins per key.

    The merged table is written beside the old one, and two renames swap them:
    until the last one the old table is whole, at ``path`` or at ``path.old``,
    from where the next run takes it.
    """
    from tabaudit.operators.pooling import upsert

    spark = new.sparkSession
    store, current = _location(spark, path)
    _, kept = _location(spark, f"{path}.old")
    _, beside = _location(spark, f"{path}.new")
    if not store.exists(current) and store.exists(kept):  # a run ended between the renames
        store.rename(kept, current)
    merged = upsert(spark.read.parquet(path), new, keys, run_order) if store.exists(current) else new
    merged.write.mode("overwrite").parquet(f"{path}.new")
    store.delete(kept, True)
    if store.exists(current):
        store.rename(current, kept)
    store.rename(beside, current)
    store.delete(kept, True)
