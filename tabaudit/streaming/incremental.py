"""Rule flags for newly arrived generation files.

The audit skips files it has already finished.  As a file stream this needs no
bookkeeping of its own: the stream's checkpoint remembers which files were
read, and each run processes what is new and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabaudit import model as m
from tabaudit.functions.keys import generation_of, with_chain_keys
from tabaudit.operators import rules
from tabaudit.sources.scans import record_schema, without_nan

FILE = ["generator", "dseed", "mseed", "folder", "generation"]


def record_stream(spark: SparkSession, root: str, schema: T.StructType | None = None, generators: list[str] | None = None) -> DataFrame:
    """Stream of readable records below ``root/<generator>/<chain>/SD``.

    Every generator variant that has a folder is a stream of its own, since
    variants differ in their columns, and all are one union; columns that a
    variant lacks are null.  ``schema`` holds for all variants, else the core
    variants have the core columns and the others all of them.  A checkpoint
    belongs to one list of variants: name ``generators`` where folders may come
    later.
    """
    out: DataFrame | None = None
    for generator in generators or list(m.GENERATOR_VARIANTS):
        columns = ["ID", *m.CORE_FEATURES] if generator.endswith("_CORE") else m.RECORD_COLUMNS
        try:
            rows = (
                spark.readStream.schema(schema or record_schema(columns)).option("header", True).option("enforceSchema", False)
                .csv(f"{root}/{generator}/*/SD/*.csv")
            )
        except Exception as missing:  # a variant without files yet
            if "PATH_NOT_FOUND" in str(missing):
                continue
            raise
        out = rows.select("*", "_metadata.file_path") if out is None else out.unionByName(rows.select("*", "_metadata.file_path"), allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no record files below {root}")
    parts = F.split(F.col("file_path"), "/")
    placed = out.select("*", F.element_at(parts, -3).alias("folder"), generation_of(F.element_at(parts, -1)).alias("generation")).drop("file_path")
    return without_nan(with_chain_keys(placed.filter(F.col("generation").isNotNull())).withColumnsRenamed(m.RENAMED_AT_INGEST))


def flag_new_files(
    records: DataFrame, target: str, checkpoint: str, rule_list: list[rules.Rule] = rules.RULES
) -> StreamingQuery:
    """Append the rule detail of all files not seen before to ``target``; returns when they are done.

    ``checkpoint`` has to be on storage that all executors share.
    """
    detail = rules.rule_rows(rules.apply_rules(records, rule_list), [*FILE, "ID"], rule_list)
    query = (
        detail.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .partitionBy("generator").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
