"""Novelty and copies of records as they arrive: a stream against static tables.

Each record of a micro-batch meets the population's cells and its chain's
training rows by the operators of the batch audit, so nothing is kept between
batches but which files were read.  The flags of a file go to a folder of its
own, (folder, generation), in which a batch replaces the flags of the records
it holds and keeps the others: a file that comes in parts is completed, one
that comes again, under another name or after a crash, gives the same folder,
and neither order nor delay matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabaudit import model as m
from tabaudit.operators import novelty
from tabaudit.sources.sinks import exists

FILE = ["folder", "generation"]


def membership_flags(
    records: DataFrame, pop: novelty.Population, training: DataFrame, chain: list[str], keep: list[str],
    resolutions: list[int] = m.BIN_RESOLUTIONS, broadcast: bool | None = None,
) -> DataFrame:
    """``keep`` and ``metric`` (HR_b<bins>, Copy) of every flagged record of a batch."""
    novel = novelty.novel_rows(records, pop, keep, resolutions, broadcast)
    copied = novelty.copied_rows(records, training, chain, pop.numeric, pop.categorical)
    return novel.unionByName(copied.select(*keep, F.lit("Copy").alias("metric")))


def _held_before(batch: DataFrame, target: str, schema: T.StructType, record: list[str]) -> DataFrame | None:
    """Flags in the folders of a batch's files that belong to none of its records; None where there can be none."""
    spark = batch.sparkSession
    if not exists(spark, target):
        return None
    # names of files, by which no other folder is opened; structs compare missing fields as equal
    file, own = F.struct(*FILE).alias("__file"), F.struct(*record).alias("__record")
    names, held = batch.select(*FILE).distinct().collect(), spark.read.schema(schema).parquet(target)
    for c in FILE:
        held = held.filter(F.col(c).isNull() | F.col(c).isin(sorted({n[c] for n in names if n[c] is not None})))
    keyed = held.select("*", file, own).join(batch.select(file).distinct(), "__file", "left_semi")
    return keyed.join(batch.select(own), "__record", "left_anti").select(*schema.names)


def flag_arrivals(
    records: DataFrame, pop: novelty.Population, training: DataFrame, chain: list[str], target: str, checkpoint: str,
    record_id: str = "ID", resolutions: list[int] = m.BIN_RESOLUTIONS, broadcast: bool | None = None,
) -> StreamingQuery:
    """Write the flags of all files not read before to ``target``; returns when they are done.

    ``records`` is a stream with ``folder``, ``generation`` and ``record_id``.
    """
    keep = [*FILE, *[c for c in chain if c not in FILE], record_id]

    def write(batch: DataFrame, number: int) -> None:
        # a file may have come twice in one batch
        once = batch.dropDuplicates([*FILE, record_id])
        flags = membership_flags(once, pop, training, chain, keep, resolutions, broadcast)
        held = _held_before(once, target, flags.schema, [*FILE, record_id])
        if held is not None:
            flags = flags.unionByName(held)
        flags.repartition(*FILE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FILE).parquet(target)

    query = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
