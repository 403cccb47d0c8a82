"""Small helpers of the corpus operators: shared folders, lineage cuts, names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.sources.sinks import checkpoint_folder, reliable

#: What separates words, as a class of Java, Python and DuckDB expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as URI, below the one that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared checkpoint folder: its lineage ends there."""
    return reliable(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; works on executors, for any store pyarrow knows."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if re.match(r"^\w[\w+.-]*:/", uri):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def publish(store: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file into place; a repeated task replaces the same bytes."""
    if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(final).type != pafs.FileType.NotFound:
        store.delete_file(final)
    store.move(temporary, final)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever its letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    return F.translate(text, _UPPER, _LOWER)


def col(name: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col(f"`{name}`")


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one slice hold about ``limit`` bytes; one row at least."""
    for batch in batches:
        at = 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            end, held = at + 1, int(sizes[at])
            while end < batch.num_rows and held + int(sizes[end]) <= limit:
                held += int(sizes[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
