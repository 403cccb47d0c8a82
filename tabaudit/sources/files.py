"""Files of executors: any store that pyarrow knows, first lines, and trees of many small files."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_location(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if re.match(r"^\w[\w+.-]*:/", uri):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def first_line(uri: str, chunk: int = 1 << 14) -> str:
    """The first line of a text file; no more is read than holds it."""
    store, path = open_location(uri)
    held = b""
    with store.open_input_file(path) as file:
        while b"\n" not in held:
            more = file.read(chunk)
            if not more:
                break
            held += more
    return held.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")


def with_header(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``header``, the column names in the first line of each CSV file; null for other files."""
    columns = files.columns
    at = columns.index(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(at).to_pylist():
                line = first_line(uri) if uri.lower().endswith(".csv") else None
                found.append(None if line is None else [c.strip() for c in next(csv.reader([line]), [])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*columns, "header"])

    fields = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInArrow(read, f"{fields}, header array<string>")


def write_files(rows: DataFrame, path: Column, line: Column, order: list[str | Column], header: str | None = None, dealt: bool = False) -> DataFrame:
    """Write one text file per value of ``path``, its lines in ``order``; returns (``path``, ``lines``).

    All lines of a file come to one task, which streams them into it; a file
    appears under its name when it is whole, so a repeated task does no harm.
    ``dealt`` rows lie so already, file by file and each file in one partition:
    then no text is shuffled.  Their order goes to the tasks too, so that what
    makes it is not pruned from the plan, and the dealing with it.
    """
    listed = rows.select(path.alias("path"), line.alias("line"), *[(F.col(o) if isinstance(o, str) else o).alias(f"order_{i}") for i, o in enumerate(order)])
    sorted_rows = listed if dealt else listed.repartition("path").sortWithinPartitions("path", *[f"order_{i}" for i in range(len(order))]).select("path", "line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stream, written, done = None, None, 0, []

        def close() -> None:
            stream.close()
            store.move(temporary, final)
            done.append((current, written))

        for batch in batches:
            first, runs = 0, pc.run_end_encode(batch.column(0), run_end_type=pa.int64())
            for uri, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if uri != current:
                    if stream is not None:
                        close()
                    store, final = open_location(uri)
                    folder, name = final.rsplit("/", 1)
                    store.create_dir(folder, recursive=True)
                    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
                    current, stream, written = uri, store.open_output_stream(temporary), 0
                    if header is not None:
                        stream.write(f"{header}\n".encode())
                stream.write("".join(f"{text}\n" for text in batch.column(1).slice(first, end - first).to_pylist()).encode())
                written, first = written + end - first, end
        if stream is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "lines"])

    return sorted_rows.mapInArrow(write, "path string, lines bigint")


def write_csv_files(rows: DataFrame, path: Column, columns: list[str], order: list[str | Column], dealt: bool = False) -> DataFrame:
    """One CSV file with header per value of ``path``."""
    line = F.to_csv(F.struct(*[F.col(c) for c in columns]), {"nullValue": "", "emptyValue": "\"\""})
    return write_files(rows, path, line, order, ",".join(columns), dealt)
