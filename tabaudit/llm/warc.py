"""WARC archives: writing records with revisits, and reading them by verified boundaries.

Writing: equal payloads (by SHA-1) of at least ``least_revisit`` bytes are kept
once; the row with the largest id is the response and others are revisits of
it. Only digests are grouped, with partial aggregation. Each task writes files
of bounded size into the shared folder under names of its own attempt, and
returns their names, so a repeated task does no harm.

Reading: a file is read in ranges by many tasks. A task lists each place in
its range where a record header can be parsed, with the offset that header
gives for its successor. Payloads may hold such places too. Within a range the
chains are followed at once; from range to range, pointer jumping doubles the
reach of every link until all that can be reached from the file's start is
known. Only those records are read.

Defined cases: a null payload is empty, a null URL is ``about:blank``; a null
id is written and comes back as null, never as response for others; rows that
share payload and the largest id are all responses; what lies behind a break
of a file's chain is not returned, and is an error if the file is one of a
manifest; headers have any length; no rows, no files, an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import col, cut, open_store, shared_folder

MAGIC = b"WARC/1."
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
#: How far behind its range a task reads at first; it reads on until the last header there ends.
HEADER_BYTES = 64 << 10
_TAIL = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.IGNORECASE | re.MULTILINE)


@dataclass(frozen=True)
class Archives:
    """Written files: a table of their URIs, sizes and numbers of records."""

    folder: str
    files: DataFrame


def _target(url: str | None) -> str:
    """The URL with everything but printing ASCII percent-encoded."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in (url or "").encode()) or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, with the blank lines that end it."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _TAIL + block + _TAIL


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack(p) for p in batch.column("payload").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), packed, batch.column("digest"), batch.column("n_bytes")], names=["id", "url", "packed", "digest", "n_bytes"])


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_revisit: int = 0, file_bytes: int = FILE_BYTES) -> Archives:
    """Write a record for every row below ``folder``."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(col(id_column).cast("long").alias("id"), col(url_column).alias("url"), F.coalesce(F.encode(col(payload_column), "UTF-8"), F.lit(b"")).alias("payload"))
    hashed = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n_bytes": F.octet_length("payload")})
    last = hashed.where(F.col("n_bytes") >= least_revisit).groupBy(F.col("digest").alias("last_digest")).agg(F.max("id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # payloads meet the largest ids of their digests in a shuffle, and are packed for it
    packed = hashed.mapInArrow(_pack, "id long, url string, packed binary, digest binary, n_bytes int")
    linked = packed.join(last, (F.col("digest") == F.col("last_digest")) & (F.col("n_bytes") >= least_revisit), "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") < F.col("last_id")), F.col("last_id"))
    plan = linked.select("id", "url", "packed", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = open_store(folder)
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        stream, names, sizes, records = None, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None or sizes[-1] >= file_bytes:
                    if stream is None:
                        store.create_dir(root, recursive=True)
                    else:
                        stream.close()
                    names.append(f"part-{part:06d}-{len(names):06d}-{attempt}.warc")
                    sizes.append(0)
                    records.append(0)
                    stream = store.open_output_stream(f"{root}/{names[-1]}")
                data = record(row["id"], row["url"], unpack(row["packed"]), row["refers_to"])
                stream.write(data)
                sizes[-1] += len(data)
                records[-1] += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array(sizes, pa.int64()), pa.array(records, pa.int64())], names=["file", "size", "records"])

    manifest = "file string, size long, records long"
    plan.mapInArrow(write, manifest).write.mode("overwrite").parquet(f"{folder}/manifest")
    return Archives(folder, spark.read.schema(manifest).parquet(f"{folder}/manifest"))


def _read_on(f: pa.NativeFile, data: bytes, begin: int, at: int, size: int) -> bytes:
    """``data``, which starts at ``begin``, up to a header's end behind ``data[at]`` or the end of the file."""
    step, searched = HEADER_BYTES, at
    while begin + len(data) < size and data.find(_TAIL, searched) < 0:
        searched = max(at, len(data) - len(_TAIL) + 1)
        data += f.read_at(min(step, size - begin - len(data)), begin + len(data))
        step *= 2
    return data


def successors(data: bytes, places: list[int], origin: int) -> list[int | None]:
    """Where records whose headers begin at ``places`` (ascending) of ``data`` say that the next one begins, as offsets in the file.

    Places before the same header's end share one search, so the work is linear however many there are.
    """
    out: list[int | None] = []
    end, lengths, n = -1, [], 0
    for at in places:
        if end < at:
            end = data.find(_TAIL, at)
            if end < 0:
                return out + [None] * (len(places) - len(out))
            lengths, n = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data[at:end])], 0
            first = at
        while n < len(lengths) and first + lengths[n][0] <= at:
            n += 1
        out.append(origin + end + len(_TAIL) + lengths[n][1] + len(_TAIL) if n < len(lengths) else None)
    return out


def links_of_range(data: bytes, begin: int, end: int, size: int) -> list[tuple[int, int]]:
    """(offset, exit) of each place of the range that may be a record's begin.

    ``data`` starts at ``begin`` and reaches beyond ``end`` as far as the last
    header that begins before it. The exit is the first offset at or behind
    ``end`` on the chain; chains that break within the range have none.
    """
    places, at = [], data.find(MAGIC, 0, end - begin + len(MAGIC) - 1)
    while at >= 0:
        places.append(at)
        at = data.find(MAGIC, at + 1, end - begin + len(MAGIC) - 1)
    found = [(begin + at, following) for at, following in zip(places, successors(data, places, begin)) if following is not None and following <= size]
    exits: dict[int, int] = {}
    for offset, following in reversed(found):
        target = following if following >= end else exits.get(following)
        if target is not None:
            exits[offset] = target
    return sorted(exits.items())


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    parts = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    return parts.repartition(max(1, parts.count()))  # a task for each range: rows are small, the work is not


def reachable(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, size, offset): the first true record in each range that has one."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = open_store(row["file"])
            begin, end = row["begin"], min(row["begin"] + range_bytes, row["size"])
            with store.open_input_file(path) as f:
                data = f.read_at(min(end + HEADER_BYTES, row["size"]) - begin, begin)
                if (last := data.rfind(MAGIC, 0, end - begin + len(MAGIC) - 1)) >= 0:
                    data = _read_on(f, data, begin, last, row["size"])
            links = links_of_range(data, begin, end, row["size"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["file"]] * len(links), pa.string()), pa.array([row["size"]] * len(links), pa.int64()), pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())],
                names=["file", "size", "offset", "exit"],
            )

    links = cut(_ranges(files, range_bytes).mapInArrow(propose, "file string, size long, offset long, exit long"))
    # a link matters where a chain can enter it: at the file's start or at another's exit
    entered = links.select("file", F.col("exit").alias("offset")).distinct()
    jumps = cut(links.join(entered, ["file", "offset"], "left_semi").unionByName(links.where("offset = 0")).distinct())
    reached = jumps.where("offset = 0").select("file", "size", "offset")
    count = reached.count()
    while count:
        step = reached.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        begun = step.join(jumps.select("file", "size", "offset"), ["file", "offset"])  # the file's end begins no record
        reached = cut(reached.unionByName(begun.select("file", "size", "offset")).distinct())
        onward = jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("beyond"))
        jumps = cut(jumps.join(onward, ["file", "exit"], "left").select("file", "size", "offset", F.coalesce("beyond", "exit").alias("exit")))
        before, count = count, reached.count()
        if count == before:
            break
    if "records" in files.columns:
        _all_reached(files, reached.join(links.drop("size"), ["file", "offset"]))
    return reached


def _all_reached(files: DataFrame, chain: DataFrame) -> None:
    """Fails unless the chain of every written file leads to its end."""
    short = files.where("size > 0").join(chain.where("exit = size").select("file"), "file", "left_anti")
    if found := short.select("file", "records").take(5):
        raise ValueError("records can't be reached in " + ", ".join(f"{r['file']} ({r['records']} written)" for r in found))


_NAME = re.compile(rb"<urn:page:(-?\d+)>")


def parse(data: bytes) -> dict:
    """The fields of one record, digest and length taken from the payload if it is there."""
    head, _, block = data.partition(_TAIL)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    http, _, payload = block[: int(fields[b"Content-Length"])].partition(_TAIL)
    kind = fields[b"WARC-Type"].decode()
    told = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    own = _NAME.fullmatch(fields[b"WARC-Record-ID"])
    refers = _NAME.fullmatch(fields.get(b"WARC-Refers-To", b""))
    length = int(_LENGTH.search(http.replace(b"\r\n", b"\n"))[1])
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told):
        raise ValueError(f"payload of {fields[b'WARC-Record-ID'].decode()} differs from its digest or length")
    return {
        "page_id": int(own[1]) if own else None, "url": fields[b"WARC-Target-URI"].decode(), "payload_bytes": length, "payload_digest": told,
        "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload": payload if kind == "response" else None,
    }


def read_archives(files: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All true records of the files (columns ``file`` and ``size``; with ``records``, as in a manifest, a file that breaks off is an error)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = open_store(row["file"])
            at, stop = row["offset"], (row["offset"] // range_bytes + 1) * range_bytes
            held, out = 0, []
            with store.open_input_file(path) as f:
                window, origin = f.read_at(min(stop + HEADER_BYTES, row["size"]) - at, at), at
                while at < min(stop, row["size"]):
                    if not window.startswith(MAGIC, at - origin):
                        break
                    window = _read_on(f, window, origin, at - origin, row["size"])
                    following = successors(window, [at - origin], origin)[0]
                    if following is None or following > row["size"]:
                        break
                    data = window[at - origin : following - origin] if following - origin <= len(window) else f.read_at(following - at, at)
                    out.append(parse(data))
                    held += len(data)
                    if not payloads:
                        out[-1]["payload"] = None
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        held, out = 0, []
                    at = following
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    starts = reachable(files, range_bytes)
    return starts.repartition(max(1, starts.count())).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
