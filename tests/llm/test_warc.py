"""WARC archives: what is written comes back, whatever payloads hold."""

import base64
import hashlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tabaudit.llm import warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, n int, packed string, last_id long"


def plain(rows, least=0):
    largest = defaultdict(lambda: None)
    for i, payload in rows:
        if i is not None:
            largest[payload] = max(i, largest[payload]) if largest[payload] is not None else i
    out = []
    for i, payload in rows:
        top = largest[payload]
        revisit = len(payload) >= least and top is not None and (i is None or i < top)
        out.append((str(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", str(top) if revisit else "None"))
    return sorted(out)


def told(frame):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in frame.collect())


def test_query_equals_brute_force(spark):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert told(entry.queries()["op5_warc"](spark, FOLDER)) == plain(rows)


TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n"
PAGES = [
    (1, "http://a/é b\r\nX: y", "same"), (2, None, "same"), (5, "http://c", "same"), (None, "u", "same"), (None, None, None), (3, "", ""), (4, "http://d", None),
    (6, "http://e", TRAP * 40), (7, "http://f", "x" * 70_000 + TRAP), (8, "http://g", "WARC/1.0\r\nno header"), (9, "http://h", "é\x00𝔘" * 5000), (9, "http://h", "é\x00𝔘" * 5000),
]


@pytest.mark.parametrize(("range_bytes", "file_bytes"), [(500, 1 << 26), (3000, 20_000), (1 << 23, 1 << 26)])
def test_traps_and_defined_cases(spark, range_bytes, file_bytes):
    pages = spark.createDataFrame([(*p, "d", 1, "p", 3) for p in PAGES], SCHEMA).coalesce(2)
    archives = warc.write_archives(pages, file_bytes=file_bytes)
    found = warc.read_archives(archives.files, range_bytes=range_bytes)
    assert told(found) == plain([(i, (h or "").encode()) for i, _, h in PAGES])
    for r in found.where("record_type = 'response'").collect():
        assert bytes(r["payload"]) in {(h or "").encode() for i, _, h in PAGES if i == r["page_id"]}
    assert {r["url"] for r in found.where("page_id = 1").collect()} == {"http://a/%C3%A9%20b%0D%0AX:%20y"}


def test_least_revisit_and_empty_table(spark):
    pages = spark.createDataFrame([(*p, "d", 1, "p", 3) for p in PAGES], SCHEMA)
    small = warc.read_archives(warc.write_archives(pages, least_revisit=5).files)
    assert told(small) == plain([(i, (h or "").encode()) for i, _, h in PAGES], least=5)
    assert warc.read_archives(warc.write_archives(pages.limit(0)).files).count() == 0


def test_what_lies_behind_a_break_is_left_out(spark, tmp_path):
    good = [warc.record(i, "u", b"p" * 50, None) for i in range(6)]
    data = b"".join(good[:3]) + b"garbage" + b"".join(good[3:])
    (tmp_path / "x.warc").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc", len(data))], "file string, size long")
    assert sorted(r["page_id"] for r in warc.read_archives(files, range_bytes=200).collect()) == [0, 1, 2]


@pytest.mark.parametrize("range_bytes", [500, 1 << 23])
def test_headers_of_any_length(spark, range_bytes):
    pages = [(1, "http://a", "before"), (2, "data:," + "é" * 40_000, "long"), (3, "http://b", "after" + TRAP), (4, "http://" + "x" * 300_000, "WARC/1." * 50_000)]
    frame = spark.createDataFrame([(*p, "d", 1, "p", 3) for p in pages], SCHEMA).coalesce(1)
    found = warc.read_archives(warc.write_archives(frame).files, range_bytes=range_bytes)
    assert told(found) == plain([(i, h.encode()) for i, _, h in pages])
    assert {r["page_id"]: r["url"] for r in found.collect()} == {i: warc._target(u) for i, u, _ in pages}


def test_a_written_file_that_breaks_off_is_an_error(spark, tmp_path):
    good = [warc.record(i, "u", b"p" * 50, None) for i in range(6)]
    data = b"".join(good[:3]) + b"garbage" + b"".join(good[3:])
    (tmp_path / "x.warc").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc", len(data), 6)], "file string, size long, records long")
    with pytest.raises(ValueError, match="6 written"):
        warc.read_archives(files, range_bytes=200)
