"""Decontamination, bounded ring and mixing."""

import math
import re
import zlib
from collections import Counter, defaultdict

import compare
import pytest
from fixtures import ROWS, documents, empty, row

import __spark_entry__ as entry
from tabaudit.llm import decontamination, mixing, sharding
from tabaudit.llm.ranking import with_global_rank

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", ["op1_decontamination", "op9_mixing"])
def test_query_equals_sql(spark, duck, name):
    assert compare.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_native_operators_run_no_python(spark):
    for name in ("op1_decontamination", "op8_bounded_ring"):
        assert not re.search("Python|Pandas|Arrow(?!Columnar)", plan_of(entry.queries()[name](spark, FOLDER)))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, size int")


def test_contamination_defined_cases(spark):
    bench = items(spark, [(1, "beta gamma delta epsilon zeta eta theta", 1), (2, "Kurz!", 1), (3, None, 1), (4, "", 1), (None, "some words in it", 1), (5, "gamma delta epsilon zeta eta nothing else matches", 1)])
    found = {(r["id"], r["item"]): (r["matched"], r["n"]) for r in decontamination.contamination(documents(spark), bench).collect()}
    assert found == {(1, 1): (3, 3), (2, 1): (3, 3), (9, 2): (1, 1), (None, None): (1, 1)}
    kept = decontamination.without_contaminated(documents(spark), bench)
    assert kept.columns == documents(spark).columns
    # the row without id and without text stays, though another row without id is contaminated
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((r[0] or 0, r[1] or "") for r in ROWS if r[0] not in (1, 2, 9) and r[1] != ROWS[5][1])


def test_contamination_of_empty_tables(spark):
    some = items(spark, [(1, "one two three four five six", 1)])
    assert decontamination.contamination(empty(spark), some).count() == 0
    assert decontamination.contamination(documents(spark), some.limit(0)).count() == 0
    assert decontamination.without_contaminated(documents(spark), some.limit(0)).count() == len(ROWS)


def test_contamination_reaches_the_threshold_exactly(spark):
    words = [f"w{i}" for i in range(14)]  # ten shingles
    docs = []
    for broken in range(4):  # each broken shingle at the end costs one
        docs.append((broken, " ".join(f"pad{j}" for j in range(5000)) + " " + " ".join(words[: 14 - broken])))
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, [(1, " ".join(words), 1)]))
    assert sorted((r["id"], r["matched"]) for r in found.collect()) == [(0, 10), (1, 9), (2, 8)]


def test_shuffled_sketches_give_the_same(spark, monkeypatch):
    bench = items(spark, [(1, "beta gamma delta epsilon zeta eta theta", 1), (2, "Kurz!", 1)])
    want = sorted(map(tuple, decontamination.contamination(documents(spark), bench).select("id", "item").collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontamination.contamination(documents(spark), bench).select("id", "item").collect())) == want


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("pmod(id * 7919, 1000) AS v", "id AS rank_part")
    assert {r["v"]: r["place"] for r in with_global_rank(df, ["v"], "place").collect()} == {v: v for v in range(1000)}


def law(rows, shards):
    counts, slots = Counter(), defaultdict(list)
    for r in rows:
        counts[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1


def test_bounded_ring(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["id"]: r for r in sharding.bounded_ring(docs).collect()}
    law(got.values(), 16)
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    again = {r["id"]: r["shard"] for r in sharding.bounded_ring(docs.repartition(7)).collect()}
    assert again == {k: r["shard"] for k, r in got.items()}


def test_bounded_ring_defined_cases(spark):
    rows = sharding.bounded_ring(documents(spark), shards=3).collect()
    assert len(rows) == len(ROWS)
    law(rows, 3)
    assert sharding.bounded_ring(empty(spark)).count() == 0
    law(sharding.bounded_ring(documents(spark, [row(1, "x")] * 40), shards=16).collect(), 16)


def test_layout_moves_only_what_overflows():
    # arcs of shards 0, 1, 0, 2: shard 0 is full after its first arc, its second goes on to 2
    assert sharding.lay_out([5, 1, 2, 1, 0], [0, 1, 2, 3, 0], [0, 1, 0, 2], [5, 2, 2]) == [(0, 5, 0, 0), (5, 6, 1, 0), (8, 9, 2, 0), (6, 7, 2, 1), (7, 8, 1, 1)]


def test_pieces_cover_the_ring():
    pieces = sharding.pieces_of([p for p, _ in sharding.ring(3, 5)])
    assert pieces[0][1] == -(1 << 63) and pieces[-1][2] == (1 << 63) - 1
    assert all(a[2] + 1 == b[1] for a, b in zip(pieces, pieces[1:]))


def test_mixing_defined_cases(spark):
    mixed, names = mixing.mix(documents(spark))
    assert not set(names.values()) & set(documents(spark).columns)
    rows = mixed.collect()
    words = Counter()
    for r in ROWS:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weight = dict(zip(["S1", "s1", "s2", "ß", None], [1, 2, 3, 1, 2]))
    total, target, full = sum(words.values()), {}, set()
    while True:
        rest, open_weight = total - sum(3 * words[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s in weight if s not in full and weight[s] * rest > 3 * words[s] * open_weight}
        if not more:
            break
        full |= more
    target = {s: 3.0 * words[s] if s in full else weight[s] * rest / open_weight for s in weight}
    for r in rows:
        assert math.isclose(r[names["target"]], target[r["source"]]) and r[names["source_size"]] == words[r["source"]]
        rate = target[r["source"]] / words[r["source"]] if words[r["source"]] else 0
        assert r[names["copies"]] in (math.floor(rate), math.floor(rate) + 1) and r[names["copies"]] <= 3
    assert mixing.emit(mixed, names["copies"]).count() == sum(r[names["copies"]] for r in rows)
    mixed, names = mixing.mix(empty(spark))
    assert mixed.count() == 0 and mixing.emit(mixed, names["copies"]).count() == 0


def test_mixing_without_any_word(spark):
    mixed, names = mixing.mix(documents(spark, [row(1, None), row(2, "", source="s2")]))
    assert {r[names["target"]] for r in mixed.collect()} == {0.0}
