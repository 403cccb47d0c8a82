"""SimHash groups and the permutation index."""

import numpy as np
import pytest
from fixtures import ROWS, documents, empty, row
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
from tabaudit.llm import permutation_index, simhash
from tabaudit.llm.components import connected_components, forest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, ids):
    group = list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    prints, ids = [plain_fingerprint(r["text"]) for r in docs], [r["doc_id"] for r in docs]
    want = {(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_groups(prints, ids))}
    assert {tuple(r) for r in entry.queries()["op3_simhash"](spark, FOLDER).collect()} == want


def test_near_duplicates_defined_cases(spark):
    got = sorted((str(r["id"]), r["fingerprint"] % (1 << 64), str(r["component"])) for r in simhash.near_duplicates(documents(spark)).collect())
    prints, ids = [plain_fingerprint(r[1]) for r in ROWS], [r[0] for r in ROWS]
    assert got == sorted((str(i), p, str(c)) for i, p, c in zip(ids, prints, plain_groups(prints, ids)))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_deduplicated_keeps_one_row_of_each_group(spark):
    kept = simhash.deduplicated(documents(spark))
    assert kept.columns == documents(spark).columns
    groups = plain_groups([plain_fingerprint(r[1]) for r in ROWS], [r[0] for r in ROWS])
    prints = {plain_fingerprint(r[1]) for r in ROWS}
    rows = kept.collect()
    assert len(rows) == len({g if g is not None else "none" for g in groups}) + 1  # id 6 names two groups
    assert {plain_fingerprint(r["text"]) for r in rows} <= prints
    assert sorted(r["doc_id"] or 0 for r in rows).count(6) == 2
    assert simhash.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [4, 4096])
def test_dense_cluster_in_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {base}
    for _ in range(150):  # chains of small steps: every link counts
        prints.add(sorted(prints)[int(rng.integers(len(prints)))] ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    prints |= {int(x) for x in rng.integers(1 << 62, size=100)}
    values = sorted(prints)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {r["vertex"]: r["component"] for r in connected_components(simhash.linked(frame, chunk=chunk)).collect()}
    want = plain_groups(values, values)
    assert [got.get(v, v) for v in values] == want


def test_pivots_lose_no_link():
    rng = np.random.default_rng(5)
    prints = np.unique(np.concatenate([rng.integers(1 << 62, size=200, dtype=np.uint64), np.uint64(99) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    table = np.bitwise_count(prints[:, None] ^ simhash.pivots()[None]).astype(np.int8)
    a, b = simhash.links_within(prints, table, 3)
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    assert got == {frozenset((int(x), int(y))) for i, x in enumerate(prints) for y in prints[:i] if int(x ^ y).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(1000, 1003).selectExpr("id AS a", "id + 1 AS b")).repartition(9)
    got = {r["vertex"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1004), 1000)}
    assert connected_components(edges.limit(0)).count() == 0
    a, b = forest(np.array([5, 3, 9]), np.array([4, 5, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {4: 3, 5: 3, 9: 8}


def recall(rows, ids, vectors, queries, k=10):
    hit = 0
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        true = [int(ids[i]) for i in order if ids[i] != q][:k]
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, min(k, len(ids) - 1) + 1))
        assert all(np.isclose(r["score"], d[ids == r["vec_id"]][0], rtol=0, atol=1e-12) for r in own)
        hit += len(set(true) & {r["vec_id"] for r in own})
    return hit / (len(queries) * k)


def test_recall_against_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, vectors = frame["vec_id"].to_numpy(), np.array(frame["embedding"].tolist(), np.float64)
    rows = entry.queries()["op4_permutation_index"](spark, folder).collect()
    assert recall(rows, ids, vectors, [i for i in ids if i % 100 == 0]) >= 0.9


def test_recall_with_copies_and_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    loose, cluster = rng.normal(size=(700, 24)), rng.normal(size=24) + 0.01 * rng.normal(size=(500, 24))
    vectors = np.vstack([loose, cluster, np.repeat(rng.normal(size=(1, 24)), 300, axis=0)]).astype(np.float32).astype(np.float64)
    ids = rng.permutation(len(vectors))
    frame = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, score int")
    rows = permutation_index.nearest_neighbours(frame, F.col("id") % 25 == 0, block=300, query_block=20).collect()
    assert recall(rows, ids, vectors, [i for i in ids if i % 25 == 0]) >= 0.9


def test_index_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (200, [3.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in permutation_index.nearest_neighbours(frame, F.col("id") % 100 == 0).collect())
    root = 2**0.5
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 200), (200, 1, 0), (200, 2, 0), (200, 3, 1), (200, 4, 2)]
    assert np.allclose([s for *_, s in got], [root, root, 2, 2, 2, 10**0.5, 10**0.5])
    assert permutation_index.nearest_neighbours(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert permutation_index.nearest_neighbours(frame, F.col("id") == 77).count() == 0
    assert row(1, "x")[0] == 1


def test_own_rows_take_no_neighbours_places(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    own = [(0, (centre + rng.normal(size=16) * 1e-3).tolist()) for _ in range(600)]
    others = [(i, (centre + rng.normal(size=16) * 0.5).tolist()) for i in range(1, 13)] + [(i, rng.normal(size=16).tolist()) for i in range(13, 60)]
    frame = spark.createDataFrame(own + others, "vec_id long, embedding array<double>")
    found = permutation_index.nearest_neighbours(frame, F.col("id") == 0, pivots=16, nearest=8).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 11)) and 0 not in {r["vec_id"] for r in found}
    assert {r["vec_id"] for r in found} <= set(range(1, 13))
