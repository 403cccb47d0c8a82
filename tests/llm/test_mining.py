"""Hard negatives, SpotSigs and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib

import compare
import numpy as np
import pytest
from fixtures import documents, empty, row

from tabaudit.llm import hard_negatives, periodic_runs, queries, spotsigs

FOLDER = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# --------------------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score double, id string, `a.b` int, rank int, vector string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, lab, -1.0, "own", 7, 1, "mine") for i, v, lab in rows], VECTORS)


def plain_negatives(rows, positives=5, negatives=10):
    whole = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows]
    out = []
    for anchor, label, own in whole:
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i, lab) for i, lab, v in whole if i != anchor)
        for k, (s, p, _) in enumerate([r for r in scored if r[2] == label][:positives], 1):
            fit = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(anchor, k, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("largest,block", [(0.5, 64), (3.0, 1000), (900.0, 17), (200_000.0, 64)])
def test_negatives_equal_plain_python(spark, largest, block):
    rng = random.Random(int(largest))
    rows = [(i, [rng.uniform(-largest, largest) for _ in range(8)], rng.choice([0, 0, 0, 1, 2])) for i in range(400)]
    rows += [(1000 + i, rows[i][1], rows[i + 1][2]) for i in range(50)]  # copies: ties
    found = hard_negatives.mine(vector_table(spark, rows).repartition(3), queries.F.col("id") % 100 == 0, block=block)
    want = plain_negatives(rows)
    assert len(want) > 100
    assert sorted(tuple(r) for r in found.collect()) == want


def test_packed_fields_hold_the_extremes():
    for bias in (1, 100, 511, 512, 5_000, 10_000_000, 260_000_000):
        vectors = np.array([[bias] * 64, [-bias] * 64, [bias, -bias] * 32, [0] * 64, [1] + [0] * 63], np.int64)
        packed = hard_negatives.Packed(vectors, bias)
        assert (packed.scores(vectors) == vectors.astype(object) @ vectors.T.astype(object)).all(), bias
    assert hard_negatives.Packed(vectors, 100).fields == 2 and not hard_negatives.Packed(vectors, 260_000_000).fields


def test_negatives_of_odd_tables(spark):
    asks = queries.F.col("id") % 100 == 0
    assert hard_negatives.mine(vector_table(spark, []), asks).count() == 0
    odd = [(None, [1.0, 1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 0.0], 2), (500, [1.0, 2.0], None), (600, [], 1)]
    assert hard_negatives.mine(vector_table(spark, odd), asks).count() == 0
    usable = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2), (4, [0.0, 0.0], 2), (5, [9.0, 9.0, 9.0], 2)]
    found = hard_negatives.mine(vector_table(spark, odd + usable), asks).collect()
    # a repeated positive and a repeated negative count one by one; a score above the band doesn't
    assert sorted((r["positive_rank"], r["positive_id"], r["rank"], r["negative_id"]) for r in found) == [(1, 1, 1, 2), (1, 1, 2, 2), (2, 1, 1, 2), (2, 1, 2, 2)]
    assert hard_negatives.mine(vector_table(spark, [(1, [1.0], 1)]), asks).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(vector_table(spark, [(0, [1e30], 1), (1, [1e30], 1)]), asks)


def test_negatives_equal_sql(spark):
    duck = compare.connect(FOLDER)
    name = "op11_hard_negatives"
    assert compare.compare(spark, duck, name, queries.QUERIES[name], queries.SQL[name], FOLDER) is None


# --------------------------------------------------------------------------- SpotSigs


def plain_signatures(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lowered)
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [v for v in words[i + 1 :] if v not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add(" ".join([w, *chain]))
    n = spotsigs.CHAIN + 1
    return found or {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)) if words}


def plain_compared(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    digest = lambda s: hashlib.sha256("\n".join(sorted(s, key=str.encode)).encode()).hexdigest()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        own, new, other = plain_signatures(text), plain_signatures(changed), plain_signatures(following)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(own), digest(new), like(own, new), like(own, other), len(own)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_fingerprints_equal_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = plain_compared([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = queries.QUERIES["op12_spotsigs"](spark, FOLDER).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    edit, following = [r["near_edited"] for r in found if r["n_chars"] > 300], [r["near_next"] for r in found if r["n_chars"] > 300]
    assert sum(edit) / len(edit) > 0.4 and sum(following) / len(following) < 0.1
    texts = {}
    for r, d in zip(sorted(found), sorted(docs.collect(), key=lambda d: d["doc_id"])):
        assert texts.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]
    # buckets of any size, in any order of the rows
    again = spotsigs.against_next(docs.repartition(7), bucket_bytes=5_000)
    assert sorted(map(tuple, again.collect())) == sorted(want)


def test_fingerprints_equal_sql(spark):
    name = "op12_spotsigs"
    assert compare.compare(spark, compare.connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER) is None


def test_fingerprints_of_odd_tables(spark):
    assert spotsigs.against_next(empty(spark)).count() == 0
    single = spotsigs.against_next(documents(spark, [row(1, "the cat sat on the warm mat")])).collect()
    assert [(r["near_next"], r["n_signatures"]) for r in single] == [(1.0, 1)]
    rows = [row(5, "of the old man and sea again told"), row(5, "of the old man and sea again told"), row(5, None), row(4, ""), row(None, "no id here at all for one"), row(None, None), row(-(2**63), "x"), row(2**63 - 1, "zz " * 200_000)]
    rows += [row(7, "the same row many times over and over")] * 300
    found = spotsigs.against_next(documents(spark, rows).repartition(3)).collect()
    assert len(found) == len(rows)
    copies = [r for r in found if r["id"] == 7]
    assert len(copies) == 300 and sum(r["near_next"] == 1.0 for r in copies) == 299
    assert {r["fingerprint"] for r in found if r["n_chars"] == 0} == {hashlib.sha256(b"").hexdigest()}
    distinct = [r for r in rows if r[0] not in (5, None, 7)]
    got = spotsigs.against_next(documents(spark, distinct)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_compared([r[:2] for r in distinct]))


def test_linked_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "is"] * 60
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(60)]
    for t in list(texts):
        for _ in range(4):
            words = t.split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    docs = documents(spark, [row(i, t) for i, t in enumerate(texts)])
    found = spotsigs.fingerprints(docs)
    sets = {r["fingerprint"]: set(r["signatures"]) for r in found.collect()}
    for i, t in enumerate(texts):
        assert plain_signatures(t) in sets.values()
    names = sorted(sets)
    for threshold in (0.8, 0.5):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and sets[b] and spotsigs.likeness(sets[a], sets[b], threshold) >= threshold}
        got = [(r["left"], r["right"]) for r in spotsigs.linked(found, threshold).collect()]
        assert len(got) == len(set(got)) > 20 and set(got) == want


# --------------------------------------------------------------------------- periodic runs


def plain_runs(words, least=12):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(least, 2 * q) and not any(run[:-p] == run[p:] for p in range(1, q)):
                found.append((i, len(run), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = SPLIT.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_equal_plain_python(spark):
    docs = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    assert len(found) == len(docs)
    short = [r for r in docs if len(SPLIT.findall(r["text"] or "")) < 1500]
    assert len(short) > 150
    for r in short:
        assert found[r["doc_id"]] == plain_row(r["doc_id"], r["text"])
    assert sum(r[1] > 0 for r in found.values()) > 15


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k, n = rng.choice([1, 2, 3, 50]), rng.randint(0, 90)
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            docs.append(words)
        least = rng.choice([12, 12, 5, 2, 1])
        sizes = [len(d) for d in docs]
        got = periodic_runs.runs_of(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), sizes), least)
        base = np.r_[0, np.cumsum(sizes)]
        assert [tuple(r) for r in got.tolist()] == [(s + base[i], length, q) for i, d in enumerate(docs) for s, length, q in plain_runs(d, least)]


def test_runs_of_odd_tables(spark):
    assert periodic_runs.find(empty(spark)).count() == 0
    long = " ".join(["x"] * 300_000)
    rows = [row(1, None), row(1, ""), row(2, " \t\n\x0b\x0c\r "), row(None, "a b " * 9), row(3, "a b " * 9), row(3, "a b " * 9), row(4, long), row(5, "é 　 x " * 6), row(6, "\x1c\x1d y\x85z " * 7)]
    found = sorted(periodic_runs.find(documents(spark, rows).repartition(2)).collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["n_words"]))
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, *_ in rows if i == r["id"] and len(SPLIT.findall(t or "")) == r["n_words"])
        words = SPLIT.findall(text or "")
        if r["id"] == 4:
            assert [tuple(x) for x in r["runs"]] == [(0, 300_000, 1)] and r["collapsed"] == "x"
        else:
            runs = plain_runs(words)
            dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped)
