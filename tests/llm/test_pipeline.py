"""The pipeline against plain Python, stage by stage."""

import math
import re
from collections import Counter

import corpus_pipeline as cp
import numpy as np
from fixtures import documents, empty
from test_near import plain_fingerprint, plain_groups
from test_text import plain_tokens

from tabaudit.llm import mixing, quality

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = docs.collect()
    text, meta = np.array([quality.text_features(r["text"]) for r in rows]), np.array([quality.metadata_features(r["lang"], r["source"], r["n_chars"]) for r in rows])
    kept = [r for r, s in zip(rows, model.scores(text, meta)[2]) if s >= quality.KEEP]
    stage = cp.STAGES[0][1](spark, docs, FOLDER)
    assert stage.columns == docs.columns and sorted(stage.collect()) == sorted(kept)

    ids = [r["doc_id"] for r in kept]
    groups = plain_groups([plain_fingerprint(r["text"]) for r in kept], ids)
    kept = [r for r, g in zip(kept, groups) if r["doc_id"] == g]
    stage = cp.STAGES[1][1](spark, stage, FOLDER)
    assert stage.columns == docs.columns and sorted(stage.collect()) == sorted(kept)

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert all(items)
    before, kept = len(kept), [r for r in kept if not any(len(i & shingles(r["text"])) >= math.ceil(0.8 * len(i) - 1e-9) for i in items)]
    assert len(kept) < before
    stage = cp.STAGES[2][1](spark, stage, FOLDER)
    assert stage.columns == docs.columns and sorted(stage.collect()) == sorted(kept)

    mixed, names = mixing.mix(spark.createDataFrame(kept, docs.schema))
    copies = {r["doc_id"]: r[names["copies"]] for r in mixed.collect()}
    stage = cp.STAGES[3][1](spark, stage, FOLDER)
    assert stage.columns == docs.columns
    assert Counter(r["doc_id"] for r in stage.collect()) == Counter({k: v for k, v in copies.items() if v})

    want = plain_tokens(sorted((r["doc_id"], r["text"]) for r in stage.collect()))
    assert sorted(tuple(r) for r in cp.STAGES[4][1](spark, stage, FOLDER).collect()) == want
    assert sorted(tuple(r) for r in cp.run(spark, FOLDER).collect()) == want


def test_stages_survive_odd_tables(spark):
    for docs in (documents(spark), empty(spark)):
        for _, stage in cp.STAGES[:-1]:
            found = stage(spark, docs, FOLDER)
            assert found.columns == docs.columns
            assert found.count() <= 3 * docs.count()
            docs = found
        assert cp.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
