"""Forms for large inputs, forced on small ones: sketches, selected percentiles, binned densities, strange levels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import distributions as di
from tabaudit.operators import pooling, rules, sketch
from tabaudit.operators.novelty import feature_levels


@pytest.mark.parametrize("words", [1, 8, 1 << 12])
def test_sketch_split_is_exact_whatever_its_width(spark, monkeypatch, words):
    rng = random.Random(words)
    keys = [(rng.randrange(400), rng.choice(["a", "b", None])) for _ in range(300)]
    rows = [(i, rng.randrange(800), rng.choice(["a", "b", None, "c"])) for i in range(2000)] + [(5000 + i, 7, None) for i in range(1000)]
    monkeypatch.setattr(sketch, "_words", lambda size: words)
    known, table = spark.createDataFrame(keys, "k int, t string"), spark.createDataFrame(rows, "id int, k int, t string")
    for alarms in (100_000, 0):  # broadcast, shuffled
        monkeypatch.setattr(sketch, "BROADCAST_ALARMS", alarms)
        inside, outside = sketch.split(table, known, ["k", "t"], 300)
        held = set(keys)
        assert sorted(r["id"] for r in inside.collect()) == sorted(i for i, k, t in rows if (k, t) in held)
        assert sorted(r["id"] for r in outside.collect()) == sorted(i for i, k, t in rows if (k, t) not in held)


def test_sketch_is_bounded_and_few_keys_pass_it_wrongly(spark):
    assert sketch._words(10**12) == sketch.MOST_WORDS and sketch._words(0) == 1
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    words = sketch._words(40_000)
    bits = sketch.sketch(keys, ["k"], words)
    assert bits.count() <= words
    probed = sketch._placed(spark.range(40_000, 80_000).withColumnRenamed("id", "k"), ["k"], words).join(bits, "__word")
    wrong = probed.filter(F.col("__set").bitwiseAND(F.col("__bits")) == F.col("__bits")).count()
    assert wrong / 40_000 < 0.05


def test_selected_percentiles_equal_sorting(spark):
    rng = np.random.default_rng(4)
    series = {
        "even": rng.uniform(-5, 5, 3000), "outlier": np.r_[rng.normal(0, 1, 3000), 1e12, -1e12], "few": np.r_[np.full(500, 2.0), 3.0],
        "one": np.array([7.0]), "steps": rng.integers(0, 40, 4000).astype(float), "same": np.full(300, -1.5),
    }
    rows = [(k, float(x)) for k, xs in series.items() for x in xs]
    counts = spark.createDataFrame(rows, "feature string, value double").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    points = {"p_lo": 0.005, "p_hi": 0.995, "med": 0.5, "first": 0.0, "last": 1.0}
    for limit in (0, 10**9):  # searched, in one window
        found = {r["feature"]: r for r in di.percentiles(counts, ["feature"], points, in_one_task=limit).collect()}
        assert set(found) == set(series)
        for k, xs in series.items():
            assert found[k]["n"] == len(xs)
            for name, p in points.items():
                assert found[k][name] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12), (limit, k, name)


def test_binned_density_stays_within_its_bound(spark):
    rng = np.random.default_rng(5)
    rows = [(f, float(x)) for f, xs in {"a": rng.normal(50, 8, 800), "b": rng.exponential(0.2, 800)}.items() for x in xs]
    counts = spark.createDataFrame(rows, "feature string, value double").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("series", F.lit("real"))
    ranges = di.clip_range(counts, ["feature"], ["series"])
    exact, binned = (
        {(r["feature"], r["point"]): r["density"] for r in di.kernel_density(counts, ranges, ["feature"], ["series"], points=50, exact_values=limit, fine=10).collect()}
        for limit in (10**9, 0)
    )
    assert len(exact) == len(binned) == 100
    for feature in "ab":
        xs = np.array([x for f, x in rows if f == feature])
        h = xs.std(ddof=1) * len(xs) ** -0.2 * di.BANDWIDTH_SCALE
        gap = max(abs(exact[feature, p] - binned[feature, p]) for p in range(50))
        assert 0 < gap <= 0.05 / (h * 100)


def test_strange_levels_offend_in_every_form(spark):
    rows = [(i, ["M", "F", "x", None, "y"][i % 5], ["Normal", "z"][i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "ID bigint, gender string, bmi string")
    population = spark.createDataFrame([("M", "Normal"), ("F", "Normal")], "gender string, bmi string")
    want = {i: "; ".join(c for c, bad in (("gender", g in ("x", "y")), ("bmi", b == "z")) if bad) for i, g, b in rows}
    levels = feature_levels(population, ["gender", "bmi"])
    for limits in ((5000, 5000), (0, 5000), (0, 0)):
        out = rules.out_of_population(frame, {}, levels, ["ID"], ["gender", "bmi"], *limits)
        assert {r["ID"]: r["offenders"] for r in out.collect()} == want, limits


@pytest.mark.parametrize("name", ["out_of_population", "out_of_population_joined"])
def test_a_filter_on_offenders_copies_no_feature(spark, name):
    from tabaudit.plans import catalogue

    found = catalogue.QUERIES[name].run(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert any("offenders" in f for f in filters) and not any("round(" in f or "CASE" in f for f in filters)
    assert "lambdafunction" not in plan


def test_panels_are_resolved_by_name_and_prefix():
    there = ["detection_xgb", "alpha_b", "alpha_a", "detection_avg", "ks"]
    assert pooling.resolve_panel(there, [("prefix", "detection"), ("metric", "ks"), ("prefix", "alpha")], {"detection_avg"}) == (["detection_xgb", "ks", "alpha_a", "alpha_b"], [])
    assert pooling.resolve_panel(there, [("metric", "alpha"), ("metric", "ks"), ("metric", "ks")]) == (["ks"], ["alpha"])
    with pytest.raises(ValueError):
        pooling.resolve_panel(there, [("suffix", "a")])


def test_a_tree_query_writes_only_what_it_reads(spark, tmp_path):
    from tabaudit.plans import tree_queries as tree
    from tabaudit.sources.tree_index import listing

    key = (spark.sparkContext.applicationId, "/root/testdata/sf0.001")
    held = tree._TREES.pop(key, None)
    try:
        assert tree.tree_patches(spark, key[1]).count() > 0
        roles = {r["role"] for r in listing(spark, tree._TREES[key][0]).select("role").distinct().collect()}
        assert roles == {"quality", "utility", "other"}
    finally:
        tree._TREES.pop(key, None)
        if held:
            tree._TREES[key] = held


def _shuffle_bytes(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = [os.path.join(d, n) for top in blocks.localDirs() for d, _, names in os.walk(str(top)) for n in names if n.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in found if os.path.exists(f))


def _plans(spark, monkeypatch, write, folder="/root/testdata/sf0.001"):
    """The plans by which a part of the tree is written; nothing is written."""
    from tabaudit.plans import tree_queries as tree

    seen = []
    monkeypatch.setattr(tree, "_run", lambda *written: seen.extend(w._jdf.queryExecution().executedPlan().toString() for w in written))
    write(spark, folder, "/nowhere")
    return seen


def test_record_files_are_written_without_a_shuffle_of_records(spark, monkeypatch):
    from tabaudit.plans import tree_queries as tree

    records, notes = _plans(spark, monkeypatch, tree._write_records)
    assert "Exchange" not in records and "Window" in records and "Bucketed: true" in records
    # lines are dealt to their chain before features are worked out of them
    assert notes.count("Exchange ") == 1 and "% 92" in notes.split("Exchange ")[0] and "% 92" not in notes.split("Exchange ")[1]


def test_record_files_number_lines_that_have_an_order_and_leave_no_shuffle_files(spark, tmp_path):
    import time

    import compare
    import duckdb

    from tabaudit.plans import tree_queries as tree

    at, folder = "/root/testdata/sf0.001", str(tmp_path)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{at}/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM '{at}/orders.parquet' WHERE o_orderkey % 5 <> 2 UNION ALL SELECT * FROM '{at}/orders.parquet' WHERE o_orderkey % 7 = 3) TO '{folder}/orders.parquet'")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    before = _shuffle_bytes(spark)
    tree.tree(spark, folder, "records")
    until = time.time() + 10
    while _shuffle_bytes(spark) > before and time.time() < until:  # executors drop them in their own time
        time.sleep(0.2)
    assert _shuffle_bytes(spark) <= before
    query = tree.registry.entries["tree_records"]
    assert compare.compare(spark, con, query.name, query.run, query.sql, folder) is None


def test_other_files_of_a_tree_shuffle_lines_once_at_most(spark, monkeypatch):
    from tabaudit.plans import tree_queries as tree

    found = {write.__name__: _plans(spark, monkeypatch, write) for write in (tree._write_labels, tree._write_training, tree._write_raw)}
    exchanges = {name: [p.count("Exchange ") for p in plans] for name, plans in found.items()}
    assert exchanges == {"_write_labels": [0] * 4, "_write_training": [1], "_write_raw": [0, 0, 1]}
    # what no ID is written of is numbered too, else its files would be split
    assert all("Window" in p and "Bucketed: true" in p for p in found["_write_labels"])
    text = [p.split("Exchange ") for p in (found["_write_training"][0], found["_write_raw"][2])]
    assert all("% 92" in above and "% 92" not in below for above, below in text)


def test_label_files_are_whole_when_stored_lines_are_read_in_many_splits(spark, monkeypatch):
    from tabaudit.plans import tree_queries as tree

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(tree, "_TREES", {})
    monkeypatch.setattr(tree, "_SEEN", {})
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        root = tree.tree(spark, folder, "labels")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    n = tree.v.records(spark, folder, "synthetic").count()
    for below in ("metrics", "data/decoded"):
        assert spark.read.text(f"{root}/*/*/{below}/*.csv").filter("value NOT RLIKE '(?i)readm|target'").count() == n


def test_few_distinct_cells_are_broadcast_however_many_rows(spark, monkeypatch):
    from tabaudit.operators import novelty

    pop = novelty.Population.learn(spark.range(5000).selectExpr("CAST(id % 7 AS DOUBLE) AS n", "'a' AS c"), ["n"], ["c"])
    monkeypatch.setattr(novelty, "BROADCAST_BYTES", 10_000)
    assert pop.rows == 5000 and pop.cells_fit_broadcast([5, 10])
    wide = novelty.Population.learn(spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS n", "CAST(id AS STRING) AS c"), ["n"], ["c"])
    assert not wide.cells_fit_broadcast([5, 10])


def test_buckets_grow_with_the_lines_and_records_are_numbered_once(spark, monkeypatch):
    from tabaudit.plans import stage_queries as stages

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(stages, "_STORES", {})
    monkeypatch.setattr(stages, "_NUMBERED", {})
    monkeypatch.setattr(stages, "BUCKET_LINES", 300)
    assert stages._store(spark, folder).contract("flags").buckets == 20
    assert stages._numbered(spark, folder) is stages._numbered(spark, folder)
