"""Stage tables: contracts, commits, clustered and bucketed layouts."""

import os

import pytest
from pyspark.sql import functions as F

from tabaudit.sources import stage_tables
from tabaudit.sources.stage_tables import Contract, StageError, StageStore

FLAGS = {"folder": "string", "generation": "int", "ID": "bigint", "metric": "string"}
SORTED = Contract("flags", FLAGS, keys=("folder", "generation", "ID", "metric"), cluster_by=("generation", "folder", "metric", "ID"))


def flags(spark, n=4000):
    return spark.range(n).selectExpr("concat('chain_', (id * 7) % 5) AS folder", "CAST((id * 3) % 8 AS INT) AS generation", "id AS ID", "IF(id % 3 = 0, 'HR_b5', 'Expert_any') AS metric", "'more' AS extra")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_is_checked_before_anything_runs(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}").declare(SORTED)
    with pytest.raises(StageError, match="stage flags: column metric is missing"):
        store.write("flags", flags(spark).drop("metric"))
    with pytest.raises(StageError, match="stage flags: column ID is string, not bigint"):
        store.write("flags", flags(spark).withColumn("ID", F.col("ID").cast("string")))
    with pytest.raises(StageError, match="stage rules: no contract"):
        store.read("rules")
    with pytest.raises(StageError, match="stage flags: not finished"):
        store.read("flags")
    with pytest.raises(StageError, match=r"stage flags: 2 rows for key \['chain_0', 0, 0, 'HR_b5'\]"):
        store.write("flags", flags(spark, 8).union(flags(spark, 1)))
    with pytest.raises(StageError, match="not finished"):
        store.read("flags")


def test_name_clash_and_bad_layouts_are_errors(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}").declare(SORTED, SORTED)
    with pytest.raises(StageError, match="stage Flags: the name is taken"):
        store.declare(Contract("Flags", {"a": "int"}))
    with pytest.raises(StageError, match="layout column b isn't"):
        Contract("x", {"a": "int"}, partition_by=("b",))
    with pytest.raises(StageError, match="number"):
        Contract("x", {"a": "int"}, bucket_by=("a",))


def test_a_rerun_that_breaks_off_leaves_the_old_table(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}").declare(SORTED)
    store.write("flags", flags(spark, 10))
    broken = flags(spark, 10).withColumn("ID", F.when(F.col("ID") < 5, F.col("ID")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        store.write("flags", broken)
    assert store.read("flags").count() == 10 and store.read("flags").columns == list(FLAGS)
    other = StageStore(spark, f"file://{tmp_path}").declare(Contract("flags", FLAGS | {"ID": "string"}))
    with pytest.raises(StageError, match="another contract, differing in .*'ID', 'bigint'"):
        other.read("flags")


def test_clustered_table_is_sorted_and_read_in_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage_tables, "CLUSTER_ROWS", 250)
    store = StageStore(spark, f"file://{tmp_path}").declare(SORTED)
    store.write("flags", flags(spark))
    files = store.manifest("flags")["files"]
    assert len(files) == 16 and sum(f["rows"] for f in files) == 4000
    order = ["generation", "folder", "metric", "ID"]
    for f in files:
        rows = [tuple(r) for r in spark.read.parquet(f["path"]).select(*order).collect()]
        assert rows == sorted(rows)
    one = store.read_where("flags", generation=3, folder="chain_2")
    assert len(one.inputFiles()) <= 3
    want = flags(spark).filter("generation = 3 AND folder = 'chain_2'")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.select(*FLAGS).collect())) and one.count() == 100
    assert store.read_where("flags", generation=99).count() == 0
    assert store.read_where("flags", metric="HR_b5").count() == flags(spark).filter("metric = 'HR_b5'").count()


def test_family_opens_only_its_partitions(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}").declare(
        Contract("trajectories", FLAGS, partition_by=("metric",)), Contract("trajectories_detail", FLAGS, partition_by=("metric",))
    )
    store.write("trajectories", flags(spark))
    store.write("trajectories_detail", flags(spark, 30))
    one = store.family("trajectories", ["HR_b5"])
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(metric" in plan and "HR_b5" in plan
    assert one.count() == flags(spark).filter("metric = 'HR_b5'").count()
    assert sorted(os.listdir(f"{tmp_path}/trajectories/" + store.manifest("trajectories")["version"]))[-2:] == ["metric=Expert_any", "metric=HR_b5"]


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    keys = ("folder", "generation", "ID")
    declared = [Contract(n, FLAGS, partition_by=("metric",) if n == "flags" else (), bucket_by=keys, buckets=4) for n in ("flags", "rules")]
    store = StageStore(spark, f"file://{tmp_path}").declare(*declared)
    store.write("flags", flags(spark))
    store.write("rules", flags(spark, 2000))
    for s in (store, StageStore(spark.newSession(), f"file://{tmp_path}").declare(*declared)):
        if s is not store:
            for name in ("flags", "rules"):
                s.spark.sql(f"DROP TABLE IF EXISTS {s._table(name, s.manifest(name)['version'])}")
        joined = s.read("rules").join(s.family("flags", ["HR_b5"]).hint("merge"), list(keys))
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == flags(spark, 2000).filter("metric = 'HR_b5'").count()
