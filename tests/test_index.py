"""The file index, scans by header and the tree writer."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tabaudit.sources import files, scans
from tabaudit.sources.tree_index import TreeIndex

CHAIN = "Step7pfa_dseed1_synthcity_arf_mseed{}"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def tree(tmp_path):
    root = f"{tmp_path}/tree"
    for seed in (7, 8):
        chain = f"{root}/ARF/{CHAIN.format(seed)}"
        for g in (0, 1):
            _write(f"{chain}/SD/synthetic_gen_{g}_clin.csv", "ID,age\n1,30\n")
            _write(f"{chain}/data/decoded/synthetic_synthcity_arf_gen_{g}_decoded.csv", f"age,{'Readmitted' if g else 'readmission'},x\n30,{g},a\n31,readmission,b\n")
        _write(f"{chain}/RD/reference_gen_0_clin.csv", "ID,age\n1,30\n")
        _write(f"{chain}/{CHAIN.format(seed)}.csv", f"generation,ks,m{seed}\n0,0.5,{seed}\n1,,2\n")
        _write(f"{chain}/metrics/tstr_a_gen_0_b.json", "{}")
    _write(f"{root}/POP/population.csv", "ID,age\n1,30\n")
    return root


def test_index_knows_roles_keys_and_headers(spark, tree, tmp_path):
    index = TreeIndex(spark, f"{tmp_path}/index")
    added = index.refresh(tree)
    assert {(r["role"], r["count"]) for r in added.groupBy("role").count().collect()} == {("records", 4), ("labels", 4), ("training", 2), ("quality", 2), ("utility", 2), ("population", 1)}
    one = index.files("records").filter("generation = 1").orderBy("folder").first()
    assert (one["generator"], one["folder"], one["header"]) == ("ARF", CHAIN.format(7), ["ID", "age"])
    assert index.files("utility").first()["header"] is None
    assert index.files("labels").select("header_print").distinct().count() == 2


def test_refresh_describes_only_what_is_new(spark, tree, tmp_path):
    index = TreeIndex(spark, f"{tmp_path}/index")
    index.refresh(tree)
    assert index.refresh(tree).count() == 0
    new, changed, lost = (f"{tree}/ARF/{CHAIN.format(7)}/SD/synthetic_gen_{g}_clin.csv" for g in (2, 1, 0))
    _write(new, "ID,age,extra\n1,2,3\n")
    _write(changed, "ID,age,later\n1,2,3\n")
    os.utime(changed, (time.time() + 5, time.time() + 5))
    os.remove(lost)
    added = {(r["path"].rsplit("/", 1)[1], r["gone"]): r["header"] for r in index.refresh(tree).collect()}
    assert added == {("synthetic_gen_2_clin.csv", False): ["ID", "age", "extra"], ("synthetic_gen_1_clin.csv", False): ["ID", "age", "later"], ("synthetic_gen_0_clin.csv", True): ["ID", "age"]}
    held = [r["generation"] for r in index.files("records").filter(F.col("folder") == CHAIN.format(7)).orderBy("generation").collect()]
    assert held == [1, 2]
    _write(lost, "ID,age\n1,2\n")  # back again
    assert index.refresh(tree).count() == 1 and index.files("records").count() == 5


def test_two_files_for_one_key_are_named(spark, tree, tmp_path):
    index = TreeIndex(spark, f"{tmp_path}/index")
    index.refresh(tree)
    keys = ["generator", "folder", "generation"]
    assert index.only("records", keys).count() == 4
    _write(f"{tree}/ARF/{CHAIN.format(8)}/SD/other_gen_1_clin.csv", "ID,age\n1,30\n")
    index.refresh(tree)
    with pytest.raises(Exception, match="records: several candidate files for ARF .*mseed8 1 .*other_gen_1.*synthetic_gen_1"):
        index.only("records", keys).collect()


def test_scans_by_header_read_once_and_pruned(spark, tree, tmp_path):
    index = TreeIndex(spark, f"{tmp_path}/index")
    index.refresh(tree)
    labels = scans.scan_labels(spark, tree, files=index.files("labels"))
    # a cell that equals a label's name is data
    assert sorted((r["mseed"], r["generation"], r["readmission"]) for r in labels.collect()) == sorted((s, g, v) for s in (7, 8) for g in (0, 1) for v in (str(g), "readmission"))
    plan = labels._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan csv") == 2 and "ReadSchema: struct<c1:string>" in plan and "c0:string" not in plan
    quality = scans.scan_quality(spark, tree, files=index.files("quality"))
    assert sorted((r["mseed"], r["generation"], r["metric"], r["value"]) for r in quality.collect()) == [(7, 0, "ks", 0.5), (7, 0, "m7", 7.0), (7, 1, "m7", 2.0), (8, 0, "ks", 0.5), (8, 0, "m8", 8.0), (8, 1, "m8", 2.0)]
    only = scans.scan_quality(spark, tree, files=index.files("quality"), metrics=["m8"])
    assert sorted((r["mseed"], r["value"]) for r in only.collect()) == [(8, 2.0), (8, 8.0)]
    assert "c0:string,c2:string" in only._jdf.queryExecution().executedPlan().toString()


def test_written_files_hold_their_lines_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 7 AS k", "id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'a,\"b' ELSE 'x' END AS t")
    made = files.write_csv_files(rows, F.concat(F.lit(f"file://{tmp_path}/out/"), F.col("k"), F.lit("/rows.csv")), ["id", "t"], ["id"])
    assert sorted(r["lines"] for r in made.collect()) == [428] * 3 + [429] * 4
    assert sorted(os.listdir(f"{tmp_path}/out/3")) == ["rows.csv"]
    again = spark.read.option("header", True).csv(f"{tmp_path}/out/3").collect()
    assert [int(r["id"]) for r in again] == list(range(3, 3000, 7))
    assert {r["t"] for r in again} == {None, 'a,"b', "x"} or {r["t"] for r in again} == {None, 'a,\\"b', "x"}
    assert files.first_line(f"file://{tmp_path}/out/3/rows.csv") == "id,t"


def test_dealt_rows_are_written_as_they_lie_and_their_order_keeps_the_dealing(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 7 AS k", "id").repartition(3, "k").sortWithinPartitions("k", "id")
    made = files.write_csv_files(rows, F.concat(F.lit(f"file://{tmp_path}/out/"), F.col("k"), F.lit("/rows.csv")), ["id"], ["id"], dealt=True)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(r["lines"] for r in made.collect()) == [428] * 3 + [429] * 4
    assert [int(r["id"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/out/3").collect()] == list(range(3, 3000, 7))
