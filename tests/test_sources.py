"""Scans of run folders, sinks, the stage flow and the incremental run, on a small file tree."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.keys import generation_number, variant_of
from tabaudit.functions.normalise import normalise_records
from tabaudit.operators import utility
from tabaudit.plans import audit, tables
from tabaudit.sources import scans, sinks
from tabaudit.streaming import incremental

HEAD = "ID,readmission,age,gender,icd9,nt-probnp,heartrate,systolic_bp,diastolic_bp,hemoglobin"
CHAINS = ["Step7pfa_dseed1_synthcity_arf_mseed7", "Step7pfa_dseed1_synthcity_arf_mseed8"]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _rows(shift, n=12, bad=()):
    lines = [HEAD]
    for i in range(1, n + 1):
        heart = "" if i == 5 else str(60 + (i * 3 + shift) % 30)
        high = 60 if i in bad else 120
        lines.append(f"{i},{i % 4 == 0},{30 + i},F,Respiratory,Normal,{heart},{high},70,{12 + i / 10}")
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ready"))
    for k, chain in enumerate(CHAINS):
        for g in (0, 1):
            _write(f"{root}/ARF/{chain}/SD/synthetic_gen_{g}_clin.csv", _rows(g + k, bad=(3,) if g else ()))
        _write(f"{root}/ARF/{chain}/SD/notes.csv", "a\n1\n")
        _write(f"{root}/ARF/{chain}/RD/reference_gen_3_clin.csv", _rows(50))
        _write(f"{root}/ARF/{chain}/RD/reference_gen_0_clin.csv", _rows(k))
    _write(f"{root}/POP/population.csv", _rows(0, n=40))
    columns = {"ID": "id", "age": "numerical", "heartrate": "numerical", "hemoglobin": "numerical", "gender": "categorical", "nt-probnp": "categorical", "readmission": "boolean"}
    _write(f"{root}/POP/metadata.json", json.dumps({"columns": {k: {"sdtype": s} for k, s in columns.items()}}, indent=1))
    return root


SCHEMA_COLUMNS = ["ID", "readmission", "age", "gender", "icd9", "bnp", "heartrate", "systolic_bp", "diastolic_bp", "hemoglobin"]


@pytest.fixture(scope="module")
def schema():
    return scans.record_schema(SCHEMA_COLUMNS)


def test_scan_records_takes_keys_from_the_path(spark, tree, schema):
    df = scans.scan_records(spark, tree)
    assert "bnp" in df.columns and df.count() == 48
    keys = {tuple(r) for r in df.select("generator", "variant", "dseed", "mseed", "generation", "chain").distinct().collect()}
    assert keys == {("ARF", "full", 1, s, g, f"d1 / m{s}") for s in (7, 8) for g in (0, 1)}
    assert df.filter("heartrate IS NULL").count() == 4


def test_training_prefers_generation_zero(spark, tree, schema):
    df = scans.scan_training(spark, tree)
    assert {r[0] for r in df.select("file").distinct().collect()} == {"reference_gen_0_clin.csv"} and df.count() == 24


def test_metadata_splits_columns(spark, tree):
    numeric, categorical = scans.read_metadata(spark, f"{tree}/POP/metadata.json")
    assert numeric == ["age", "heartrate", "hemoglobin"] and set(categorical) == {"gender", "bnp", "readmission"}


def test_stage_flow_is_rerunnable(spark, tree, schema, tmp_path):
    records = scans.scan_records(spark, tree)
    training = scans.scan_training(spark, tree)
    population = scans.scan_population(spark, f"{tree}/POP/population.csv")
    numeric, categorical = scans.read_metadata(spark, f"{tree}/POP/metadata.json")
    stages = audit.Stages(spark, str(tmp_path / "stages"), buckets=4)

    def run():
        audit.novelty_stage(stages, records, training, population, numeric, categorical, [5])
        audit.rule_stage(stages, records)
        audit.trajectory_stage(stages, records, records.filter("ID = 7 AND generation = 1"))
        auroc = records.groupBy("generator", "dseed", "mseed", "generation").agg((F.lit(0.7) - F.col("generation") * 0.5).alias("value"))
        audit.event_stage(stages, auroc)
        names = ["flags", "rule_detail", "summary", "trajectories", "onsets", "failure_events", "dissociation"]
        return {n: stages.read(n).count() for n in names}

    first = run()
    assert run() == first and first["failure_events"] == 2
    copies = {(r["generation"], r["mseed"]): r["copy_rate"] for r in stages.read("copy_rates").collect()}
    assert copies[(0, 7)] == 1.0 and copies[(0, 8)] == 1.0
    steps = {r[0] for r in stages.read("summary").select("step").distinct().collect()}
    assert steps == {"novelty", "rules"}
    rates = {(r["generation"], r["mseed"]): r["value"] for r in stages.read("trajectories").filter("metric = 'expert_any'").collect()}
    assert rates[(0, 7)] == 0.0 and rates[(1, 7)] == pytest.approx(1 / 12)
    both = {(r["generation"], r["mseed"]): r["n_flagged"] for r in stages.read("trajectories").filter("metric = 'expert_llm'").collect()}
    assert both == {(1, 7): 2, (1, 8): 2}
    crossed = {(r["metric"], r["crossed"]) for r in stages.read("onsets").filter("metric = 'expert_any'").collect()}
    assert crossed == {("expert_any", True)}


def test_incremental_run_reads_each_file_once(spark, tree, schema, tmp_path):
    target, checkpoint = str(tmp_path / "detail"), str(tmp_path / "state")
    late = str(tmp_path / "late")
    _write(f"{late}/ARF/{CHAINS[0]}/SD/synthetic_gen_0_clin.csv", _rows(0, bad=(2,)))
    incremental.flag_new_files(incremental.record_stream(spark, late, schema), target, checkpoint)
    assert spark.read.parquet(target).count() == 1
    incremental.flag_new_files(incremental.record_stream(spark, late, schema), target, checkpoint)
    assert spark.read.parquet(target).count() == 1
    _write(f"{late}/ARF/{CHAINS[0]}/SD/synthetic_gen_1_clin.csv", _rows(0, bad=(4, 6)))
    incremental.flag_new_files(incremental.record_stream(spark, late, schema), target, checkpoint)
    got = {(r["generation"], r["ID"], r["rule"]) for r in spark.read.parquet(target).collect()}
    assert got == {(0, 2, "dbp_ge_sbp"), (1, 4, "dbp_ge_sbp"), (1, 6, "dbp_ge_sbp")}


def test_incremental_run_reads_both_variants(spark, tmp_path):
    full = "ID,readmission,age,gender,heartrate,systolic_bp,diastolic_bp\n1,True,30,F,70,60,70\n"
    core = "ID,age,gender,systolic_bp,diastolic_bp\n1,30,F,120,70\n2,31,M,60,70\n"
    _write(f"{tmp_path}/late/ARF/{CHAINS[0]}/SD/synthetic_gen_0_clin.csv", full)
    _write(f"{tmp_path}/late/ARF_CORE/{CHAINS[0].replace('pfa', 'pfp')}/SD/synthetic_gen_0_clin.csv", core)
    with pytest.raises(Exception):  # one schema for files of two headers
        incremental.flag_new_files(incremental.record_stream(spark, f"{tmp_path}/late"), f"{tmp_path}/a", f"{tmp_path}/b")
    parts = [
        incremental.record_stream(spark, f"{tmp_path}/late", scans.record_schema(head.split("\n")[0].split(",")), [generator])
        for head, generator in ((full, "ARF"), (core, "ARF_CORE"))
    ]
    incremental.flag_new_files(parts[0].unionByName(parts[1], allowMissingColumns=True), f"{tmp_path}/c", f"{tmp_path}/d")
    got = {(r["generator"], r["ID"], r["rule"]) for r in spark.read.parquet(f"{tmp_path}/c").collect()}
    assert got == {("ARF", 1, "dbp_ge_sbp"), ("ARF_CORE", 2, "dbp_ge_sbp")}


# ------------------------------------------------------------- raw exports
def test_raw_exports_are_checked_and_normalised(spark, tmp_path):
    base = f"{tmp_path}/Step7pfp_ddpm_export/Step7pfp_dseed2_synthcity_ddpm_mseed3/data/decoded"
    raw = "gender,bmi,age,glucose,creatinine,religion\n1,4,70.5,99.5,1.25,x\nM,9,n/a,100.4,0.35,y\n"
    _write(f"{base}/reference_gen_0_x.csv", raw)
    _write(f"{base}/synthetic_gen_2_x.csv", raw)
    got = normalise_records(scans.scan_raw_exports(spark, str(tmp_path)).withColumn("ID", F.lit(1)))
    rows = {(r["role"], r["gender"]): r for r in got.collect()}
    assert len(rows) == 4 and "religion" not in got.columns
    r = rows[("synthetic", "F")]
    assert (r["generator"], r["generation"], r["bmi"], r["age"], r["glucose"], r["creatinine"]) == ("DDPM_CORE", 2, "Morbidly obese", 70, 100, 1.2)
    assert rows[("training", "M")]["bmi"] is None and rows[("training", "M")]["age"] is None
    # another export with other columns in another order, and a chain without its reference file
    other = f"{tmp_path}/Step7pfa_arf_export/{CHAINS[0]}/data/decoded"
    _write(f"{other}/synthetic_gen_1_x.csv", "age,glucose\n33,88\n")
    _write(f"{base}/reference_gen_0_y.csv", raw)
    both = scans.scan_raw_exports(spark, str(tmp_path))
    assert sorted((r["generator"], r["role"], r["gender"], r["age"], r["glucose"]) for r in both.collect()) == [
        ("ARF", "synthetic", None, "33", "88"), ("DDPM_CORE", "synthetic", "1", "70.5", "99.5"), ("DDPM_CORE", "synthetic", "M", "n/a", "100.4"),
    ]
    assert {r["n_training_files"] for r in scans.raw_training_counts(spark, str(tmp_path)).collect()} == {0, 2}


# ------------------------------------------------------------------ labels
def test_label_scan(spark, tmp_path):
    chain = f"{tmp_path}/x/Step7pfa_dseed1_synthcity_ctgan_mseed5"
    name = "synthetic_synthcity_ctgan_gen_{}_decoded.csv"
    _write(f"{chain}/data/{name.format(0)}", "a,Readmitted\n1,1\n2,0\n")
    _write(f"{chain}/data/{name.format(1)}", "readmission\n1\n")
    _write(f"{chain}/metrics/{name.format(2)}", "readmission\n1\n")
    _write(f"{chain}/data/{name.format(25)}", "readmission\n1\n")
    _write(f"{chain}/data/reference_gen_0_decoded.csv", "readmission\n1\n")
    listing = {r["file"] + str(r["generation"]): r["keep"] for r in scans.label_files(spark, str(tmp_path)).collect()}
    assert sum(listing.values()) == 2
    got = sorted((r["generation"], r["readmission"], r["mseed"]) for r in scans.scan_labels(spark, str(tmp_path)).collect())
    assert got == [(0, "0", 5), (0, "1", 5), (1, "1", 5)]
    _write(f"{chain}/other/{name.format(1)}", "readmission\n0\n")
    with pytest.raises(Exception, match="several candidate files"):
        scans.scan_labels(spark, str(tmp_path)).collect()


# ------------------------------------------------------- utility and quality
def test_utility_documents(spark, tmp_path):
    folder = f"{tmp_path}/Step7pfa_arf_export/{CHAINS[0]}/metrics"
    doc = {"tstr_metrics": {"auroc": 0.6, "f1_score": 0.5, "confusion_matrix": {"tn": 8, "fp": 2, "fn": 0, "tp": 0}}, "trtr_metrics": {"auroc": 0.75}, "more": [1]}
    _write(f"{folder}/tstr_arf_gen_4_a.json", json.dumps(doc, indent=1))
    r = scans.scan_utility(spark, str(tmp_path)).first()
    assert (r["generator"], r["generation"], r["tstr_f1"]) == ("ARF", 4, 0.5)
    assert r["tstr_fpr"] == 0.2 and r["tstr_tnr"] == 0.8 and r["tstr_fnr"] is None and abs(r["utility_gap"] - 0.15) < 1e-12
    _write(f"{folder}/tstr_arf_gen_4_b.json", json.dumps(doc))
    with pytest.raises(Exception, match="utility documents"):
        scans.scan_utility(spark, str(tmp_path)).collect()


def test_quality_tables_keep_their_own_columns(spark, tmp_path):
    _write(f"{tmp_path}/e/{CHAINS[0]}/{CHAINS[0]}.csv", "generation,mmd,ks\n0,0.5,0.9\n1,,0.8\n")
    _write(f"{tmp_path}/e/{CHAINS[0]}/other.csv", "generation,mmd\n0,9\n")
    _write(f"{tmp_path}/e/{CHAINS[1]}/only.csv", "ks,generation\n0.7,0\n")
    got = sorted((r["mseed"], r["generation"], r["metric"], r["value"]) for r in scans.scan_quality(spark, str(tmp_path)).collect())
    assert got == [(7, 0, "ks", 0.9), (7, 0, "mmd", 0.5), (7, 1, "ks", 0.8), (8, 0, "ks", 0.7)]


def test_wide_quality_tables_with_digits_in_names(spark, tmp_path):
    names = ["hr_b1", "top3", "x3", " blank "] + [f"m{i}" for i in range(300)]
    _write(f"{tmp_path}/e/{CHAINS[0]}/{CHAINS[0]}.csv", ",".join(["generation", *names]) + "\n4," + ",".join(str(i) for i in range(len(names))) + "\n")
    got = {r["metric"]: r["value"] for r in scans.scan_quality(spark, str(tmp_path)).collect()}
    assert got == {n.strip(): float(i) for i, n in enumerate(names)}


def test_numbers_at_any_depth(spark):
    doc = json.dumps({"a": {"b": {"c": {"d": {"e": {"f": 1.5}}}}}, "g": [[[2, {"h": 3}]]], "t": "text", "n": None, "z": {}})
    frame = spark.createDataFrame([(1, doc), (2, None), (3, "{broken"), (4, "7")], "k int, j string")
    got = {(r["k"], r["path"]): r["value"] for r in utility.flat_numbers(frame, "j", ["k"]).collect()}
    assert got == {(1, "a.b.c.d.e.f"): 1.5, (1, "g[0][0][0]"): 2.0, (1, "g[0][0][1].h"): 3.0, (4, ""): 7.0}
    with pytest.raises(Exception, match="nested deeper than 3"):
        utility.flat_numbers(frame, "j", ["k"], depth=3).collect()


def test_patch_scan_and_overlay(spark, tmp_path):
    head = "variant,dseed,mseed,model,generation,metric_name,metric_value\n"
    _write(f"{tmp_path}/p.csv", head + "pfa,1,1,arf,1,mmd,2\npfa,1,1,arf,2,mmd,9\n")
    long = utility.patch_keys(scans.scan_patches(spark, [f"{tmp_path}/p.csv", f"{tmp_path}/absent.csv"]))
    base = spark.createDataFrame([("ARF", 1, 1, g, x) for g, x in ((0, 1.0), (1, None), (2, 3.0))], "generator string, dseed long, mseed long, generation int, mmd double")
    keys = ["generator", "dseed", "mseed", "generation"]
    once = utility.patch_overlay(base, long, keys, ["mmd"])
    assert [r["mmd"] for r in once.orderBy("generation").collect()] == [1.0, 2.0, 9.0]
    twice = utility.patch_overlay(once, long, keys, ["mmd"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert utility.patch_matches(base, long, keys, ["mmd"]).first()["n_matched"] == 2
    _write(f"{tmp_path}/bad.csv", "variant,dseed\npfa,1\n")
    with pytest.raises(ValueError, match="lacks columns"):
        scans.scan_patches(spark, [f"{tmp_path}/bad.csv"])


# ------------------------------------------------------------------- sinks
def test_stage_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_stage(spark.createDataFrame([(1, "a"), (2, "b")], "v int, step string"), path, ["step"])
    sinks.write_stage(spark.createDataFrame([(9, "b")], "v int, step string"), path, ["step"])
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "step").collect())) == [(1, "a"), (9, "b")]


def test_write_upsert_merges_with_the_table(spark, tmp_path):
    path = str(tmp_path / "u")
    for run, value in ((1, "x"), (2, "y"), (2, "y")):
        sinks.write_upsert(spark.createDataFrame([(1, value, run), (run, "z", 0)], "k int, v string, run int").filter("run > 0"), path, ["k"], "run")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "y", 2)]


def test_export_and_names(spark, tmp_path):
    table = tables.calibration_table(spark)
    paths = sinks.export_tables({"calibration": table}, str(tmp_path))
    back = spark.read.option("header", True).csv(paths[0])
    assert back.count() == len(m.ONSET_METRICS) and back.columns == ["metric", "threshold", "direction"]
    assert sinks.printed_names(spark.createDataFrame([("x",)], "bnp string")).columns == ["nt-probnp"]


# ------------------------------------------------------------------- naming
def test_generator_dimension(spark):
    assert len(m.GENERATOR_VARIANTS) == 8 and m.GENERATOR_VARIANTS["RTVAE_CORE"].raw_prefix == "Step7pfp"
    assert m.variant_from_token(" PF_all ") == "full" and m.generator_value("arf", "core") == "ARF_CORE"
    with pytest.raises(KeyError):
        m.variant_from_token("zzz")
    assert m.feature_columns("core") == [c for c in m.FEATURES if c in m.CORE_FEATURES] and len(m.feature_columns("full")) == 23
    with pytest.raises(Exception, match="unknown variant token"):
        spark.createDataFrame([("zzz",)], "t string").select(variant_of(F.col("t"))).collect()
    df = spark.createDataFrame([("10",), ("gen_10",), ("x",)], "g string")
    assert [r[0] for r in df.select(generation_number(F.col("g"))).collect()] == [10, 10, None]


def test_print_cells(spark):
    df = spark.createDataFrame([([0.1],), ([0.1, 0.2, 0.4],), ([0.1, 0.3],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(tables.median_range_percent(F.col("v"))).collect()] == ["10.0%", "20.0% (10.0%–40.0%)", "20.0% (10.0%–30.0%)", ""]
