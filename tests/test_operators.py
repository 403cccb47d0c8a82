"""Hand-computed fixtures, boundary rows and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions import tails
from tabaudit.functions.normalise import binary_label, membership_value, bin_text
from tabaudit.operators import distributions as di
from tabaudit.operators import events, ids, labels, novelty, onset, paired, pooling, ranking, review, rules, subsets, survival, trajectories


def near(a, b, tol=1e-5):
    return (a is None and b is None) or abs(a - b) < tol


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------- scalars
def test_bins(spark):
    df = spark.sql("SELECT * FROM VALUES (0D), (1.999D), (2D), (10D), (-3D), (12D), (CAST(NULL AS DOUBLE)) AS t(x)")
    assert [r[0] for r in df.selectExpr(bin_text("x", 0.0, 10.0, 5)).collect()] == [1, 1, 2, 5, 1, 5, 0]
    assert {r[0] for r in df.filter("x is not null").selectExpr(bin_text("x", 4.0, 4.0, 5)).collect()} == {1}


def test_membership_values(spark):
    df = spark.createDataFrame([(" TRUE",), ("1",), ("0",), ("nan",), ("",), (" Foo",), (None,)], "v string")
    assert [r[0] for r in df.select(membership_value("v")).collect()] == ["1", "1", "0", "Missing", "Missing", " Foo", "Missing"]


def test_binary_label_rejects_unknown_text(spark):
    df = spark.createDataFrame([("maybe",)], "v string")
    with pytest.raises(Exception, match="unrecognised label"):
        df.select(binary_label(F.col("v"), "string")).collect()


def test_t_and_chi2_tails():
    for df, expected in ((1, 12.706204736), (2, 4.302652730), (14, 2.144786688), (119, 1.980099876)):
        assert abs(tails.t_quantile_975(df) - expected) < 1e-8
    assert abs(tails.chi2_tail(5.0, 2) - math.exp(-2.5)) < 1e-14
    assert abs(tails.chi2_tail(7.814727903251179, 3) - 0.05) < 1e-12
    assert abs(tails.chi2_tail(80.0, 4) - math.exp(-40) * 41) < 1e-28


def test_t_expression_joins_its_two_parts(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 150, 151, 5000)], "n long")
    got = [r[0] for r in df.select(tails.t_critical(F.col("n"))).collect()]
    assert got[0] == 0.0
    for n, value in zip((1, 150, 151, 5000), got[1:]):
        assert abs(value - tails.t_quantile_975(n)) < 1e-9


# ------------------------------------------------------------------- pooling
def test_pooled_statistics(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.1), ("b", 0.3), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in pooling.pooled(df, ["k"], "v").collect()}
    assert (got["a"]["mean"], got["a"]["var"], got["a"]["low"], got["a"]["high"]) == (0.2, 0.0, 0.2, 0.2)
    assert near(got["b"]["var"], 0.02) and near(got["b"]["high"], 0.2 + 12.7062047 * 0.1)
    assert got["c"]["n"] == 0 and got["c"]["mean"] is None and got["c"]["low"] is None


def test_zero_filled_counts_equal_materialised_zeros(spark):
    counts = spark.createDataFrame([(0, 1, "r", 4), (0, 2, "r", 1)], "g int, c int, rule string, n int")
    files = spark.createDataFrame([(0, c) for c in range(1, 6)] + [(1, 1)], "g int, c int")
    got = pooling.zero_filled_counts(counts, files, ["g"], ["c"], "rule", "n").collect()
    assert len(got) == 1
    values = [4, 1, 0, 0, 0]
    mean = sum(values) / 5
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 4)
    assert near(got[0]["mean"], mean) and near(got[0]["sd"], sd) and got[0]["n"] == 5


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, run int")
    new = spark.createDataFrame([(2, "z", 2), (3, "w", 2)], "k int, v string, run int")
    once = pooling.upsert(old, new, ["k"], "run")
    assert sorted(rows(once)) == [(1, "x", 1), (2, "z", 2), (3, "w", 2)]
    assert sorted(rows(pooling.upsert(once, new, ["k"], "run"))) == sorted(rows(once))


def test_number_within_spans_slices(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "999 - id AS o")
    got = ids.number_within(df, ["g"], ["o"], "floor(o / 100)")
    expected = df.selectExpr("g", "o", "row_number() OVER (PARTITION BY g ORDER BY o) AS ID")
    assert sorted(rows(got)) == sorted(rows(expected))


def test_assert_unique_names_the_key(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="more than one row for 1"):
        ids.assert_unique(df, ["k"], "test").collect()


# --------------------------------------------------------------------- rules
CALM = dict(
    age=40, gender="F", icd9="Respiratory", ethnicity="WHITE", admission_type="URGENT", first_careunit="MICU", bmi="Normal",
    bnp="Acute", cholesterol="Intermediate", albumin="Normal", blood_urea_nitro=15, glucose=100, sodium=140, respiratory_rate=16,
    heartrate=80, systolic_bp=120, diastolic_bp=70, spo2=98, creatinine=1.0, potassium=4.0, hemoglobin=13.0, readmission=False, prior_icu=True,
)
# Per rule: values that fire it, and the same with one value just short of it.
CASES = {
    "reality_limit": (dict(glucose=2601), dict(glucose=2600)),
    "bad_category": (dict(admission_type="WALKIN"), dict(admission_type="ELECTIVE")),
    "dbp_ge_sbp": (dict(diastolic_bp=120), dict(diastolic_bp=119)),
    "pp_zero": (dict(diastolic_bp=118), dict(diastolic_bp=117)),
    "pp_low": (dict(diastolic_bp=116), dict(diastolic_bp=115)),
    "pp_wide": (dict(systolic_bp=199, diastolic_bp=48), dict(systolic_bp=199, diastolic_bp=49)),
    "pp_htn_narrow": (dict(systolic_bp=200, diastolic_bp=191), dict(systolic_bp=200, diastolic_bp=190)),
    "buncr_ratio_impossible": (dict(blood_urea_nitro=3, creatinine=3.1), dict(blood_urea_nitro=3, creatinine=3.0)),
    "buncr_ratio_high": (dict(blood_urea_nitro=81, creatinine=0.8, hemoglobin=11.0), dict(blood_urea_nitro=80, creatinine=0.7)),
    "low_cr": (dict(creatinine=0.1, age=18), dict(creatinine=0.1, age=17)),
    "rr_spo2_impossible": (dict(respiratory_rate=3, spo2=98), dict(respiratory_rate=3, spo2=97)),
    "comp_anemia": (dict(hemoglobin=5.0, systolic_bp=89), dict(hemoglobin=5.0, systolic_bp=90)),
    "comp_shock": (dict(systolic_bp=49, diastolic_bp=20), dict(systolic_bp=50, diastolic_bp=20)),
    "comp_hyperk": (dict(potassium=7.5, creatinine=0.9), dict(potassium=7.5, creatinine=1.0)),
    "comp_hypona": (dict(sodium=109, systolic_bp=89, heartrate=121), dict(sodium=109, systolic_bp=89, heartrate=120)),
    "pair_cardiogenic": (dict(heartrate=40, systolic_bp=60, diastolic_bp=20), dict(heartrate=41, systolic_bp=60, diastolic_bp=20)),
    "pair_htn_brady": (dict(systolic_bp=200, heartrate=40), dict(systolic_bp=200, heartrate=41)),
    "pair_tachy_htn": (dict(systolic_bp=200, heartrate=150), dict(systolic_bp=200, heartrate=149)),
    "fatal_constellation_suspicious": (dict(heartrate=200, sodium=180, potassium=10.0), dict(heartrate=200, sodium=180, potassium=9.9)),
    "extreme_count": (dict(heartrate=150, respiratory_rate=35, spo2=80, glucose=400, potassium=7.5),
                      dict(heartrate=150, respiratory_rate=35, spo2=80, glucose=400, potassium=7.4)),
    "elderly_f_highhb": (dict(age=61, hemoglobin=18.0), dict(age=60, hemoglobin=18.0)),
    "preg_male": (dict(icd9="Pregnancy", gender="M"), dict(icd9="Pregnancy")),
    "preg_age": (dict(icd9="Pregnancy", age=61), dict(icd9="Pregnancy", age=60)),
    "preg_hb": (dict(icd9="Pregnancy", hemoglobin=15.1), dict(icd9="Pregnancy", hemoglobin=15.0)),
    "pregnancy_elective": (dict(icd9="Pregnancy", admission_type="ELECTIVE"), dict(icd9="Pregnancy")),
    "unknown_extremelabs": (dict(icd9="UNKNOWN", bnp="Critical"), dict(icd9="UNKNOWN")),
    "circ_nomarkers": (dict(icd9="Circulatory system", cholesterol="Lowrisk", bnp="Normal"), dict(icd9="Circulatory system", cholesterol="Lowrisk")),
    "nut_chol_maln": (dict(cholesterol="Highrisk", bmi="Underweight", albumin="Low", hemoglobin=7.0),
                      dict(cholesterol="Highrisk", bmi="Underweight", albumin="Low", hemoglobin=7.1)),
    "nut_obese_hypo": (dict(bmi="Obese", systolic_bp=90, albumin="Low", bnp="Normal"), dict(bmi="Obese", systolic_bp=91, albumin="Low", bnp="Normal")),
    "alb_obese_anemia": (dict(albumin="Low", bmi="High", hemoglobin=5.0, icd9=None), dict(albumin="Low", bmi="High", hemoglobin=5.0, icd9="Neoplasms")),
    "alb_high_underwt": (dict(albumin="High", bmi="Underweight"), dict(albumin="High")),
    "alb_high_wasting": (dict(albumin="High", icd9="Digestive"), dict(albumin="High", icd9=None)),
    "severe_hypok": (dict(potassium=2.0), dict(potassium=2.1)),
}
_TYPES = {**{c: "long" for c in m.WHOLE_NUMBER_FEATURES}, **{c: "double" for c in m.ONE_DECIMAL_FEATURES}, **{c: "boolean" for c in m.BOOLEAN_FEATURES}}
_SCHEMA = "ID string, " + ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in CALM)


def _fired(spark, named):
    df = spark.createDataFrame([(k, *{**CALM, **v}.values()) for k, v in named.items()], _SCHEMA)
    out = {k: set() for k in named}
    for r in rules.rule_rows(rules.apply_rules(df), ["ID"]).collect():
        out[r["ID"]].add(r["rule"])
    return out


def test_every_rule_at_its_boundary(spark):
    named = {"calm": {}}
    for rule, (fires, not_quite) in CASES.items():
        named[f"{rule}+"], named[f"{rule}-"] = fires, not_quite
    got = _fired(spark, named)
    assert got["calm"] == set()
    for rule in CASES:
        assert rule in got[f"{rule}+"], rule
        assert rule not in got[f"{rule}-"], rule
    assert {r.name for r in rules.RULES} == set(CASES) | {"fatal_constellation_impossible"}


def test_missing_values_fire_nothing(spark):
    named = {c: {c: None} for c in CALM} | {"all": {c: None for c in CALM}}
    assert all(not fired for fired in _fired(spark, named).values())


def test_rules_read_text_and_nan(spark):
    df = spark.createDataFrame([("a", "30", float("nan")), ("b", "x", 20.0), ("c", None, 17.9)], "ID string, heartrate string, hemoglobin double")
    masked = rules.apply_rules(df.withColumn("systolic_bp", F.lit(200)))
    got = {(r["ID"], r["rule"]) for r in rules.rule_rows(masked, ["ID"]).collect()}
    assert got == {("a", "pair_htn_brady")}


def test_silent_file_causes(spark):
    schema = "f string, heartrate string, hemoglobin double"
    data = [("text", "x", 12.0 + i) for i in range(3)] + [("dead", str(70 + i), None) for i in range(9)]
    data += [("same", "70", 13.0)] * 20 + [("varied", str(70 + i), 13.0) for i in range(20)]
    got = {r["f"]: r for r in rules.diagnose_silent(rules.apply_rules(spark.createDataFrame(data, schema)), ["f"], ["heartrate", "hemoglobin", "icd9"]).collect()}
    assert got["text"]["likely_cause"].startswith("numeric stored as text (1)")
    assert got["dead"]["likely_cause"].startswith("all-NaN columns (1)")
    assert got["same"]["likely_cause"].startswith("mode collapse") and got["same"]["unique_rows"] == 1
    assert got["varied"]["likely_cause"].endswith("(note: 1 input column(s) absent)")


# ------------------------------------------------------------------- novelty
def _pop(spark):
    data = [(float(i % 11), "ab"[i % 2]) for i in range(50)] + [(None, "a")]
    return novelty.Population.learn(spark.createDataFrame(data, "x double, c string"), ["x"], ["c"]).with_cardinality()


def test_population_is_not_novel_to_itself(spark):
    pop = _pop(spark)
    for broadcast in (True, False):
        got = novelty.novelty_by_file(pop.frame.withColumn("k", F.lit(1)), pop, ["k"], [5, 10], broadcast).collect()
        assert [r["n_novel"] for r in got] == [0, 0] and {r["n_rows"] for r in got} == {51}


def test_both_novelty_forms_agree_and_hot_rows_count(spark):
    pop = _pop(spark)
    data = [(i, 99.0, "b") for i in range(200)] + [(200 + i, float(i), "a") for i in range(11)] + [(300, 5.0, "new")]
    df = spark.createDataFrame(data, "ID long, x double, c string").withColumn("k", F.lit(1))
    for res in ([5], [5, 30]):
        a = sorted(rows(novelty.novelty_by_file(df, pop, ["k"], res, True).select("bin", "n_rows", "n_novel")))
        assert a == sorted(rows(novelty.novelty_by_file(df, pop, ["k"], res, False).select("bin", "n_rows", "n_novel")))
        assert sorted(rows(novelty.novel_rows(df, pop, ["ID"], res, True))) == sorted(rows(novelty.novel_rows(df, pop, ["ID"], res, False)))


def test_adjustment_factor():
    pop = novelty.Population(None, ["a", "b"], ["c", "d"], {}, {"c": 3, "d": 4}, 1000)
    assert novelty.adjustment_factor(pop, 5) == 1.0
    assert near(0.5 * novelty.adjustment_factor(pop, 30), 0.371892)


def test_training_is_a_copy_of_itself(spark):
    t = spark.createDataFrame([(1, 1.4, " A"), (1, None, "b"), (2, 9.0, None)], "chain int, x double, c string").withColumn("ID", F.monotonically_increasing_id())
    got = novelty.copy_counts(t, t, ["chain"], ["chain"], ["x"], ["c"]).collect()
    assert all(r["copy_rate"] == 1.0 for r in got)
    assert novelty.copied_rows(t, t, ["chain"], ["x"], ["c"]).count() == 3
    lone = t.withColumn("chain", F.lit(7))
    assert novelty.copy_counts(lone, t, ["chain"], ["chain"], ["x"], ["c"]).first()["copy_rate"] is None


def test_missing_declared_column_is_an_error(spark):
    with pytest.raises(ValueError, match="lack declared columns"):
        novelty.novelty_by_file(spark.range(3), _pop(spark), ["id"])


# -------------------------------------------------------------------- review
def test_named_ids(spark):
    df = spark.createDataFrame([("42, 187,3901, 007",), ("none of 42",), ("A42 x42_ 5é",), ("nonesuch 3",), (None,)], "r string")
    assert [sorted(r[0]) for r in df.select(review.named_ids(F.col("r"))).collect()] == [[7, 42, 187, 3901], [], [], [3], []]


def test_payload_quotes_and_rounds(spark):
    df = spark.createDataFrame([("f", 1, 1, 0, 1.25, 'a,"b"', True)], "f string, ID long, position int, batch long, creatinine double, icd9 string, readmission boolean")
    text = review.batch_payloads(df, ["f"], ["ID", "icd9", "creatinine", "readmission"]).first()["payload"]
    assert text.splitlines()[-2:] == ["ID,icd9,creatinine,readmission", '1,"a,""b""",1.2,True']


# ------------------------------------------------------- onsets and failures
TRAJ = [(0, 0.10), (1, 0.12), (2, None), (3, 0.16), (4, 0.30), (5, 0.28)]
CHAIN_SCHEMA = "generator string, dseed long, mseed long, generation int, metric string, value double"


def _traj(spark, values=TRAJ, metric="v"):
    return spark.createDataFrame([("G", 1, 1, g, metric, x) for g, x in values], CHAIN_SCHEMA)


def test_onset_forms(spark):
    t = _traj(spark)
    other = spark.createDataFrame([("G", 1, 1), ("H", 1, 1)], "generator string, dseed long, mseed long")
    got = {r["generator"]: r for r in onset.incline_onset(t, other, {"v": (0.05, "increase")}).collect()}
    assert (got["G"]["onset_generation"], got["G"]["n_observed_generations"]) == (4, 5) and near(got["G"]["step_size"], 0.14)
    assert (got["H"]["crossed"], got["H"]["n_observed_generations"], got["H"]["onset_generation"]) == (False, 0, None)
    base = {r["generator"]: r for r in onset.baseline_rise_onset(t, other, {"v": 0.05}).collect()}
    assert base["G"]["onset_generation"] == 3 and near(base["G"]["peak"], 0.30) and near(base["G"]["max_rise"], 0.20)
    assert base["H"]["baseline"] == 0.0 and not base["H"]["crossed"]
    step = {r["generator"]: r for r in onset.largest_step(t, other, ["v"]).collect()}
    assert step["G"]["spike_generation"] == 4 and step["H"]["spike_generation"] is None
    with pytest.raises(ValueError):
        onset.incline_onset(t, other, {"v": (0.05, "sideways")})


def test_first_value_missing_never_crosses(spark):
    t = _traj(spark, [(0, None), (1, 0.1), (2, 0.9)])
    assert onset.baseline_rise_onset(t, onset.chain_registry(t), {"v": 0.05}).first()["crossed"] is False


def test_failure_events(spark):
    u = _traj(spark, [(0, 0.60), (1, 0.50), (2, None), (3, 0.48), (4, 0.55)]).drop("metric")
    assert onset.run_below(u, 0.5, 2).first()["onset"] == 1
    late = _traj(spark, [(0, 0.9)]).drop("metric").withColumn("generator", F.lit("H"))
    share = spark.createDataFrame([("G", 1, 1, 1, 0.0), ("H", 1, 1, 7, 0.2)], "generator string, dseed long, mseed long, generation int, value double")
    got = {r["generator"]: r for r in events.failure_events(u.unionByName(late), share).collect()}
    assert (got["G"]["time"], got["G"]["event"], got["G"]["mechanism"]) == (1, 1, "signal_loss+class_collapse")
    assert (got["H"]["time"], got["H"]["event"], got["H"]["mechanism"], got["H"]["insufficient_tstr_data"]) == (19, 0, "", True)
    seen = {r["generator"]: r["time"] for r in events.failure_events(u.unionByName(late), share, censor_at="last_observed").collect()}
    assert seen["H"] == 7


def test_categories_and_intervals(spark):
    schema = "generator string, dseed long, mseed long, failure_time int, failure_event int, onset_generation int, onset_crossed boolean"
    data = [("a", 7, 1, 4, True), ("b", 7, 1, 7, True), ("c", 7, 1, 9, True), ("d", 7, 1, None, False), ("e", 19, 0, 4, True), ("f", 19, 0, None, None), ("g", 0, 1, None, False)]
    df = spark.createDataFrame([(k, 1, 1, *v) for k, *v in data], schema)
    got = {r["generator"]: r["dissociation_category"] for r in events.dissociation(df).collect()}
    assert [got[k] for k in "abcdefg"] == [events.CATEGORIES[i] for i in (0, 1, 2, 3, 4, 5, 3)]
    parts = sorted((r["generator"], r["start"], r["stop"], r["event"], r["active"]) for r in events.risk_intervals(df).collect())
    assert [p[1:] for p in parts if p[0] == "a"] == [(0.0, 4.0, 0, 0), (4.0, 7.0, 1, 1)]
    assert [p[1:] for p in parts if p[0] in "cd"] == [(0.0, 7.0, 1, 0)] * 2
    assert not [p for p in parts if p[0] == "g"]


def test_duplicate_chain_fails_the_join(spark):
    e = spark.createDataFrame([("a", 1, 1, 3, 1, "x")] * 2, "generator string, dseed long, mseed long, time int, event int, mechanism string")
    o = spark.createDataFrame([("a", 1, 1, 3, True, 4)], "generator string, dseed long, mseed long, onset_generation int, crossed boolean, n_observed_generations int")
    with pytest.raises(Exception, match="failure events"):
        events.join_onset(e, o).collect()


# ----------------------------------------------------------- rank statistics
def test_tau_and_wilcoxon(spark):
    cells = spark.createDataFrame([("k", 1, 3, 1), ("k", 2, 3, 1), ("k", 2, 5, 1), ("k", 4, 6, 1)], "k string, x int, y int, n long")
    assert near(paired.tau_b(cells, ["k"]).first()["tau"], 0.8)
    d = spark.createDataFrame([("k", 3, 1), ("k", -1, 1), ("k", 2, 2), ("k", 0, 1)], "k string, d int, n long")
    got = paired.signed_rank(d, ["k"]).first()
    assert (got["w_plus"], got["w_minus"], got["wilcoxon_stat"], got["n_nonzero"]) == (9.0, 1.0, 1.0, 4)


def test_exact_small_sample_tails():
    assert near(tails.kendall_tail(1.0, 4, 0, True), 2 / 24)
    assert near(tails.wilcoxon_tail(1.0, 5, 0, True), 2 / 32)
    assert near(tails.kendall_tail(1.959963984540054, 100, 0, False), 0.05)


def test_leave_one_out_equals_refiltering(spark):
    data = [("k", d, s, (d * 7 + s) % 5, 1) for d in range(3) for s in range(4)]
    df = spark.createDataFrame(data, "k string, dseed long, mseed long, cell int, n long")
    got = {(r["subset"], r["cell"]): r["n"] for r in subsets.cells_by_subset(df, df, ["k"], ["cell"], ["n"]).collect()}
    want = {}
    tests = [(subsets.FULL, lambda r: True)] + [(f"Excluding data seed {d}", lambda r, d=d: r[1] != d) for d in range(3)]
    tests += [(f"Excluding model seed {s}", lambda r, s=s: r[2] != s) for s in range(4)]
    for name, keep in tests:
        for r in filter(keep, data):
            want[(name, r[3])] = want.get((name, r[3]), 0) + 1
    assert got == want


def _events_df(spark, data):
    return spark.createDataFrame(data, "generator string, dseed long, mseed long, time int, event int")


def test_ranks_and_concordance(spark):
    groups = {"g": ["A", "B", "C"]}
    data = [("A", 1, 1, 2, 1), ("B", 1, 1, 5, 1), ("C", 1, 1, 9, 1), ("A", 1, 2, 4, 1), ("B", 1, 2, 19, 0), ("C", 1, 2, 19, 0),
            ("A", 1, 3, 2, 1), ("B", 1, 3, 2, 1), ("C", 1, 3, 9, 1), ("A", 2, 9, 1, 1)]
    ranks = ranking.rank_rows(_events_df(spark, data), groups)
    got = {(r["mseed"], r["generator"]): r["rank"] for r in ranks.collect()}
    assert [got[(s, g)] for s in (1, 2, 3) for g in "ABC"] == [1, 2, 3, 1, 2.5, 2.5, 1.5, 1.5, 3] and got[(9, "A")] is None
    assert ranking.incomplete_pairs(ranks, groups).first()["missing_generators"] == "B, C"
    w = ranking.kendalls_w(ranks).filter(F.col("subset") == subsets.FULL).first()
    assert near(w["w"], 0.833333) and near(w["chi2"], 5.0) and w["df"] == 2 and near(w["p"], 0.082085)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double").withColumn("f", F.lit(1))
    got = {r["t"]: r["p_holm"] for r in ranking.holm(df, ["f"]).collect()}
    assert near(got["a"], 0.03) and near(got["b"], 0.06) and near(got["c"], 0.06)


# ------------------------------------------------------------------ survival
def test_kaplan_meier(spark):
    data = [(2, 1), (2, 1), (3, 0), (5, 1), (5, 0), (19, 0)]
    df = spark.createDataFrame([("G", t, e) for t, e in data], "g string, time int, event int")
    table = survival.survival_table(df, ["g"])
    steps = [tuple(r)[2:] for r in survival.step_curve(table, ["g"]).orderBy("step").collect()]
    want = [(0, 1, 1, 1), (2, 0.66667, 0.28946, 1), (5, 0.44444, 0.00889, 0.88), (19, 0.44444, 0.00889, 0.88)]
    assert all(near(a, b, 1e-4) for x, y in zip(steps, want) for a, b in zip(x, y)) and len(steps) == 4
    censored = sorted((r["time"], round(r["survival"], 5)) for r in survival.censor_points(table, ["g"]).collect())
    assert censored == [(3, 0.66667), (5, 0.44444), (19, 0.44444)]


def _brute_efron(intervals, strata, beta):
    total = 0.0
    for s in {strata(i) for i in intervals}:
        mine = [i for i in intervals if strata(i) == s]
        for t in {i["stop"] for i in mine if i["event"]}:
            risk = [i for i in mine if i["start"] < t <= i["stop"]]
            dead = [i for i in risk if i["stop"] == t and i["event"]]
            for k in range(len(dead)):
                total -= math.log(sum(math.exp(beta * i["active"]) for i in risk) - k / len(dead) * sum(math.exp(beta * i["active"]) for i in dead))
            total += beta * sum(i["active"] for i in dead)
    return total


def test_cox_maximises_the_brute_force_likelihood(spark):
    data = [("A", d, s, (3 * d + 2 * s) % 9 + 1, int((d + s) % 4 != 0), (d * s) % 7 if s % 3 else None, bool(s % 3)) for d in range(2) for s in range(12)]
    schema = "generator string, dseed long, mseed long, failure_time int, failure_event int, onset_generation int, onset_crossed boolean"
    joined = spark.createDataFrame(data, schema)
    intervals = events.risk_intervals(joined)
    fit = survival.cox_time_varying(joined, intervals).first()
    listed = [r.asDict() for r in intervals.collect()]
    ll = lambda b: _brute_efron(listed, lambda i: (i["dseed"], i["generator"]), b)
    assert fit["converged"] and near(ll(fit["coef"]), fit["log_likelihood"], 1e-8)
    assert ll(fit["coef"]) >= max(ll(fit["coef"] + 0.01), ll(fit["coef"] - 0.01))


def test_cox_of_one_state_only_has_a_flat_likelihood(spark):
    schema = "generator string, dseed long, mseed long, failure_time int, failure_event int, onset_generation int, onset_crossed boolean"
    joined = spark.createDataFrame([("A", 0, s, 3 + s, 1, 0, True) for s in range(4)], schema)
    fit = survival.cox_time_varying(joined, events.risk_intervals(joined)).first()
    assert fit["coef"] is None and not fit["converged"]
    assert near(fit["log_likelihood"], -math.log(24), 1e-12) and fit["log_likelihood_null"] == fit["log_likelihood"]


def test_logrank_with_absent_generators(spark):
    groups = {"g": ["A", "B", "C"]}
    data = [(g, d, s, (d + 2 * s + (3 if g == "B" else 0)) % 7, int(s != 2)) for g in "AB" for d in range(2) for s in range(5)]
    df = _events_df(spark, data)
    full = survival.logrank(df, groups).filter(F.col("subset") == subsets.FULL).first()
    pair = survival.logrank_pairwise(df, groups).filter(F.col("subset") == subsets.FULL).first()
    assert full["df"] == 1 and near(full["statistic"], pair["statistic"], 1e-9) and near(full["p"], pair["p"], 1e-12)


def test_stratified_cox_excludes_generators_that_always_fail(spark):
    groups = {"g": ["A", "B", "C"]}
    data = [(g, d, s, (d * 3 + s * 2 + ord(g)) % 9, int(g == "A" or (s + d) % 2)) for g in "ABC" for d in range(2) for s in range(4)]
    got = survival.cox_stratified(_events_df(spark, data), groups).filter(F.col("subset") == subsets.FULL).collect()
    assert sorted(r["test"] for r in got) == ["Stratified Cox LRT (all generators)", "Stratified Cox LRT (excluding A)"]
    assert all(r["statistic"] >= 0 for r in got)


# ------------------------------------------------- trajectories and balances
def test_coverage_gate(spark):
    keys = "generator string, dseed long, mseed long, generation int"
    flagged = spark.createDataFrame([("G", 1, s, g) for g, chains in ((3, [1]), (4, [1, 2])) for s in chains], keys)
    sizes = spark.createDataFrame([("G", 1, s, g, 10) for s in range(1, 5) for g in (3, 4)], keys + ", n_rows int")
    got = sorted((r["generation"], r["n_flagged"]) for r in trajectories.chain_rates_gated(flagged, sizes, m.CHAIN_KEYS, sizes).collect())
    assert got == [(4, 0), (4, 0), (4, 1), (4, 1)]


def test_two_balance_conventions(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 0, 0, 1)] + [("b", 0), ("b", 0)], "k string, readmission int")
    first = {r["k"]: (r["minority_share"], r["n_classes"]) for r in labels.class_balance(df, ["k"]).collect()}
    second = {r["k"]: (r["minority_fraction"], r["n_classes"]) for r in labels.label_balance(df, ["k"], "readmission").collect()}
    assert first == {"a": (0.25, 2), "b": (0.0, 1)} and second == {"a": (0.25, 2), "b": (1.0, 1)}


def test_flat_values_have_no_density_curve(spark):
    counts = spark.createDataFrame([("a", "x", 1.0, 50), ("b", "x", 1.0, 2), ("b", "x", 2.0, 2)], "g string, feature string, value double, n long")
    ranges = di.clip_range(counts, ["g", "feature"], [])
    assert ranges.filter("g = 'a'").first()["hi"] == 2.0
    assert di.kernel_density(counts, ranges, ["g", "feature"], []).count() == 0


def test_tags_are_split_and_trimmed(spark):
    frame = spark.createDataFrame([("a; b; c1; d",), (" x0 ;; y1 ",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(rules.split_tags(F.col("t"))).collect()] == [["a", "b", "c1", "d"], ["x0", "y1"], [], []]


@pytest.mark.parametrize("limit", [0, 5000])
def test_values_of_a_feature_that_the_population_never_fills(spark, limit):
    from tabaudit.operators.novelty import feature_levels

    population = spark.createDataFrame([("M", None), ("F", None)], "gender string, bmi string")
    frame = spark.createDataFrame([(1, "M", None), (2, "X", "High"), (3, None, "High")], "ID int, gender string, bmi string")
    out = rules.out_of_population(frame, {}, feature_levels(population, ["gender", "bmi"]), ["ID"], ["gender", "bmi"], literal_limit=limit)
    assert {r["ID"]: r["offenders"] for r in out.collect()} == {1: "", 2: "gender; bmi", 3: "bmi"}


def test_tau_fails_on_generations_beyond_its_table(spark):
    cells = spark.createDataFrame([("a", 0, 22, 1), ("a", 3, 4, 1)], "k string, x int, y int, n int")
    with pytest.raises(Exception, match="generation 22 is beyond 0..19"):
        paired.tau_b(cells, ["k"]).collect()


def test_p_values_name_their_method(spark):
    rows = [("few", 1, i, i, i + 1 + i % 3 * 4) for i in range(6)] + [("many", 1, i, i % 19, (i * 7) % 19) for i in range(60)]
    chains = spark.createDataFrame(rows, "k string, dseed long, mseed long, x int, y int")
    for method, few in (("auto", "exact"), ("normal", "normal")):
        out = {r["k"]: r for r in paired.paired_timing(chains, ["k"], method=method).filter("subset = 'Full population'").collect()}
        assert out["few"]["tau_p_method"] in (few, "normal") and out["many"]["tau_p_method"] == "normal"
        assert out["many"]["wilcoxon_p_method"] == "normal"
    distinct = spark.createDataFrame([("d", 1, i, i, 2 * i + 1) for i in range(6)], "k string, dseed long, mseed long, x int, y int")
    found = {m: paired.paired_timing(distinct, ["k"], method=m).filter("subset = 'Full population'").first() for m in ("auto", "normal")}
    assert [found[m]["tau_p_method"] for m in found] == ["exact", "normal"] and [found[m]["wilcoxon_p_method"] for m in found] == ["exact", "normal"]
    assert found["auto"]["tau_p"] == pytest.approx(2 / 720) and found["auto"]["wilcoxon_p"] == pytest.approx(2 / 64)
