"""Domain plausibility rules.

A rule is a name, a bucket (impossible / suspicious) and a SQL predicate over
the record's features.  A rule list compiles to one projection with one bit
per rule: two 64-bit masks per record are enough for every rate and count, and
names are only produced for records that were flagged.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit import model as m
from tabaudit.functions.columns import number_text, round_half_even, text_literal
from tabaudit.functions.session import jit_friendly
from tabaudit.sources.sinks import reliable

IMPOSSIBLE, SUSPICIOUS = "impossible", "suspicious"


_LOW, _HIGH, _TEXT = "__lo_", "__hi_", "__tx_"
_DERIVED = {"pulse_pressure": ("systolic_bp", "diastolic_bp"), "urea_ratio": ("blood_urea_nitro", "creatinine")}


def _readable(types: dict[str, str]) -> list[str]:
    """Never-null forms of the features.

    A missing number is +infinity where it is compared with an upper bound and
    -infinity where it is compared with a lower one, so it satisfies no
    comparison; a missing text is ''.  Without nulls the compiled predicates
    stay small enough for the JIT compiler.
    """
    numbers = {c: f"({number_text(types, c)})" for c in m.NUMERIC_FEATURES if c in types}

    def number(name: str) -> str:
        return numbers.get(name, "CAST(NULL AS DOUBLE)")

    sbp, dbp = (number(c) for c in _DERIVED["pulse_pressure"])
    urea, creatinine = (number(c) for c in _DERIVED["urea_ratio"])
    values = {c: number(c) for c in m.NUMERIC_FEATURES}
    values["pulse_pressure"] = f"({sbp} - {dbp})"
    values["urea_ratio"] = f"({urea} / CASE WHEN {creatinine} > 0 THEN {creatinine} END)"
    out = []
    for name, value in values.items():
        out.append(f"coalesce({value}, double('infinity')) AS {_LOW}{name}")
        out.append(f"coalesce({value}, double('-infinity')) AS {_HIGH}{name}")
    for name in m.CATEGORY_FEATURES + m.ORDINAL_FEATURES:
        out.append((f"coalesce(`{name}`, '')" if name in types else "''") + f" AS {_TEXT}{name}")
    return out


class Record:
    """SQL predicates over the readable features; none of them is ever null."""

    def __init__(self, types: dict[str, str]):
        self.types = types

    def below(self, name: str, bound: float) -> str:
        return f"{_LOW}{name} < {float(bound)}D"

    def at_most(self, name: str, bound: float) -> str:
        return f"{_LOW}{name} <= {float(bound)}D"

    def above(self, name: str, bound: float) -> str:
        return f"{_HIGH}{name} > {float(bound)}D"

    def at_least(self, name: str, bound: float) -> str:
        return f"{_HIGH}{name} >= {float(bound)}D"

    def outside(self, name: str, low: float, high: float) -> str:
        return either([self.below(name, low), self.above(name, high)])

    def normal(self, name: str) -> str:
        low, high = m.NORMAL_RANGE[name]
        return both(self.at_least(name, low), self.at_most(name, high))

    def beyond(self, bounds: dict, name: str) -> list[str]:
        """At or beyond the bound, for each bound that exists."""
        low, high = bounds.get(name, (None, None))
        sides = ((self.at_most, low), (self.at_least, high))
        return [test(name, bound) for test, bound in sides if bound is not None]

    def extreme_low(self, name: str) -> str:
        return self.at_most(name, m.EXTREME_BOUND[name][0])

    def extreme_high(self, name: str) -> str:
        return self.at_least(name, m.EXTREME_BOUND[name][1])

    def tame(self, name: str) -> str:
        """Present and strictly inside the extreme bounds."""
        low, high = m.EXTREME_BOUND[name]
        sides = ((self.above, low), (self.below, high))
        return both(*[test(name, bound) for test, bound in sides if bound is not None])

    def among(self, name: str, *levels: str) -> str:
        return f"{_TEXT}{name} IN ({', '.join(text_literal(x) for x in levels)})"

    def present(self, name: str) -> str:
        return f"{_LOW}{name} < double('infinity')"


def with_readable(df: DataFrame) -> tuple[DataFrame, Record, list[str]]:
    """Add the columns a Record refers to; also returns the original column names."""
    types = dict(df.dtypes)
    return df.selectExpr("*", *_readable(types)), Record(types), list(types)


def both(*predicates: str) -> str:
    return " AND ".join(f"({p})" for p in predicates)


def either(predicates: list[str]) -> str:
    return " OR ".join(f"({p})" for p in predicates)


def how_many(predicates: list[str]) -> str:
    return "(" + " + ".join(f"CAST({p} AS INT)" for p in predicates) + ")"


@dataclass(frozen=True)
class Rule:
    """``when`` turns a Record into the SQL predicate of the rule."""

    name: str
    bucket: str
    description: str
    when: Callable[[Record], str]


def _bad_category(r: Record) -> str:
    wrong = [
        f"`{name}` IS NOT NULL AND NOT {r.among(name, *levels)}"
        for name, levels in m.ALLOWED_LEVELS.items() if name in r.types
    ]
    for name in m.BOOLEAN_FEATURES:
        kind = r.types.get(name)
        if kind == "string":
            allowed = ", ".join(text_literal(x) for x in m.BOOLEAN_TEXT_LEVELS)
            wrong.append(f"`{name}` IS NOT NULL AND `{name}` NOT IN ({allowed})")
        elif kind not in (None, "boolean"):
            wrong.append(f"`{name}` IS NOT NULL AND `{name}` NOT IN (0, 1)")
    return either(wrong or ["false"])


def _fatal_constellation(r: Record, vitals: str) -> str:
    crossed = {n: "(" + either(r.beyond(m.FATAL_BOUND, n)) + ")" for n in m.FATAL_BOUND}
    disturbed = either([p for n in m.PRIMARY_VITALS for p in r.beyond(m.EXTREME_BOUND, n)])
    return both(
        f"{how_many(list(crossed.values()))} >= 3",
        either([crossed[n] for n in m.PRIMARY_VITALS]),
        f"NOT ({disturbed})" if vitals == "pristine" else disturbed,
    )


def _pulse_vanished(r: Record) -> str:
    """Pulse pressure all but zero although the other vitals are not extreme."""
    return both(r.at_most("pulse_pressure", 2), r.tame("heartrate"), r.tame("respiratory_rate"), r.tame("spo2"))


def _no_compensation(r: Record) -> list[str]:
    return [r.normal("heartrate"), r.at_most("respiratory_rate", m.NORMAL_RANGE["respiratory_rate"][1])]


def _pregnant(r: Record) -> str:
    return r.among("icd9", "Pregnancy")


# Order is the order in which tags are listed.
RULES: list[Rule] = [
    Rule("reality_limit", IMPOSSIBLE, "value outside absolute measurable physiological range",
         lambda r: either([r.outside(n, *limits) for n, limits in m.MEASURABLE_RANGE.items()])),
    Rule("bad_category", IMPOSSIBLE, "categorical value not in allowed set", _bad_category),
    Rule("dbp_ge_sbp", IMPOSSIBLE, "diastolic BP >= systolic BP", lambda r: r.at_most("pulse_pressure", 0)),
    Rule("pp_zero", IMPOSSIBLE, "pulse pressure <=2 with non-extreme vitals",
         lambda r: both(r.above("pulse_pressure", 0), _pulse_vanished(r))),
    Rule("buncr_ratio_impossible", IMPOSSIBLE, "BUN/Cr ratio < 1.0 (physically impossible)",
         lambda r: r.below("urea_ratio", 1.0)),
    Rule("rr_spo2_impossible", IMPOSSIBLE, "RR <=3 with SpO2 >=98 (agonal RR + normal sat)",
         lambda r: both(r.at_most("respiratory_rate", 3), r.at_least("spo2", 98))),
    Rule("fatal_constellation_impossible", IMPOSSIBLE, ">=3 fatal-range values with all primary vitals pristine",
         lambda r: _fatal_constellation(r, "pristine")),
    Rule("preg_male", IMPOSSIBLE, "Pregnancy diagnosis with gender=M",
         lambda r: both(_pregnant(r), r.among("gender", "M"))),
    Rule("preg_age", IMPOSSIBLE, "Pregnancy diagnosis outside reproductive age range",
         lambda r: both(_pregnant(r), r.outside("age", 8, 60))),
    Rule("pp_low", SUSPICIOUS, "pulse pressure <5 with fully normal vitals",
         lambda r: both(r.above("pulse_pressure", 0), r.below("pulse_pressure", 5), f"NOT ({_pulse_vanished(r)})",
                        *[r.normal(n) for n in ("heartrate", "respiratory_rate", "spo2", "systolic_bp")])),
    Rule("pp_wide", SUSPICIOUS, "wide pulse pressure (>150) in younger patient, SBP not extreme",
         lambda r: both(r.above("pulse_pressure", 150), r.below("systolic_bp", 200), r.below("age", 60))),
    Rule("pp_htn_narrow", SUSPICIOUS, "extreme hypertension (SBP>=200) with near-zero pulse pressure",
         lambda r: both(r.at_least("systolic_bp", 200), r.above("pulse_pressure", 0), r.below("pulse_pressure", 10))),
    Rule("buncr_ratio_high", SUSPICIOUS, "BUN/Cr >100 with high BUN and no anemia",
         lambda r: both(r.above("urea_ratio", 100), r.above("blood_urea_nitro", 80), r.at_least("hemoglobin", 11))),
    Rule("low_cr", SUSPICIOUS, "creatinine implausibly low for adult",
         lambda r: both(r.at_most("creatinine", 0.1), r.at_least("age", 18))),
    Rule("comp_anemia", SUSPICIOUS, "severe anemia with no HR or RR compensation despite hypotension",
         lambda r: both(r.at_most("hemoglobin", 5), r.below("systolic_bp", 90), *_no_compensation(r))),
    Rule("comp_shock", SUSPICIOUS, "severe shock (SBP<50) with no HR or RR compensation",
         lambda r: both(r.below("systolic_bp", 50), *_no_compensation(r))),
    Rule("comp_hyperk", SUSPICIOUS, "severe hyperkalemia with normal HR and normal kidneys",
         lambda r: both(r.at_least("potassium", 7.5), r.normal("heartrate"), r.below("creatinine", 1.0))),
    Rule("comp_hypona", SUSPICIOUS, "severe hyponatremia with shock and abnormal HR",
         lambda r: both(r.below("sodium", 110), r.below("systolic_bp", 90), r.outside("heartrate", 60, 120))),
    Rule("pair_cardiogenic", SUSPICIOUS, "extreme bradycardia + extreme hypotension with preserved respiration",
         lambda r: both(r.extreme_low("heartrate"), r.extreme_low("systolic_bp"), r.tame("spo2"), r.tame("respiratory_rate"))),
    Rule("pair_htn_brady", SUSPICIOUS, "extreme hypertension + extreme bradycardia",
         lambda r: both(r.extreme_high("systolic_bp"), r.extreme_low("heartrate"))),
    Rule("pair_tachy_htn", SUSPICIOUS, "extreme tachycardia + extreme hypertension",
         lambda r: both(r.extreme_high("heartrate"), r.extreme_high("systolic_bp"))),
    Rule("fatal_constellation_suspicious", SUSPICIOUS, ">=3 fatal-range values (with disturbed vitals)",
         lambda r: _fatal_constellation(r, "disturbed")),
    Rule("extreme_count", SUSPICIOUS, ">=5 features crossing extreme thresholds",
         lambda r: f"{how_many([p for n in m.EXTREME_BOUND for p in r.beyond(m.EXTREME_BOUND, n)])} >= 5"),
    Rule("elderly_f_highhb", SUSPICIOUS, "elderly female with extreme-high hemoglobin",
         lambda r: both(r.above("age", 60), r.among("gender", "F"), r.at_least("hemoglobin", 18))),
    Rule("preg_hb", SUSPICIOUS, "Pregnancy with Hb>15", lambda r: both(_pregnant(r), r.above("hemoglobin", 15))),
    Rule("pregnancy_elective", SUSPICIOUS, "Pregnancy diagnosis with elective admission",
         lambda r: both(_pregnant(r), r.among("admission_type", "ELECTIVE"))),
    Rule("unknown_extremelabs", SUSPICIOUS, "UNKNOWN diagnosis with extreme labs",
         lambda r: both(r.among("icd9", "UNKNOWN"), either([
             r.among("bnp", "Critical"), r.extreme_high("creatinine"),
             r.extreme_high("potassium"), r.extreme_low("hemoglobin")]))),
    Rule("circ_nomarkers", SUSPICIOUS, "cardiac diagnosis with no cardiac markers and normal vitals",
         lambda r: both(r.among("icd9", "Circulatory system"), r.among("cholesterol", "Lowrisk"), r.among("bnp", "Normal"),
                        r.normal("heartrate"), r.normal("systolic_bp"))),
    Rule("nut_chol_maln", SUSPICIOUS, "Highrisk cholesterol with severe malnutrition pattern",
         lambda r: both(r.among("cholesterol", "Highrisk"), r.among("bmi", "Underweight"), r.among("albumin", "Low"),
                        r.at_most("hemoglobin", 7))),
    Rule("nut_obese_hypo", SUSPICIOUS, "Obese + hypotension + low albumin + normal BNP",
         lambda r: both(r.among("bmi", "Obese", "Morbidly obese"), r.at_most("systolic_bp", 90),
                        r.among("albumin", "Low"), r.among("bnp", "Normal"))),
    Rule("alb_obese_anemia", SUSPICIOUS, "low albumin + elevated BMI + severe anemia",
         lambda r: both(r.among("albumin", "Low"), r.among("bmi", *m.RAISED_BMI), r.at_most("hemoglobin", 5),
                        f"NOT {r.among('icd9', *m.WASTING_CHAPTERS)}")),
    Rule("alb_high_underwt", SUSPICIOUS, "albumin High with Underweight",
         lambda r: both(r.among("albumin", "High"), r.among("bmi", "Underweight"))),
    Rule("alb_high_wasting", SUSPICIOUS, "albumin High with protein-wasting diagnosis",
         lambda r: both(r.among("albumin", "High"), r.among("icd9", *m.WASTING_CHAPTERS))),
    Rule("severe_hypok", SUSPICIOUS, "severe hypokalemia (K<=2.0) with normal HR",
         lambda r: both(r.at_most("potassium", 2.0), r.normal("heartrate"))),
]
# Described in the catalogue, but without a predicate: they never fire.
INACTIVE_RULES = {
    "nut_impossible": (IMPOSSIBLE, "Underweight + albumin High + Hb>=17 (metabolic contradiction)"),
    "nut_alb_normal": (SUSPICIOUS, "albumin Normal despite Underweight + severe anemia"),
}

IMPOSSIBLE_MASK, SUSPICIOUS_MASK = "impossible_mask", "suspicious_mask"
_MASK = {IMPOSSIBLE: IMPOSSIBLE_MASK, SUSPICIOUS: SUSPICIOUS_MASK}


def _in_bucket(rules: list[Rule], bucket: str) -> list[Rule]:
    return [r for r in rules if r.bucket == bucket]


def _mask_text(record: Record, bucket: str, rules: list[Rule]) -> str:
    bits = [
        f"CASE WHEN {rule.when(record)} THEN {1 << bit}L ELSE 0L END"
        for bit, rule in enumerate(_in_bucket(rules, bucket))
    ]
    return " + ".join(bits) or "0L"


def apply_rules(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add the two rule masks; a narrow projection, no shuffle.

    The one-row ``inline`` after the projection keeps the optimizer from copying
    the whole rule set into the filters and bit tests downstream.
    """
    jit_friendly(df.sparkSession)
    readable, record, columns = with_readable(df)
    original = [f"`{c}`" for c in columns]
    masks = [f"{_mask_text(record, bucket, rules)} AS __{name}" for bucket, name in _MASK.items()]
    barrier = ", ".join(f"'{name}', __{name}" for name in _MASK.values())
    return readable.selectExpr(*original, *masks).selectExpr(*original, f"inline(array(named_struct({barrier})))")


def flags(df: DataFrame) -> DataFrame:
    """Boolean flags of a masked table (any = impossible or suspicious)."""
    return df.selectExpr(
        "*", f"{IMPOSSIBLE_MASK} != 0 AS impossible", f"{SUSPICIOUS_MASK} != 0 AS suspicious",
        f"{IMPOSSIBLE_MASK} != 0 OR {SUSPICIOUS_MASK} != 0 AS any_rule",
    )


def _named_bits(bucket: str, rules: list[Rule]) -> str:
    """SQL text of the array of names of the set bits of a bucket's mask, in rule order."""
    names = ", ".join(
        f"CASE WHEN {_MASK[bucket]} & {1 << bit}L != 0 THEN '{rule.name}' END"
        for bit, rule in enumerate(_in_bucket(rules, bucket))
    )
    return f"array_compact(CAST(array({names}) AS ARRAY<STRING>))"


def tags(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add the printed tag lists ``impossible_tags`` and ``suspicious_tags``."""
    return df.selectExpr("*", *[f"array_join({_named_bits(b, rules)}, '; ') AS {b}_tags" for b in _MASK])


_ANY = f"{IMPOSSIBLE_MASK} != 0 OR {SUSPICIOUS_MASK} != 0"


def flag_rows(masked: DataFrame, keep: list[str]) -> DataFrame:
    """Long flag table: keep + metric, flagged records only."""
    hit = (
        f"array_compact(array(CASE WHEN {IMPOSSIBLE_MASK} != 0 THEN 'Expert_impossible' END, "
        f"CASE WHEN {SUSPICIOUS_MASK} != 0 THEN 'Expert_suspicious' END, 'Expert_any'))"
    )
    return masked.filter(_ANY).selectExpr(*keep, f"explode({hit}) AS metric")


def rule_rows(masked: DataFrame, keep: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """Long rule table: keep + category + rule, one row per fired rule."""
    fired = ", ".join(
        f"CASE WHEN {_MASK[rule.bucket]} & {1 << bit}L != 0 THEN named_struct('category', '{rule.bucket}', 'rule', '{rule.name}') END"
        for bucket in _MASK
        for bit, rule in enumerate(_in_bucket(rules, bucket))
    )
    return masked.filter(_ANY).selectExpr(*keep, f"inline(array_compact(array({fired})))")


def split_tags(tag_text: Column) -> Column:
    """'a; b' to its trimmed, non-empty parts."""
    parts = F.transform(F.split(F.coalesce(tag_text, F.lit("")), ";"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def rule_table(masked: DataFrame, keys: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """keys, n_rows, category, rule, n for every rule, fired or not.

    Counted as one sum per rule and group before anything is reshaped, so no
    exploded rows are shuffled.
    """
    sums = [
        F.expr(f"sum(shiftright({_MASK[bucket]}, {bit}) & 1L) AS {rule.name}")
        for bucket in _MASK
        for bit, rule in enumerate(_in_bucket(rules, bucket))
    ]
    wide = masked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    items = ", ".join(f"named_struct('category', '{r.bucket}', 'rule', '{r.name}', 'n', {r.name})" for r in rules)
    return wide.selectExpr(*keys, "n_rows", f"inline(array({items}))")


def rule_counts(masked: DataFrame, keys: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """keys, category, rule, n for every fired rule."""
    return rule_table(masked, keys, rules).filter("n > 0").drop("n_rows")


def rule_rates(masked: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: row count, flag rates of the buckets and violation totals."""
    flagged = flags(masked)
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("impossible").alias("n_impossible"),
        F.count_if("suspicious").alias("n_suspicious"),
        F.count_if("any_rule").alias("n_any"),
        F.avg(F.col("impossible").cast("double")).alias("impossible_rate"),
        F.avg(F.col("suspicious").cast("double")).alias("suspicious_rate"),
        F.avg(F.col("any_rule").cast("double")).alias("any_rate"),
        F.sum(F.bit_count(IMPOSSIBLE_MASK)).alias("impossible_violations"),
        F.sum(F.bit_count(SUSPICIOUS_MASK)).alias("suspicious_violations"),
    ).withColumn("any_violations", F.col("impossible_violations") + F.col("suspicious_violations"))


def rule_summary(masked: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """bucket, rule, count, pct_rows, description over the whole table."""
    counts = rule_table(masked, [], rules).filter("n > 0")
    text = F.expr("map(" + ", ".join(f"'{r.name}', {text_literal(r.description)}" for r in rules) + ")")
    return counts.select(
        F.col("category").alias("bucket"), "rule", F.col("n").alias("count"),
        round_half_even(F.lit(100.0) * F.col("n") / F.col("n_rows"), 3).alias("pct_rows"),
        F.try_element_at(text, F.col("rule")).alias("description"),
    )


# ------------------------------------------------------ population-range check
#: Strange levels that are broadcast; more are met by a shuffle.
BROADCAST_LEVELS = 1_000_000


def out_of_population(
    df: DataFrame,
    bounds: dict[str, tuple[float | None, float | None]],
    levels: DataFrame,
    keep: list[str],
    categorical: list[str] = m.RANGE_CHECK_CATEGORICAL,
    literal_limit: int = 5000,
    unseen_limit: int = 5000,
) -> DataFrame:
    """``keep`` + ``offenders``: features whose value the population never shows.

    ``levels`` is the distinct (feature, level) table.  Up to ``literal_limit``
    pairs it becomes an in-memory set inside the projection.  Beyond that the
    distinct pairs of the records, which combine map-side, are met with it, and
    only those that the population lacks go on: as a set inside the projection
    again, by a broadcast, or, where they are very many and so no key is hot,
    by a join of each feature.  In all forms a
    feature that the population never fills has no level, so any value offends;
    a column that the population lacks is left out of ``categorical``.
    """
    jit_friendly(df.sparkSession)
    source, record, types = with_readable(df)
    numeric = [c for c in m.RANGE_CHECK_NUMERIC if bounds.get(c, (None,))[0] is not None and c in types]
    found = [
        f"CASE WHEN {record.outside(c, *bounds[c])} THEN '{c}' END"
        for c in numeric
    ]
    known = levels.limit(literal_limit + 1).collect()
    cats = [c for c in categorical if c in types]
    if len(known) <= literal_limit:
        by_feature: dict[str, list[str]] = {}
        for row in known:
            by_feature.setdefault(row["feature"], []).append(text_literal(row["level"]))
        found += [
            f"CASE WHEN CAST(`{c}` AS STRING) NOT IN ({', '.join(by_feature[c])}) THEN '{c}' END" if c in by_feature
            else f"CASE WHEN `{c}` IS NOT NULL THEN '{c}' END"
            for c in cats
        ]
    else:
        pairs = ", ".join(f"named_struct('feature', '{c}', 'level', CAST(`{c}` AS STRING))" for c in cats)
        shown = source.selectExpr(f"inline(array({pairs}))").filter("level IS NOT NULL").distinct()
        unseen = reliable(shown.join(levels.select("feature", "level"), ["feature", "level"], "left_anti"))
        few = unseen.limit(unseen_limit + 1).collect()
        if len(few) <= unseen_limit:
            strange: dict[str, list[str]] = {}
            for row in few:
                strange.setdefault(row["feature"], []).append(text_literal(row["level"]))
            found += [f"CASE WHEN CAST(`{c}` AS STRING) IN ({', '.join(strange[c])}) THEN '{c}' END" for c in cats if c in strange]
        else:
            small = unseen.count() <= BROADCAST_LEVELS
            for c in cats:
                side = unseen.filter(F.col("feature") == c).selectExpr(f"level AS __level_{c}", f"true AS __strange_{c}")
                source = source.join(F.broadcast(side) if small else side, F.col(c).cast("string") == F.col(f"__level_{c}"), "left")
                found.append(f"CASE WHEN __strange_{c} THEN '{c}' END")
    # nulls are skipped; unlike a lambda over an array, this is compiled
    checked = source.selectExpr(*keep, f"concat_ws('; ', {', '.join(found) or 'NULL'}) AS __offenders")
    # a barrier: a filter on the offenders must not be pushed down, with every feature written out in it
    return checked.selectExpr(*keep, "inline(array(named_struct('offenders', __offenders)))")


# ------------------------------------------------------------ silent files
def silent_files(masked: DataFrame, keys: list[str]) -> DataFrame:
    """Files in which no rule fired at all."""
    fired = F.max((F.col(IMPOSSIBLE_MASK) != 0) | (F.col(SUSPICIOUS_MASK) != 0))
    return masked.groupBy(*keys).agg(fired.alias("__fired")).filter(~F.col("__fired")).select(*keys)


def diagnose_silent(masked: DataFrame, keys: list[str], features: list[str] = m.FEATURES) -> DataFrame:
    """Why a file fired nothing: real collapse or unusable data.

    Only the rows of silent files are looked at; distinct rows are counted
    after a map-side distinct, so one repeated row stays one row per task.
    """
    source, record, types = with_readable(masked)
    present = [c for c in features if c in types]
    absent = [c for c in features if c not in types]
    numeric = [c for c in present if c in m.NUMERIC_FEATURES]
    silent = source.join(silent_files(masked, keys), keys, "left_semi")
    usable = how_many([f"({record.present(c)})" if c in numeric else f"(`{c}` IS NOT NULL)" for c in present])
    rows = silent.selectExpr(
        *keys,
        f"{usable} AS __usable",
        f"struct({', '.join(present)}) AS __row",
        *[f"`{c}` IS NOT NULL AS __has_{c}" for c in present],
        *[f"`{c}` IS NOT NULL AND NOT ({record.present(c)}) AS __text_{c}" for c in numeric],
    )
    distinct = rows.groupBy(*keys, "__row").agg(
        F.expr("count(1) AS __n"), F.expr("sum(__usable) AS __usable"),
        *[F.expr(f"max(__has_{c}) AS __has_{c}") for c in present],
        *[F.expr(f"max(__text_{c}) AS __text_{c}") for c in numeric],
    )
    dead = ", ".join(f"CASE WHEN NOT max(__has_{c}) THEN '{c}' END" for c in present)
    written = ", ".join(f"CASE WHEN max(__text_{c}) THEN '{c}' END" for c in numeric)
    per_file = distinct.groupBy(*keys).agg(
        F.expr("sum(__n) AS n_rows"), F.expr("count(1) AS unique_rows"), F.expr("sum(__usable) AS __usable"),
        F.expr(f"array_join(array_compact(array({dead})), ';') AS all_null_columns"),
        F.expr(f"array_join(array_compact(array({written})), ';') AS numeric_stored_as_text"),
    )
    total = F.col("n_rows") * F.lit(len(present))

    def listed(name: str) -> Column:
        return F.when(F.col(name) == "", F.lit(0)).otherwise(F.size(F.split(F.col(name), ";")))

    note = f" (note: {len(absent)} input column(s) absent)" if absent else ""
    cause = (
        F.when(F.lit(not present), F.lit("no rule input columns present"))
        .when(F.col("__usable") / total < 0.5, F.lit("unusable values — rate is NOT a real zero"))
        .when(
            F.col("numeric_stored_as_text") != "",
            F.format_string("numeric stored as text (%d) — rules cannot read it", listed("numeric_stored_as_text")),
        )
        .when(
            F.col("all_null_columns") != "",
            F.format_string("all-NaN columns (%d) — those rules cannot fire", listed("all_null_columns")),
        )
        .when(
            F.col("unique_rows") <= F.greatest(F.lit(5.0), F.lit(0.001) * F.col("n_rows")),
            F.lit("mode collapse — few unique rows"),
        )
        .otherwise(F.lit("values usable and varied — no rule triggered" + note))
    )
    return per_file.select(
        *keys, "n_rows", "unique_rows",
        round_half_even(F.lit(100.0) * F.col("unique_rows") / F.col("n_rows"), 3).alias("unique_row_pct"),
        round_half_even(F.lit(100.0) * F.col("__usable") / total, 3).alias("usable_value_pct"),
        "all_null_columns", "numeric_stored_as_text",
        F.lit(";".join(absent)).alias("missing_columns"),
        cause.alias("likely_cause"),
    )


def silent_by_folder(diagnosis: DataFrame, folder: list[str]) -> DataFrame:
    return diagnosis.groupBy(*folder).agg(
        F.count(F.lit(1)).alias("silent_files"), F.min("generation").alias("first_silent_generation")
    )
