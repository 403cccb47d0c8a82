"""Null-safe building blocks shared by every operator (all JVM expressions)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOATING = ("double", "float")
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def truth(predicate: Column) -> Column:
    """A predicate that is false, never null, when an input is missing."""
    return F.coalesce(predicate, F.lit(False))


def finite(value: Column) -> Column:
    """Null for NaN and the infinities (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def number_text(types: dict[str, str], name: str) -> str:
    """SQL text for column ``name`` as a finite double; unreadable values are null.

    Large expressions are assembled as text and parsed once: a plan of a
    thousand nodes then costs one call to the JVM instead of thousands.
    """
    kind = types[name]
    if kind in _WHOLE or kind.startswith("decimal"):
        return f"CAST(`{name}` AS DOUBLE)"
    if kind in _FLOATING:
        value = f"CAST(`{name}` AS DOUBLE)" if kind == "float" else f"`{name}`"
    elif kind == "boolean":
        return f"CAST(CAST(`{name}` AS INT) AS DOUBLE)"
    else:
        value = f"try_cast(trim(CAST(`{name}` AS STRING)) AS DOUBLE)"
    return f"CASE WHEN abs({value}) < double('infinity') THEN {value} END"


def as_number(types: dict[str, str], name: str) -> Column:
    """``number_text`` as a column."""
    return F.expr(number_text(types, name))


def text_literal(value: str) -> str:
    """A string as SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def round_half_even(value: Column, places: int = 0) -> Column:
    """Round the scaled double half to even (``rint``), as array libraries do."""
    if places == 0:
        return F.rint(value)
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def settle(value: Column, places: int = 6) -> Column:
    """Stable rounding for published doubles: plain IEEE floor, no decimal text.

    The offset is a little above one half, so that an exact tie rounds up even
    when summation order moved it by an ulp.
    """
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.500003)) / F.lit(scale)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null when the denominator is zero, missing or not finite."""
    return F.try_divide(top.cast("double"), finite(bottom.cast("double")))


def count_true(predicates: Iterable[Column]) -> Column:
    """How many of the predicates hold (null counts as false)."""
    return reduce(lambda a, b: a + b, (truth(p).cast("int") for p in predicates))


def any_true(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, (truth(p) for p in predicates))


def all_true(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, (truth(p) for p in predicates))


def label_map(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Lookup in a small literal dictionary; unmapped keys give null/default."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)
