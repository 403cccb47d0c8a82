"""What a registered query is, and helpers for its check in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.functions.columns import settle
from tabaudit.functions.tails import t_quantile_975

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None = None


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Query] = {}

    def query(self, sql: str | None = None) -> Callable[[Runner], Runner]:
        """Register a builder under its function name, with its SQL check."""

        def add(run: Runner) -> Runner:
            self.entries[run.__name__] = Query(run.__name__, run, sql)
            return run

        return add


def r6(name: str | Column, alias: str | None = None) -> Column:
    """Published double: settled to six decimals."""
    column = F.col(name) if isinstance(name, str) else name
    return settle(column).alias(alias or name)


def s6(expression: str, alias: str | None = None) -> str:
    """The same rounding as SQL text."""
    return f"floor(({expression}) * 1e6 + 0.500003) / 1e6 AS {alias or expression}"


def long_of(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def t_values(largest: int = 400) -> str:
    """CTE of 0.975 t quantiles for the SQL checks."""
    rows = ", ".join(f"({k}, {t_quantile_975(k)!r})" for k in range(1, largest + 1))
    return f"tq(df, tcrit) AS (VALUES {rows})"


T_CTE = t_values()


def pooled_sql(source: str, keys: str, value: str, prefix: str = "") -> str:
    """SELECT of mean/var/interval/min/max/n per key, for the SQL checks."""
    key_list = ", ".join(k.strip() for k in keys.split(","))
    return f"""
  SELECT {key_list}, n AS {prefix}n, {s6('mean', prefix + 'mean')}, {s6('var', prefix + 'var')},
         {s6('mean - coalesce(tcrit, 0) * sqrt(var) / sqrt(n)', prefix + 'low')},
         {s6('mean + coalesce(tcrit, 0) * sqrt(var) / sqrt(n)', prefix + 'high')},
         {s6('mn', prefix + 'min')}, {s6('mx', prefix + 'max')}
  FROM (SELECT {key_list}, count({value}) AS n, avg({value}) AS mean,
               CASE WHEN count({value}) > 0 THEN coalesce(var_samp({value}), 0) END AS var,
               min({value}) AS mn, max({value}) AS mx FROM {source} GROUP BY ALL) g
  LEFT JOIN tq ON tq.df = g.n - 1"""


def pooled_out(df: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    stats = ["mean", "var", "low", "high", "min", "max"]
    return df.select(*keys, F.col(f"{prefix}n"), *[r6(f"{prefix}{s}") for s in stats])


def chi2_tail_sql(statistic: str, df: str) -> str:
    """Chi-square upper tail as a series of the lower incomplete gamma function."""
    a, x = f"(({df}) / 2.0)", f"(({statistic}) / 2.0)"
    terms = f"list_transform(range(400), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1)))"
    return f"CASE WHEN ({statistic}) IS NULL OR ({df}) IS NULL THEN NULL WHEN ({statistic}) <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum({terms})) END"
