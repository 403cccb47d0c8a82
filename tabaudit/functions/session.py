"""Session settings the operators rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# HotSpot does not compile methods above this many bytes of bytecode.
_HOTSPOT_LIMIT = 8000
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def jit_friendly(spark: SparkSession) -> None:
    """Let very large projections leave whole-stage code generation.

    Fused into one generated method, a projection the size of the rule set is
    too large for the JIT compiler and runs interpreted; on its own it is
    compiled as many small methods.  Smaller stages are not affected.
    """
    if int(spark.conf.get(_LIMIT)) > _HOTSPOT_LIMIT:
        spark.conf.set(_LIMIT, str(_HOTSPOT_LIMIT))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
