"""Keyed state in event time: flag rates per window, and onsets as soon as they are certain.

Both operators see the watermark themselves.  What lies behind it is counted
and returned under its own kind, where Spark's own aggregations would drop it
without a word; what the watermark passes is emitted once and leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


# ------------------------------------------------------------- rates per window
WINDOW_RATES = "kind string, {key} string, window_start bigint, n_rows bigint, n_flagged bigint"


class _WindowCounts(StatefulProcessor):
    """Rows and flags of one key and window; emitted when the watermark passes the window's end."""

    def __init__(self, width_ms: int) -> None:
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n_rows long, n_flagged long")

    def _row(self, kind: str, key: tuple, rows: int, flagged: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": [kind], "key": [key[0]], "window_start": [key[1]], "n_rows": [rows], "n_flagged": [flagged]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = flagged = 0
        for part in rows:
            n, flagged = n + int(part["n_rows"].sum()), flagged + int(part["n_flagged"].sum())
        end = key[1] + self.width_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row("late", key, n, flagged)
            return
        if self.counts.exists():
            old = self.counts.get()
            n, flagged = n + old[0], flagged + old[1]
        else:
            self.handle.registerTimer(end)
        self.counts.update((n, flagged))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, flagged = self.counts.get()
        self.counts.clear()
        yield self._row("closed", key, n, flagged)

    def close(self) -> None:
        pass


def _partial_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per key and window of each batch, so that a common key sends few rows."""
    for part in parts:
        yield part.groupby(["key", "window_start"], as_index=False, dropna=False).agg(n_rows=("flag", "size"), n_flagged=("flag", "sum"))


def window_rates(stream: DataFrame, key: str, time: str, flag: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(``kind``, ``key``, ``window_start`` in ms, ``n_rows``, ``n_flagged``) of a stream of records.

    Kind ``closed`` comes once per key and window, when the watermark (the
    latest time less ``delay``) passes the window's end, and leaves no state.
    Kind ``late`` counts, per micro-batch, records whose window was closed
    before they came.  Run it in ``keyed_state`` with output mode "update".
    """
    width_ms = int(pd.Timedelta(width).total_seconds() * 1000)
    marked = stream.withWatermark(time, delay)
    at = F.floor(F.unix_millis(F.col(time)) / width_ms) * width_ms
    rows = marked.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), at.cast("bigint").alias("window_start"), F.coalesce(F.col(flag).cast("int"), F.lit(0)).alias("flag"))
    partial = rows.mapInPandas(_partial_counts, "key string, window_start bigint, n_rows bigint, n_flagged bigint")
    return partial.groupBy("key", "window_start").transformWithStateInPandas(_WindowCounts(width_ms), WINDOW_RATES.format(key="key"), "Update", "EventTime")


# ------------------------------------------------------------------ onsets
class _Onset(StatefulProcessor):
    """The observed generations of one chain and metric until its onset is certain."""

    def __init__(self, metrics: dict[str, tuple[float, str]], patience_ms: int) -> None:
        self.metrics, self.patience_ms = metrics, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a chain has one value per generation, so this list stays short
        self.seen = handle.getListState("seen", "generation long, value double")
        self.done = handle.getValueState("done", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def _first(self, metric: str, values: list[tuple[int, float]]) -> tuple[int, float] | None:
        threshold, direction = self.metrics[metric]
        for (_, before), (generation, value) in zip(values, values[1:]):
            step = value - before
            if step >= threshold if direction == "increase" else step <= -threshold:
                return generation, step
        return None

    def _row(self, kind: str, key: tuple, onset: tuple[int, float] | None, rows: int) -> pd.DataFrame:
        generation, step = onset or (None, None)
        return pd.DataFrame({"kind": [kind], "metric": [key[0]], "chain": [key[1]], "onset_generation": pd.array([generation], "Int64"), "step_size": pd.array([step], "Float64"), "n_rows": [rows]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if self.done.exists():
            yield self._row("late", key, None, len(new))
            return
        held = {g: v for g, v in self.seen.get()} if self.seen.exists() else {}
        for generation, value in zip(new["generation"], new["value"]):
            held[int(generation)] = float(value)  # the same generation again replaces it
        whole = []
        for generation in range(len(held)):
            if generation not in held:
                break
            whole.append((generation, held[generation]))
        found = self._first(key[0], [(g, v) for g, v in whole if v == v])
        if found is not None:  # nothing that may still come lies before it
            self._finish(found[0])
            yield self._row("onset", key, found, len(held))
            return
        self.seen.put(list(held.items()))
        due = max(int(new["at"].max()), timerValues.getCurrentWatermarkInMs()) + self.patience_ms
        if self.timer.exists():
            if self.timer.get()[0] >= due:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((due,))
        self.handle.registerTimer(due)

    def _finish(self, at: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        self.seen.clear()
        self.done.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = sorted((g, v) for g, v in self.seen.get())
        found = self._first(key[0], [(g, v) for g, v in held if v == v])
        self.timer.clear()
        self.seen.clear()
        self.done.update((-1,))
        yield self._row("onset" if found else "not_crossed", key, found, len(held))

    def close(self) -> None:
        pass


def onsets(stream: DataFrame, chain: str, time: str, metrics: dict[str, tuple[float, str]], delay: str = "1 hour", patience: str = "1 day") -> DataFrame:
    """(``kind``, ``metric``, ``chain``, ``onset_generation``, ``step_size``, ``n_rows``), one row per metric and chain.

    ``stream`` has ``metric``, the column ``chain``, ``generation``, ``value``
    and an event time.  An onset comes as soon as all generations up to it are
    known, otherwise when the watermark is ``patience`` past the chain's last
    arrival: what is missing then is taken as missing, as the batch operator
    takes it.  Rows of a chain that is settled are counted as kind ``late``.
    Run it in ``keyed_state`` with output mode "update".
    """
    marked = stream.filter(F.col("metric").isin(*metrics)).withWatermark(time, delay)
    value = F.when(F.col("value").isNull(), F.lit(float("nan"))).otherwise(F.col("value").cast("double"))
    rows = marked.select("metric", F.col(chain).alias("chain"), F.col("generation").cast("bigint").alias("generation"), value.alias("value"), F.unix_millis(F.col(time)).alias("at"))
    schema = "kind string, metric string, chain string, onset_generation bigint, step_size double, n_rows bigint"
    return rows.groupBy("metric", "chain").transformWithStateInPandas(_Onset(metrics, int(pd.Timedelta(patience).total_seconds() * 1000)), schema, "Update", "EventTime")


def run(out: DataFrame, target: str, checkpoint: str) -> None:
    """Append what a keyed operator emits to ``target`` until all that has arrived is read."""
    with keyed_state(out.sparkSession):
        # a batch has a folder of its own, so one that runs again replaces what it wrote
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        query = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
