"""Arrivals in disorder: memberships, window rates with late records, onsets as soon as they are certain."""

import pytest
from pyspark.sql import functions as F

from tabaudit.operators import novelty
from tabaudit.streaming import membership, stateful

HOUR = 3_600_000


class Arrivals:
    """A folder of files and what a streaming operator has made of them so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def send(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, build):
        stateful.run(build(self.stream().withColumn("ts", F.timestamp_millis("ms"))), f"{self.path}/out", f"{self.path}/state")

    def results(self, *columns):
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/out").select(*columns).collect())


def test_windows_close_once_and_late_records_are_counted_apart(spark, tmp_path):
    box = Arrivals(spark, str(tmp_path), "generator string, ms bigint, flag boolean")
    build = lambda s: stateful.window_rates(s, "generator", "ts", "flag", "1 hour", "2 hours")
    box.send([("a", 10, True), ("a", HOUR + 5, None), ("b", 20, False), (None, 30, True)])
    box.send([("a", 40, False)])  # out of order, within the delay
    box.run(build)
    box.send([("a", 5 * HOUR, True)])
    box.run(build)
    closed = [("", 0, 1, 1), ("a", 0, 2, 1), ("a", HOUR, 1, 0), ("b", 0, 1, 0)]
    assert box.results("kind", "key", "window_start", "n_rows", "n_flagged") == [("closed", *c) for c in closed]
    box.send([("a", 50, True), ("a", 60, True), ("c", 70, False), ("b", 4 * HOUR, True)])  # two windows are gone
    box.send([("a", 9 * HOUR, False)])
    box.run(build)
    found = box.results("kind", "key", "window_start", "n_rows", "n_flagged")
    assert [r[1:] for r in found if r[0] == "late"] == [("a", 0, 2, 2), ("c", 0, 1, 0)]
    assert [r[1:] for r in found if r[0] == "closed"] == sorted(closed + [("a", 5 * HOUR, 1, 1), ("b", 4 * HOUR, 1, 1)])


def test_an_onset_comes_once_and_as_soon_as_it_is_certain(spark, tmp_path):
    box = Arrivals(spark, str(tmp_path), "metric string, chain string, generation int, value double, ms bigint")
    metrics = {"rate": (0.05, "increase"), "share": (0.1, "decrease")}
    build = lambda s: stateful.onsets(s, "chain", "ts", metrics, "1 minute", "1 day")
    columns = ("kind", "metric", "chain", "onset_generation", "step_size")
    # generation 2 crosses, but 1 is not known yet
    box.send([("rate", "x", 0, 0.0, 1), ("rate", "x", 2, 0.5, 2), ("share", "y", 0, 1.0, 3), ("share", "y", 1, None, 4), ("share", "y", 3, 0.5, 4), ("other", "x", 0, 1.0, 5)])
    box.run(build)
    assert not box.results(*columns)
    box.send([("rate", "x", 1, 0.02, 10), ("share", "y", 2, 0.75, 11)])
    box.run(build)
    # a missing value is known to be missing: the step of y goes over it
    assert box.results(*columns) == [("onset", "rate", "x", 2, 0.48), ("onset", "share", "y", 2, -0.25)]
    box.send([("rate", "x", 3, 0.9, 12), ("rate", "z", 0, 0.0, 13), ("rate", "z", 4, 0.2, 14), ("rate", "flat", 0, 0.0, 15)])
    box.send([("rate", "end", 0, 0.0, 30 * 24 * HOUR)])
    box.run(build)
    found = box.spark.read.parquet(f"{box.path}/out").collect()
    got = {(r["kind"], r["metric"], r["chain"], r["onset_generation"], r["n_rows"]) for r in found}
    # what never came is missing, as in a batch; z crosses over the gap
    assert got == {("onset", "rate", "x", 2, 3), ("onset", "share", "y", 2, 4), ("late", "rate", "x", None, 1), ("onset", "rate", "z", 4, 2), ("not_crossed", "rate", "flat", None, 1)}
    assert len(found) == 5


@pytest.mark.parametrize("broadcast", [True, False])
def test_membership_is_the_batch_result_whatever_the_order(spark, tmp_path, broadcast):
    schema = "folder string, generation int, ID bigint, n double, c string"
    box = Arrivals(spark, str(tmp_path), schema)
    population = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(20)], "n double, c string")
    training = spark.createDataFrame([("f1", 3.0, "b"), ("f2", 100.0, "a")], "folder string, n double, c string")
    pop = novelty.Population.learn(population, ["n"], ["c"])
    rows = {(f, g): [(f, g, i, float((7 * i + g) % 30), "abc"[(i + g) % 3]) for i in range(15)] for f in ("f1", "f2") for g in (0, 1, 2)}
    rows["f2", 2] = [("f2", 2, 1, 100.0, "a")]
    for key in (("f1", 2), ("f2", 0), ("f1", 0)):
        box.send(rows[key])

    def arrive():
        membership.flag_arrivals(box.stream(), pop, training, ["folder"], f"{tmp_path}/flags", f"{tmp_path}/cp", resolutions=[5, 10], broadcast=broadcast)

    arrive()
    box.send(rows["f2", 0])  # once more
    for key in (("f2", 2), ("f1", 1), ("f2", 1)):
        box.send(rows[key])
    arrive()
    arrive()
    whole = spark.createDataFrame([r for part in rows.values() for r in part], schema)
    want = membership.membership_flags(whole, pop, training, ["folder"], ["folder", "generation", "ID"], [5, 10])
    key = ["folder", "generation", "ID", "metric"]
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/flags").select(*key).collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.select(*key).collect())
    assert {m for *_, m in got} == {"HR_b5", "HR_b10", "Copy"} and ("f2", 2, 1, "Copy") in got


def test_membership_of_a_file_that_comes_in_parts_is_whole(spark, tmp_path):
    box = Arrivals(spark, str(tmp_path), "folder string, generation int, ID bigint, n double, c string")
    pop = novelty.Population.learn(spark.createDataFrame([(0.0, "a"), (9.0, "a")], "n double, c string"), ["n"], ["c"])
    training = spark.createDataFrame([("7", 3.0, "b")], "folder string, n double, c string")
    box.send([("7", 0, 1, 0.0, "z"), ("7", 0, 2, 0.0, "a")])
    box.send([("7", 0, 3, 3.0, "b"), ("8", 0, 1, 0.0, "z")])  # the rest of the first file, in another batch
    box.send([("7", 0, 1, 0.0, "a"), ("7", 0, 4, 0.0, "y")])  # record 1 once more, no longer novel
    membership.flag_arrivals(box.stream(), pop, training, ["folder"], f"{tmp_path}/flags", f"{tmp_path}/cp", resolutions=[5])
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/flags").selectExpr("CAST(folder AS STRING)", "ID", "metric").collect())
    assert got == [("7", 3, "Copy"), ("7", 3, "HR_b5"), ("7", 4, "HR_b5"), ("8", 1, "HR_b5")]
