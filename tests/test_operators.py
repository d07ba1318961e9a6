import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.elapsed import elapsed
from millrace.operators.joins import asof_join, range_join
from millrace.operators.sessions import sessions


@pytest.mark.parametrize("seconds, shown", [(0, "00:00"), (59, "00:59"), (60, "01:00"), (3599, "59:59"), (6000, "100:00"), (None, None)])
def test_elapsed(spark, seconds, shown):
    frame = spark.createDataFrame([(seconds,)], "s long")
    assert frame.select(elapsed(F.col("s")).alias("t")).first().t == shown


def _at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("seed, rows_per_slice", [(0, 1_000_000), (1, 20), (2, 5)])
def test_asof_equals_brute_force(spark, seed, rows_per_slice):
    rng = random.Random(seed)
    left = [(i, rng.choice("aab"), _at(rng.randrange(400_000) if i % 3 else rng.randrange(300))) for i in range(120)] + [(199, None, _at(5)), (200, "a", None)]
    right = [(rng.choice("ab"), _at(t), t) for t in rng.sample(range(400_000), 40) + rng.sample(range(300), 30)] + [(None, _at(0), 1), ("a", None, 2)]
    expected = {i: max((t for r, s, t in right if r == k and None not in (k, s, at) and s <= at), default=None) for i, k, at in left}
    a = spark.createDataFrame(left, "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame(right, "k string, t timestamp_ntz, v long")
    got = {r.i: r.asof_v for r in asof_join(a, b, "k", "t", ["v"], rows_per_slice).collect()}
    assert got == expected


def test_range_join_equals_brute_force(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-50, 50)) for i in range(80)] + [(999, None)]
    ranges = [(j, lo, lo + rng.uniform(0, 30)) for j, lo in enumerate([rng.uniform(-60, 50) for _ in range(30)])] + [(77, 5.0, 1.0), (78, None, 2.0)]
    expected = sorted((i, j) for i, x in points for j, lo, hi in ranges if None not in (x, lo) and lo <= x <= hi)
    a = spark.createDataFrame(points, "i int, x double")
    b = spark.createDataFrame(ranges, "j int, lo double, hi double")
    got = range_join(a, b, "x", "lo", "hi").select("i", "j").collect()
    assert sorted(map(tuple, got)) == expected


def _pairs(points, ranges):
    return sorted((i, j) for i, x in points for j, lo, hi in ranges if None not in (x, lo, hi) and x == x and lo <= x <= hi)


@pytest.mark.parametrize("step", [1, 2, 5])
def test_range_join_of_ranges_of_all_lengths(spark, step):
    """A range of 1e12 beside ranges of 1 and points of all sizes, infinite bounds, ties and one point alone."""
    rng = random.Random(step)
    points = [(i, rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 12)) for i in range(300)] + [(k, 5.0) for k in range(300, 340)]
    points += [(400, None), (401, float("nan")), (402, 0.0), (403, float("inf"))]
    ranges = [(j, lo, lo + 10 ** rng.uniform(-4, 12)) for j, lo in enumerate(rng.choice([x for _, x in points[:340]]) for _ in range(120))]
    ranges += [(500, 0.0, 1e12), (501, 4.0, 5.0), (502, 5.0, 5.0), (503, 6.0, 5.0), (504, float("-inf"), 0.0), (505, 1e11, float("inf")), (506, None, 1.0), (507, 2e12, 3e12)]
    a, b = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "j int, lo double, hi double")
    joined = range_join(a, b, "x", "lo", "hi", step)
    assert joined.columns == ["i", "x", "j", "lo", "hi"]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, joined.select("i", "j").collect())) == _pairs(points, ranges)
    for same in ([(1, 5.0)], []):
        few = range_join(spark.createDataFrame(same, "i int, x double"), b, "x", "lo", "hi", step)
        assert sorted(map(tuple, few.select("i", "j").collect())) == _pairs(same, ranges)
    assert range_join(a, b.where("false"), "x", "lo", "hi").count() == 0


def test_range_join_checks_little_more_than_it_finds(spark):
    points = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    ranges = spark.range(200).select((F.col("id") * 97).cast("double").alias("lo"), (F.col("id") * 97 + 5 * F.col("id")).cast("double").alias("hi"))
    joined = range_join(points, ranges, "x", "lo", "hi")
    found = joined.count()
    cells = [r for r in ranges.select((F.col("hi") - F.col("lo") + 1).alias("n")).collect()]
    assert found <= sum(r.n for r in cells)


def test_range_join_of_times_and_whole_numbers(spark):
    rows = spark.createDataFrame([(i, _at(i * 60), i) for i in range(100)], "i int, t timestamp_ntz, n long")
    spans = spark.createDataFrame([(0, _at(0), _at(59), 0, 2**62), (1, _at(60), _at(600), 98, 98), (2, _at(-5), _at(10_000), 5, 4)], "j int, lo timestamp_ntz, hi timestamp_ntz, a long, b long")
    assert sorted(map(tuple, range_join(rows, spans, "t", "lo", "hi").groupBy("j").count().collect())) == [(0, 1), (1, 10), (2, 100)]
    assert sorted(map(tuple, range_join(rows, spans, "n", "a", "b").groupBy("j").count().collect())) == [(0, 100), (1, 1)]


def test_session_gap_of_exactly_the_limit_opens_a_new_session(spark):
    rows = spark.createDataFrame([("u", _at(s)) for s in (0, 10, 70, 131)], "k string, t timestamp_ntz")
    assert sorted(r.n for r in sessions(rows, "k", "t", 60).collect()) == [1, 1, 2]


def test_joins_part_the_left_side(spark):
    a = spark.range(100).withColumn("k", F.col("id") % 7)
    b = spark.createDataFrame([(1,), (3,), (3,)], "k long")
    semi, anti = a.join(b, "k", "left_semi").count(), a.join(b, "k", "left_anti").count()
    assert semi + anti == 100 and semi == a.where("k in (1, 3)").count()


def test_late_row_is_dropped(spark, tmp_path):
    schema = "id int, ts timestamp"
    for n, clock in enumerate(["00:05", "05:00", "05:01", "00:06", "09:00"]):
        row = [(n, dt.datetime.fromisoformat(f"2024-01-01 {clock}:00"))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    import os
    import shutil
    import time

    os.makedirs(tmp_path / "flat")
    for n in range(5):
        part = next((tmp_path / f"in/{n}").glob("*.parquet"))
        shutil.copy(part, tmp_path / f"flat/{n}.parquet")
        os.utime(tmp_path / f"flat/{n}.parquet", (time.time() + n - 10,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    counted = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    from millrace.streaming.runs import drained

    got = {(r.window.start.hour, r.n) for r in drained(counted).collect()}
    assert got == {(0, 1), (5, 2)}


def test_custom_state_counts_per_user(spark, tmp_path):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from millrace.streaming.runs import ROCKS_DB, drained

    class Count(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "n long")

        def handleInputRows(self, key, rows, timers):
            n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(r) for r in rows)
            self.seen.update((n,))
            yield pd.DataFrame({"user": [key[0]], "n": [n]})

        def close(self):
            pass

    spark.createDataFrame([("a",), ("a",), ("b",)], "user string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    try:
        stream = spark.readStream.schema("user string").parquet(str(tmp_path / "in"))
        counts = stream.groupBy("user").transformWithStateInPandas(Count(), "user string, n long", "Update", "None")
        assert sorted(map(tuple, drained(counts, "update").collect())) == [("a", 2), ("b", 1)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
