"""Windows over hot keys against Spark's own windows: one user holds a third of the events."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import slices
from millrace.operators.sessions import sessions

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1_500):
        user = rng.choice(["hot", "hot", None, "a", "b", f"u{rng.randrange(40)}"])
        burst = rng.random() < 0.4
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(600) if burst else rng.randrange(600_000))
        rows.append((i, user, None if rng.random() < 0.01 else at, rng.choice([None, rng.randrange(100)])))
    return spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, v long").repartition(5).cache()


def _same(got, want):
    columns = sorted(want.columns)
    read = lambda df: sorted(tuple(repr(r[c]) for c in columns) for r in df.select(columns).collect())
    assert read(got) == read(want)


def test_slices_rise_with_time_and_stay_small(events):
    cut, n = slices.sliced(events, "k", "t", 50)
    largest = cut.groupBy("k", "slice").count().agg(F.max("count")).first()[0]
    assert n > 10 and largest <= 75  # about the slice's rows, however bursty the key
    over = Window.partitionBy("k").orderBy(*ORDER)
    assert cut.withColumn("before", F.lag("slice").over(over)).where("before > slice").count() == 0
    assert slices.sliced(events, "k", "t")[1] == 1
    assert cut.drop("slice").columns == events.columns


@pytest.mark.parametrize("rows_per_slice", [40, 10_000])
def test_running_totals(events, rows_per_slice):
    w = Window.partitionBy("k").orderBy(*ORDER)
    totals = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))}
    want = events.select("*", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.min("v").over(w).alias("l"))
    _same(slices.running(events, "k", ORDER, totals, rows_per_slice), want)


@pytest.mark.parametrize("rows_per_slice", [7, 40, 10_000])
def test_rows_frames_and_offsets(events, rows_per_slice):
    w = Window.partitionBy("k").orderBy(*ORDER)
    columns = {
        "moving": lambda w: F.sum("v").over(w.rowsBetween(-3, 0)),
        "around": lambda w: F.count("*").over(w.rowsBetween(-2, 5)),
        "lag": lambda w: F.lag("v", 4).over(w),
        "lead": lambda w: F.lead("id", 5).over(w),
    }
    want = events.select("*", *[c(w).alias(name) for name, c in columns.items()])
    _same(slices.framed(events, "k", ORDER, 4, 5, columns, rows_per_slice), want)


@pytest.mark.parametrize("rows_per_slice", [40, 10_000])
def test_ends(events, rows_per_slice):
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = events.select("*", F.slice(F.collect_list("id").over(w), 1, 3).alias("firsts"), F.last("id").over(w).alias("last"))
    _same(slices.ends(events, "k", ORDER, "id", 3, rows_per_slice), want)


@pytest.mark.parametrize("rows_per_slice", [40, 10_000])
def test_range_totals(events, rows_per_slice):
    timed = events.where("t IS NOT NULL")
    w = Window.partitionBy("k").orderBy(F.unix_micros(F.col("t").cast("timestamp"))).rangeBetween(-300_000_000, 0)
    _same(slices.range_total(timed, "k", "t", "id", 300, None, rows_per_slice), timed.select("id", F.count("*").over(w).alias("total")))
    summed = F.coalesce(F.sum("v").over(w), F.lit(0))
    _same(slices.range_total(timed, "k", "t", "id", 300, F.col("v"), rows_per_slice), timed.select("id", summed.alias("total")))


@pytest.mark.parametrize("rows_per_slice", [11, 40, 10_000])
def test_sessions(events, rows_per_slice):
    w = Window.partitionBy("k").orderBy("t")
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    starts = events.withColumn("starts", F.coalesce((micros - F.lag(micros).over(w) >= 60_000_000).cast("int"), F.lit(1)))
    numbered = starts.withColumn("session", F.sum("starts").over(w))
    want = numbered.groupBy("k", "session").agg(F.min("t").alias("session_start"), F.max("t").alias("session_end"), F.count("*").alias("n")).drop("session")
    _same(sessions(events, "k", "t", 60, rows_per_slice), want)


def test_no_task_holds_the_hot_key(events):
    """Rows of the largest group that any window sees, beside those of an even deal."""
    cut, n = slices.sliced(events, "k", "t", 30)
    sizes = sorted(r["count"] for r in cut.where("k = 'hot'").groupBy("slice").count().collect())
    assert len(sizes) > 10 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_empty_tables(events):
    nothing = events.where("false")
    assert slices.running(nothing, "k", ORDER, {"n": ("count", F.lit(1))}).count() == 0
    assert sessions(nothing, "k", "t", 60).count() == slices.range_total(nothing, "k", "t", "id", 60).count() == 0
