import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.plans.streams import _rocks_db, hourly
from millrace.session import shared_dir
from millrace.streaming.runs import arriving, drained, dropped_late, run_to_end
from millrace.streaming.timers import folded, merged, timed_sessions
from millrace.streaming.upserts import UpsertSink


def _at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_rows_late_by_two_batches_are_dropped_and_counted(spark, tmp_path):
    """Batches of single files; the watermark by which batch n drops is that after batch n - 2."""
    batches = [[5, 10], [7200, 7300], [20, 7400], [30, 3590, 7500, 20_000], [7600, 40], [7700, 21_000]]
    rows = [(b, _at(s), "click") for b, times in enumerate(batches) for s in times]
    frame = spark.createDataFrame(rows, "b int, ts timestamp, event_type string")
    kept, dropped, marks = {}, 0, []
    for b, times in enumerate(batches):
        mark = marks[b - 2] if b >= 2 else float("-inf")
        hours = [s // 3600 for s in times]
        kept_hours = [h for h in hours if (h + 1) * 3600 > mark]
        dropped += len(set(hours) - set(kept_hours))  # one row of a window a task, as sums come first
        for h in kept_hours:
            kept[h] = kept.get(h, 0) + 1
        marks.append(max([s for t in batches[: b + 1] for s in t]) - 600)
    stream = arriving(frame, F.col("b"), len(batches)).select("ts", "event_type")
    written = []
    query = run_to_end(hourly(stream), "append", lambda batch, n: written.extend(batch.collect()), str(tmp_path / "q"))
    got = {int((r.start - dt.datetime(2024, 1, 1)).total_seconds()) // 3600: r.n for r in written}
    assert got == {h: n for h, n in kept.items() if (h + 1) * 3600 <= marks[-1]}
    assert dropped_late(query) == dropped > 0


@pytest.mark.parametrize("seed", range(20))
def test_sessions_merge_in_any_order(seed):
    rng = random.Random(seed)
    times = [rng.randrange(3_000) for _ in range(80)]
    whole = merged([(t, t, 1) for t in times], 40)
    parts = []
    for t in rng.sample(times, len(times)):
        parts = merged(parts + [(t, t, 1)], 40)
    assert parts == whole and sum(n for _, _, n in whole) == 80
    assert all(b[0] - a[1] >= 40 for a, b in zip(whole, whole[1:]))


@pytest.mark.parametrize("seed", range(10))
def test_sessions_of_many_keys_fold_as_those_of_each(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, "9007199254740993"]), t, t + rng.choice([0, 0, 70]), rng.randrange(1, 4)) for t in (rng.randrange(3_000) for _ in range(rng.choice([0, 1, 90])))]
    got = folded(pd.DataFrame(rows, columns=["key", "first", "last", "n"]).astype({"key": object, "first": "int64", "last": "int64", "n": "int64"}), 40)
    want = [(k, *s) for k in {r[0] for r in rows} for s in merged([r[1:] for r in rows if r[0] == k], 40)]
    assert sorted(got.itertuples(index=False, name=None), key=repr) == sorted(want, key=repr)


def test_keys_share_slots_and_timers(spark):
    """Fewer groups than keys; null and large keys; what the last watermark has not passed stays open."""
    times = {2**53 + 1: [0, 30, 500, 5_000, 9_990], 7: [10, 9_000, 9_020], None: [20, 25, 8_000], **{k: [k] for k in range(100, 180)}}
    rows = [(k, _at(s)) for k, own in times.items() for s in own]
    frame = spark.createDataFrame(rows, "k long, ts timestamp")
    stream = arriving(frame, (F.col("ts") >= F.lit(_at(6_000))).cast("int"), 2).withWatermark("ts", "10 seconds")
    with _rocks_db(spark):
        closed = drained(timed_sessions(stream.withColumn("micros", F.unix_micros("ts")), "k", 60))
    start = int(_at(0).timestamp() * 1e6)
    want = [(k, a, b, n) for k, own in times.items() for a, b, n in merged([(s, s, 1) for s in own], 60) if b + 60 <= 9_980]
    got = [(r["key"], (r["first"] - start) // 10**6, (r["last"] - start) // 10**6, r["n"]) for r in closed.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_replayed_batch_leaves_one_row_per_key(spark):
    sink = UpsertSink(f"{shared_dir(spark)}/upserts-{random.random()}", ("k",))
    make = lambda rows: spark.createDataFrame(rows, "k string, n long")
    sink.write(make([("a", 1), ("b", 1), (None, 1)]), 0)
    sink.write(make([("a", 2)]), 1)
    sink.write(make([("a", 2), ("c", 5)]), 1)  # the same batch once more, after a failure
    want = [("a", 2), ("b", 1), ("c", 5), (None, 1)]
    schema = make([]).schema
    read = lambda s: sorted(map(tuple, s.current(spark, schema).collect()), key=repr)
    assert read(sink) == sorted(want, key=repr)
    less = sink.compacted(spark, schema, f"{sink.folder}-compact")
    less.write(make([("b", 9)]), 2)
    assert read(less) == sorted([("a", 2), ("b", 9), ("c", 5), (None, 1)], key=repr)


def test_an_empty_arrival_is_refused(spark):
    with pytest.raises(ValueError):
        arriving(spark.createDataFrame([(0,), (2,)], "b int"), F.col("b"), 3)
