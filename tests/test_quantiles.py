import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles
from millrace.operators.quantiles import exact_percentile


def _expected(values, share):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    place = (len(values) - 1) * share
    low, high = values[int(place)], values[min(len(values) - 1, int(place) + (place > int(place)))]
    return low + (high - low) * (place - int(place))


def _groups(seed):
    """Groups of 1 to 200 rows, with few or many ties, nulls, a null key and a group without values."""
    rng = random.Random(seed)
    made = {f"g{n}": [rng.choice([None, rng.randrange(rng.choice([2, 5, 1000])) / 4]) if rng.random() < 0.3 else rng.gauss(0, 50) for _ in range(n)] for n in range(1, 201)}
    return made | {None: [rng.random() for _ in range(10_000)], "nothing": [None] * 3, "one": [7.0] * 500, "two": [1.0] * 300 + [2.0] * 100}


@pytest.mark.parametrize("share, ranked", [(0.25, 100_000), (0.5, 40), (0.0, 3), (1.0, 3), (0.37, 1)])
def test_percentiles_of_every_group_size(spark, share, ranked, monkeypatch):
    monkeypatch.setattr(quantiles, "SPLITS", 7)
    groups = _groups(3)
    rows = [(k, v) for k, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r.percentile for r in exact_percentile(frame, ["k"], "v", share, ranked).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        want = _expected(values, share)
        assert got[k] == want if want is None else got[k] == pytest.approx(want, abs=1e-9), k


def test_it_equals_the_exact_aggregate_for_two_keys_and_no_key(spark):
    frame = spark.range(20_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2 == 0).alias("b"), (F.xxhash64("id") % 997).cast("double").alias("x"))
    want = {(r.a, r.b): r.p for r in frame.groupBy("a", "b").agg(F.percentile("x", 0.9).alias("p")).collect()}
    assert {(r.a, r.b): r.percentile for r in exact_percentile(frame, ["a", "b"], "x", 0.9, 500).collect()} == pytest.approx(want)
    whole = exact_percentile(frame, [], "x", 0.9, 500).collect()
    assert [r.percentile for r in whole] == [pytest.approx(frame.agg(F.percentile("x", 0.9)).first()[0])]
    assert exact_percentile(frame.where("false"), ["a"], "x", 0.5).count() == 0


def test_a_hot_group_takes_one_round_and_its_rows_stay_where_they_are(spark, monkeypatch):
    rounds = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *given: rounds.append(1) or narrowed(*given))
    frame = spark.range(300_000).select((F.col("id") % 2 == 0).alias("k"), F.xxhash64("id").cast("double").alias("x"))
    want = {r.k: r.p for r in frame.groupBy("k").agg(F.percentile("x", 0.25).alias("p")).collect()}
    found = exact_percentile(frame, ["k"], "x", 0.25, 1_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.percentile for r in found.collect()} == pytest.approx(want) and len(rounds) == 1
    assert "SortMergeJoin" not in plan.split("Window")[-1] and "BroadcastHashJoin" in plan
    monkeypatch.setattr(quantiles, "SENT_RANGES", 0)
    assert {r.k: r.percentile for r in exact_percentile(frame, ["k"], "x", 0.25, 1_000).collect()} == pytest.approx(want)
