"""Sketches, samples and fixpoints against exact figures."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators.fixpoint import reachable
from millrace.operators.sampling import stratified
from millrace.operators.sketches import count_min, merged_counts, point_estimates
from millrace.plans import analytic, registry
from millrace.session import table

SF = "/root/testdata/sf0.1"


def test_merged_count_min_equals_one_of_all_rows_and_keeps_its_bound(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice(["hot", f"w{int(rng.paretovariate(0.7))}"])) for _ in range(20_000)] + [(1, None)] * 5
    frame = spark.createDataFrame(rows, "part int, word string").repartition(4)
    error, confidence = 0.002, 0.99
    parts = count_min(frame, "word", ["part"], error, confidence)
    whole = count_min(frame, "word", [], error, confidence)
    assert sorted(map(tuple, merged_counts(parts, []).select("row", "slot", "n").collect())) == sorted(map(tuple, whole.select("row", "slot", "n").collect()))
    got = {r.word: r.estimate for r in point_estimates(merged_counts(parts, []), frame, "word", [], error, confidence).collect()}
    exact = Counter(w for _, w in rows if w is not None)
    assert got.keys() == exact.keys() and all(got[w] >= n for w, n in exact.items())
    assert sum(got[w] > n + error * 20_000 for w, n in exact.items()) <= (1 - confidence) * len(exact) * 3
    by_part = {(r.part, r.word): r.estimate for r in point_estimates(parts, frame, "word", ["part"], error, confidence).collect()}
    assert all(by_part[k] >= n for k, n in Counter(r for r in rows if r[1]).items())
    unseen = spark.createDataFrame([("never seen",)], "word string")
    assert point_estimates(whole, unseen, "word", [], error, confidence).first().estimate <= error * 20_000


def test_count_min_of_all_parts(spark):
    got = {r.l_partkey: r.estimate for r in registry.queries()["p38_count_min"](spark, SF).collect()}
    lines = table(spark, SF, "lineitem")
    exact = {r.l_partkey: r["count"] for r in lines.groupBy("l_partkey").count().collect()}
    n, (error, confidence) = sum(exact.values()), analytic.COUNT_MIN
    assert got.keys() == exact.keys() and all(got[k] >= c for k, c in exact.items())
    assert sum(got[k] > c + error * n for k, c in exact.items()) <= (1 - confidence) * len(exact)


def test_theta_sketches_beyond_their_size(spark):
    """20,000 parts, five times what a sketch holds: all figures within 5 % of the larger set."""
    lines = table(spark, SF, "lineitem").select(F.year("l_shipdate").alias("year"), "l_partkey").distinct()
    parts = {}
    for r in lines.collect():
        parts.setdefault(r.year, set()).add(r.l_partkey)
    rows = registry.queries()["p38_theta_by_year"](spark, SF).collect()
    assert len(rows) == len(parts) - 1
    for r in rows:
        a, b = parts[r.year], parts[r.year + 1]
        for got, want in ((r.parts, len(a)), (r.in_both, len(a & b)), (r.gone, len(a - b)), (r.in_either, len(a | b))):
            assert abs(got - want) <= 0.05 * len(a | b)


def _by_sql(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet{'' if sf_dir == SF else '/*.parquet'}'")
    names = "year, parts, in_both, gone, in_either"
    return con.execute(f"SELECT {names} FROM ({registry.oracle_sql()['p38_theta_by_year']}) ORDER BY year").fetchall()


def test_theta_sketches_equal_their_sql_beyond_the_size_of_one(spark, tmp_path):
    """20,000 parts; then many more, with missing parts and dates, and a gap between years."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("l_partkey"),
        F.when(F.col("id") % 89 > 0, F.make_timestamp_ntz(F.array(*map(F.lit, (1992, 1993, 1995, 1996, 1997)))[(F.col("id") % 5).cast("int")], *map(F.lit, (2, 3, 4, 5, 6)))).alias("l_shipdate"),
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    for sf in (SF, str(tmp_path)):
        got = registry.queries()["p38_theta_by_year"](spark, sf)
        want = _by_sql(sf)
        assert [tuple(r) for r in got.select("year", "parts", "in_both", "gone", "in_either").orderBy("year").collect()] == want and len(want) >= 3


def test_combined_top_words_are_near_the_exact_ones(spark):
    """A count is off by at most the rows over the tracked words, from each of two levels of sketches."""
    sf = "/root/testdata/sf0.01"
    words = {}
    for r in table(spark, sf, "documents").select("lang", "text").collect():
        words.setdefault(r.lang, Counter()).update(r.text.lower().split())
    rows = registry.queries()["p38_top_words"](spark, sf).collect()
    for lang, exact in words.items():
        got = {r.word: r.n for r in rows if r.lang == lang}
        off = 4 * sum(exact.values()) / analytic.TOP_TRACKED
        assert len(got) == 20 and all(abs(n - exact[w]) <= off for w, n in got.items())
        last = sorted(exact.values(), reverse=True)[19]
        assert all(exact[w] >= last - 2 * off for w in got)


def test_stratified_samples_do_not_depend_on_partitions(spark):
    rows = [(["a", "b", None][i % 3] if i % 5 else "hot", i % 1_700, i) for i in range(4_000)] + [("few", 1, 1), ("few", None, 2)]
    frame = spark.createDataFrame(rows, "s string, id int, x int")
    want = {}
    for s, i, x in rows:
        text = "5|" + ("-" if i is None else f"={i}")
        want.setdefault(s, []).append((hashlib.md5(text.encode()).hexdigest(), -1 if i is None else i, x))
    want = sorted(((s, i, x) for s, own in want.items() for _, i, x in sorted(own)[:30]), key=repr)
    for n in (1, 50):
        got = stratified(frame.repartition(n), ["s"], 30, ["id"], 5).fillna(-1, ["id"]).collect()
        assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("most", [None, 3])
def test_reachable_equals_breadth_first_search(spark, most):
    rng = random.Random(8)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(None, 1), (2, None), (0, 0)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    starts = [0, 7, 200, None, 7, 999]
    steps = {s: 0 for s in starts if s is not None}
    line = list(steps)
    while line:
        node = line.pop(0)
        for a, b in edges:
            if a == node and b is not None and b not in steps and (most is None or steps[node] < most):
                steps[b] = steps[node] + 1
                line.append(b)
    a = spark.createDataFrame(edges, "a int, b int")
    got = reachable(a, spark.createDataFrame([(s,) for s in starts], "node int"), most)
    assert sorted(map(tuple, got.collect())) == sorted(steps.items())
    assert reachable(a, spark.createDataFrame([], "node int")).count() == 0
