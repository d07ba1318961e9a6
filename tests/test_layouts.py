from pyspark.sql import functions as F

from millrace.plans import registry, relational
from millrace.session import table
from millrace.sources.layouts import overwrite_partitions, partitioned

SMALL = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_buckets_join_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = relational.in_buckets(spark, SMALL)
        plan = _plan(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == table(spark, SMALL, "lineitem").join(table(spark, SMALL, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed")]


def test_partitions_are_pruned_by_the_other_side(spark):
    assert "dynamicpruning" in _plan(registry.queries()["p06_dynamic_pruning"](spark, SMALL)).lower()


def test_partitions_without_new_rows_stay(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, n int")
    folder = partitioned(old, "k")
    overwrite_partitions(spark.createDataFrame([("b", 20), ("d", 40)], "k string, n int"), folder, "k")
    assert sorted(map(tuple, spark.read.schema("n int, k string").parquet(folder).select("k", "n").collect()), key=repr) == [("a", 1), ("b", 20), ("c", 3), ("d", 40), (None, 4)]
