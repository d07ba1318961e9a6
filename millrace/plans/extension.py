"""User-defined functions of every kind; fixture-derived."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table

#: Parts of a group whose partial results meet in one pandas frame.
SALTS = 64


@query("p80_scalar_udf", "SELECT n_nationkey, upper(n_name) || '!' AS shout FROM nation")
def scalar_udf(spark, sf_dir):
    shout = F.udf(lambda s: None if s is None else s.upper() + "!", "string", useArrow=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", shout("n_name").alias("shout"))


@query("p81_pandas_udf", "SELECT s_suppkey, round(s_acctbal * 1.19, 4) AS gross FROM supplier")
def vectorised_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def gross(balance: pd.Series) -> pd.Series:
        return balance * 1.19

    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(gross("s_acctbal"), 4).alias("gross"))


@query("p81_pandas_udaf", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey")
def grouped_udf(spark, sf_dir):
    """A mean by a pandas function, of the sums of at most SALTS parts of a nation's balances."""

    @F.pandas_udf("double")
    def mean(total: pd.Series, n: pd.Series) -> float:
        return float(total.sum() / n.sum()) if n.sum() else float("nan")

    customers = table(spark, sf_dir, "customer")
    salted = customers.groupBy("c_nationkey", F.pmod("c_custkey", F.lit(SALTS)).alias("salt"))
    parts = salted.agg(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)).alias("total"), F.count("c_acctbal").alias("n"))
    return parts.groupBy("c_nationkey").agg(F.round(mean("total", "n"), 4).alias("mean"))


@query("p82_udtf", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def table_function(spark, sf_dir):
    @F.udtf(returnType="word: string")
    class Words:
        def eval(self, text: str):
            for word in (text or "").split(" "):
                yield (word,)

    spark.udtf.register("millrace_words", Words)
    return spark.sql("SELECT p_partkey, word FROM {part}, LATERAL millrace_words(p_name)", part=table(spark, sf_dir, "part"))


@query(
    "p82_table_argument",
    """SELECT o_custkey AS group_key, o_orderkey AS row_key, o_totalprice AS value,
              round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS place
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
)
def table_argument(spark, sf_dir):
    """A running total by a table function over a partitioned and ordered table; it keeps two numbers of each partition."""
    from pyspark.sql.types import DoubleType, LongType, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    @F.udtf
    class Running:
        """The schema of the result follows the columns that are named."""

        def __init__(self):
            self.total, self.place = 0.0, 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, row: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
            kind = {f.name: f.dataType for f in rows.dataType.fields}
            schema = StructType().add("group_key", kind[key.value]).add("row_key", kind[row.value]).add("value", kind[value.value])
            return AnalyzeResult(schema.add("running", DoubleType()).add("place", LongType()))

        def eval(self, rows, key: str, row: str, value: str):
            self.total += rows[value] or 0.0
            self.place += 1
            yield rows[key], rows[row], rows[value], self.total, self.place

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    dealt = orders.asTable().partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Running(dealt, *map(F.lit, ("o_custkey", "o_orderkey", "o_totalprice"))).withColumn("running", F.round("running", 2))


@query(
    "p83_grouped_map",
    "SELECT event_id, max(value) OVER (PARTITION BY user_id) - value AS below FROM events",
)
def grouped_map(spark, sf_dir):
    """Each group's frame holds one row for each of at most SALTS parts of a user's events."""

    def largest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "most": [rows["most"].max()]})

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    parts = events.groupBy("user_id", F.pmod("event_id", F.lit(SALTS)).alias("salt")).agg(F.max("value").alias("most"))
    most = parts.groupBy("user_id").applyInPandas(largest, "user_id long, most double")
    return events.join(most, "user_id").select("event_id", (F.col("most") - F.col("value")).alias("below"))


@query(
    "p83_map_in_pandas",
    "SELECT event_id, value * 2 AS doubled FROM events WHERE value > 10",
)
def map_in_pandas(spark, sf_dir):
    def double(frames):
        for rows in frames:
            kept = rows[rows["value"] > 10]
            yield pd.DataFrame({"event_id": kept["event_id"], "doubled": kept["value"] * 2})

    return table(spark, sf_dir, "events").select("event_id", "value").mapInPandas(double, "event_id long, doubled double")


@query(
    "p83_cogroup",
    """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
              (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation
       WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""",
)
def cogroup(spark, sf_dir):
    """Counts of at most SALTS parts of a nation meet in its frames."""

    def count(key: tuple, customers: pd.DataFrame, suppliers: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": [key[0]], "customers": [int(customers["n"].sum())], "suppliers": [int(suppliers["n"].sum())]})

    def parts(name, nation, key):
        salt = F.pmod(key, F.lit(SALTS)).alias("salt")
        return table(spark, sf_dir, name).groupBy(nation, salt).agg(F.count("*").alias("n")).groupBy(nation)

    left, right = parts("customer", "c_nationkey", "c_custkey"), parts("supplier", "s_nationkey", "s_suppkey")
    return left.cogroup(right).applyInPandas(count, "n_nationkey int, customers long, suppliers long")
