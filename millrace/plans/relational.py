"""Scans, projections, filters, joins, subqueries and set operations over the fixture tables.

These are fixture-derived: the reference has no relational operators of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.fixpoint import reachable
from millrace.operators.joins import asof_join, range_join
from millrace.operators.sampling import stratified
from millrace.plans.registry import query, same_sql
from millrace.session import table
from millrace.sources.files import written_and_read
from millrace.sources.layouts import bucketed, overwrite_partitions, partitioned

_NTZ = "timestamp_ntz '{}'"


@query(
    "p30_forecast_revenue",
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
         AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def forecast_revenue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    year = (F.col("l_shipdate") >= F.expr(_NTZ.format("1996-01-01"))) & (F.col("l_shipdate") < F.expr(_NTZ.format("1997-01-01")))
    return li.where(year & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).agg(
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue")
    )


@query("p01_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("p01_scan_all", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def scan_all(spark, sf_dir):
    """The rows of every table."""
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES]
    return reduce(DataFrame.unionAll, counts)


@query(
    "p02_projection",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more FROM lineitem",
)
def projection(spark, sf_dir):
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", net, (F.col("l_quantity") + 1).alias("more"))


@query(
    "p03_predicates",
    r"""SELECT p_partkey, p_name, p_size FROM part
        WHERE (p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_name LIKE '%e%')
           OR (NOT p_size > 3 AND regexp_matches(p_type, '^[A-M]'))""",
)
def predicates(spark, sf_dir):
    c = F.col
    kept = (c("p_size").between(10, 30) & c("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & c("p_name").like("%e%")) | (
        ~(c("p_size") > 3) & c("p_type").rlike("^[A-M]")
    )
    return table(spark, sf_dir, "part").where(kept).select("p_partkey", "p_name", "p_size")


@query(
    "p04_nulls",
    """SELECT o_orderkey, coalesce(l_quantity, -1) AS quantity, l_quantity IS NULL AS missing,
              nullif(o_orderstatus, 'F') AS open_status, l_returnflag IS NOT DISTINCT FROM NULL AS no_flag
       FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey""",
)
def nulls(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    joined = table(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey",
        F.coalesce("l_quantity", F.lit(-1.0)).alias("quantity"),
        F.col("l_quantity").isNull().alias("missing"),
        F.nullif("o_orderstatus", F.lit("F")).alias("open_status"),
        F.col("l_returnflag").eqNullSafe(F.lit(None)).alias("no_flag"),
    )


@query(
    "p05_case",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band FROM orders",
)
def case(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high").alias("band"))


def _sink(name, format, **options):
    @query(name, "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders")
    def sink(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
        return written_and_read(rows, format, "o_orderstatus", **options)


_sink("p06_sink_parquet", "parquet")
_sink("p06_sink_csv", "csv", header=True)
_sink("p06_sink_json", "json")
_sink("p06_sink_orc", "orc")


@query("p06_bucketed_join", "SELECT o_custkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def bucketed_join(spark, sf_dir):
    """Orders and lines in as many buckets of their key: the join reads them as they lie."""
    return in_buckets(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("lines"))


def in_buckets(spark, sf_dir):
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 16)
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", 16)
    return orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


@query(
    "p06_dynamic_pruning",
    "SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%2%'",
)
def dynamic_pruning(spark, sf_dir):
    """Customers in folders by nation: only those of the nations that a filter on the other table leaves are read."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    stored = spark.read.schema(customers.schema).parquet(partitioned(customers, "c_nationkey"))
    nations = table(spark, sf_dir, "nation").where("n_name LIKE '%2%'")
    return stored.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_name")


@query(
    "p06_dynamic_overwrite",
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders",
)
def dynamic_overwrite(spark, sf_dir):
    """Orders in folders by status, of which one is replaced."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    folder = partitioned(orders, "o_orderstatus")
    overwrite_partitions(orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), folder, "o_orderstatus")
    return spark.read.schema(orders.schema).parquet(folder).select(orders.columns)


@query(
    "p07_stratified",
    """SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7|=' || o_orderkey), o_orderkey) <= 200""",
)
def stratified_sample(spark, sf_dir):
    """200 orders of each status, the same however the table is split."""
    return stratified(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], 200, ["o_orderkey"], 7)


@query("p07_sample")
def sample(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=7).select("l_orderkey", "l_linenumber")


def _joined(name, how, sql):
    @query(name, sql)
    def join(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
        lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select("l_orderkey", "l_partkey", "l_quantity")
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), how)


_SIDES = """(SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o {}
           (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 48) l ON o_orderkey = l_orderkey"""
_joined("p10_inner", "inner", "SELECT * FROM " + _SIDES.format("JOIN"))
_joined("p11_left", "left", "SELECT * FROM " + _SIDES.format("LEFT JOIN"))
_joined("p11_right", "right", "SELECT * FROM " + _SIDES.format("RIGHT JOIN"))
_joined("p11_full", "full", "SELECT * FROM " + _SIDES.format("FULL JOIN"))
_joined("p12_semi", "left_semi", "SELECT * FROM " + _SIDES.format("SEMI JOIN"))
_joined("p12_anti", "left_anti", "SELECT * FROM " + _SIDES.format("ANTI JOIN"))


@query("p13_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cross(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("a")).crossJoin(region.select(F.col("r_name").alias("b")))


@query(
    "p14_theta",
    "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
)
def theta(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


def _hinted(name, hint):
    @query(name, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    def hinted(spark, sf_dir):
        nation = table(spark, sf_dir, "nation").hint(hint)
        return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


for _hint in ("broadcast", "merge", "shuffle_hash"):
    _hinted(f"p15_hint_{_hint}", _hint)


@query(
    "p16_range",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_partkey FROM lineitem
       JOIN (SELECT p_partkey, p_retailprice * 10 AS lo, p_retailprice * 10 + 40 AS hi FROM part WHERE p_size <= 5) p
       ON l_extendedprice BETWEEN lo AND hi WHERE l_quantity < 5""",
)
def ranges(spark, sf_dir):
    price = F.col("p_retailprice") * 10
    parts = table(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey", price.alias("lo"), (price + 40).alias("hi"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return range_join(lines, parts, "l_extendedprice", "lo", "hi").drop("lo", "hi")


@query(
    "p17_asof",
    """SELECT p.event_id, c.event_id AS asof_event_id, round(c.value, 6) AS click_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    buys = events.where("event_type = 'purchase'").drop("event_type")
    clicks = events.where("event_type = 'click'").drop("event_type")
    found = asof_join(buys, clicks, "user_id", "ts", ["event_id", "value"])
    return found.select("event_id", "asof_event_id", F.round("asof_value", 6).alias("click_value"))


same_sql(
    "p18_lateral",
    """SELECT n_name, t.c_custkey, t.c_acctbal FROM {nation},
       LATERAL (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t""",
    "nation", "customer",
)


@query(
    "p19_star",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
       FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name""",
)
def star(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    small = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name", "n_nationkey")
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(F.broadcast(small), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
        .groupBy("r_name", "n_name")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))
    )


@query(
    "p20_self",
    """SELECT a.l_orderkey, count(*) AS pairs FROM lineitem a JOIN lineitem b
       ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_orderkey""",
)
def self_join(spark, sf_dir):
    """Pairs of an order's lines with unlike parts, counted without forming them: all pairs less those of equal parts."""
    parts = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    lines, alike = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    pairs = parts.where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(((lines * lines - alike) / 2).cast("long").alias("pairs"))
    return pairs.where("pairs > 0")


same_sql(
    "p21_scalar_subquery",
    """SELECT c_custkey, c_acctbal FROM {customer} AS c
       WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} AS i WHERE i.c_nationkey = c.c_nationkey)""",
    "customer",
)
same_sql(
    "p21_exists_in",
    """SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
       AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')""",
    "orders", "lineitem", "customer",
)


@query("p48_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


def _set_operation(name, method, word):
    @query(name, f"SELECT l_partkey % 50 AS k FROM lineitem WHERE l_quantity > 40 {word} SELECT p_size FROM part WHERE p_size > 10")
    def operation(spark, sf_dir):
        a = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select((F.col("l_partkey") % 50).alias("k"))
        b = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_size").cast("long").alias("k"))
        return getattr(a, method)(b)


for _name, _method, _word in (
    ("union", "union", "UNION ALL"), ("intersect", "intersect", "INTERSECT"), ("intersect_all", "intersectAll", "INTERSECT ALL"),
    ("except", "subtract", "EXCEPT"), ("except_all", "exceptAll", "EXCEPT ALL"),
):
    _set_operation(f"p49_{_name}", _method, _word)

@query(
    "p50_recursive",
    """WITH RECURSIVE bought AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49),
            e AS (SELECT 'c' || c AS a, 'p' || p AS b FROM bought UNION ALL SELECT 'p' || p, 'c' || c FROM bought),
            r(node, steps) AS (SELECT 'c' || c_custkey, 0 FROM customer WHERE c_nationkey = 3
                               UNION SELECT b, steps + 1 FROM r JOIN e ON a = node WHERE steps < 8)
       SELECT CAST(substr(node, 2) AS BIGINT) AS c_custkey, CAST(min(steps) // 2 AS INT) AS links FROM r WHERE node LIKE 'c%' GROUP BY node""",
)
def recursive(spark, sf_dir):
    """Customers linked with those of a nation by a part that both bought in bulk, and over how many others, up to four links."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    bought = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, p = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("p"), "l_partkey")
    edges = bought.select(c.alias("a"), p.alias("b")).union(bought.select(p, c))
    starts = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    found = reachable(edges, starts, 8).where("node LIKE 'c%'")
    return found.select(F.substring("node", 2, 20).cast("long").alias("c_custkey"), F.floor(F.col("steps") / 2).cast("int").alias("links"))


same_sql(
    "p50_cte",
    """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
       SELECT c_custkey, round(total, 2) AS total FROM big JOIN {customer} ON c_custkey = o_custkey WHERE total > 500000""",
    "orders", "customer",
)


@query(
    "p47_sort_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
)
def sort_limit(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return ordered.select("o_orderkey", "o_totalprice").offset(5).limit(20)


@query("p39_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("p39_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")
