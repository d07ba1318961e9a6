"""Scalar, nested and semi-structured queries over the fixture tables; fixture-derived but for r09."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.elapsed import elapsed
from millrace.plans.registry import query
from millrace.session import table


@query("r09_elapsed", "SELECT event_id, printf('%02d:%02d', event_id // 60, event_id % 60) AS mmss FROM events")
def elapsed_time(spark, sf_dir):
    """Elapsed seconds as mm:ss (R9, exact)."""
    return table(spark, sf_dir, "events").select("event_id", elapsed(F.col("event_id")).alias("mmss"))


@query("r11_prefix", "SELECT page_id, starts_with(url, 'https://') AS secure FROM pages")
def prefix(spark, sf_dir):
    """Selection by a string's beginning (R11)."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").startswith("https://").alias("secure"))


@query(
    "r12_lookup",
    """SELECT c_custkey, coalesce(s_name, 'none') AS target FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def lookup(spark, sf_dir):
    """A point lookup with a default where there is no target (R12)."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("s_name", F.lit("none")).alias("target"))


@query(
    "p51_strings",
    r"""SELECT p_partkey, upper(p_name) AS up, trim('  ' || p_brand || ' ') AS trimmed, substring(p_type, 2, 3) AS part,
               concat_ws('-', p_brand, p_type) AS joined, split_part(p_name, ' ', 1) AS head,
               regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS masked, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance,
               replace(p_name, 'a', '_') AS replaced, CAST(length(p_name) AS BIGINT) AS n FROM part""",
)
def strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.substring("p_type", 2, 3).alias("part"),
        F.concat_ws("-", "p_brand", "p_type").alias("joined"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"),
        F.regexp_replace("p_brand", "[0-9]+", "N").alias("masked"),
        F.levenshtein("p_name", "p_type").cast("long").alias("distance"),
        F.replace("p_name", F.lit("a"), F.lit("_")).alias("replaced"),
        F.length("p_name").cast("long").alias("n"),
    )


@query(
    "p52_dates",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
              CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
              CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
              CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, last_day(o_orderdate) AS month_end,
              strftime(o_orderdate, '%Y/%m/%d') AS shown FROM orders""",
)
def dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").cast("long").alias("y"),
        F.month("o_orderdate").cast("long").alias("m"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month_start"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
        F.date_add(day, 30).alias("due"),
        F.last_day(day).alias("month_end"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("shown"),
    )


@query(
    "p53_math",
    """SELECT s_suppkey, round(s_acctbal, 1) AS r, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS root,
              round(ln(abs(s_acctbal) + 1), 6) AS log, CAST((s_suppkey % 7 + 7) % 7 AS BIGINT) AS rest,
              greatest(s_acctbal, 0.0) AS hi, least(s_acctbal, 1000.0) AS lo, round(power(s_nationkey, 2), 3) AS square FROM supplier""",
)
def math(spark, sf_dir):
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.round(b, 1).alias("r"),
        F.floor(b).cast("long").alias("f"),
        F.round(F.sqrt(F.abs(b)), 6).alias("root"),
        F.round(F.ln(F.abs(b) + 1), 6).alias("log"),
        F.pmod("s_suppkey", F.lit(7)).cast("long").alias("rest"),
        F.greatest(b, F.lit(0.0)).alias("hi"),
        F.least(b, F.lit(1000.0)).alias("lo"),
        F.round(F.pow("s_nationkey", F.lit(2)), 3).alias("square"),
    )


@query(
    "p55_arrays",
    r"""SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x)) AS upped,
              list_filter(string_split(p_name, ' '), lambda x: length(x) > 5) AS long_words,
              CAST(list_sum(list_transform(string_split(p_name, ' '), lambda x: length(x))) AS BIGINT) AS letters,
              list_sort(string_split(p_name, ' ')) AS sorted FROM part""",
)
def arrays(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.transform(words, F.upper).alias("upped"),
        F.filter(words, lambda x: F.length(x) > 5).alias("long_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("letters"),
        F.array_sort(words).alias("sorted"),
    )


@query("p55_explode", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query(
    "p56_maps_structs",
    "SELECT p_partkey, p_brand AS brand, p_size * 2 AS doubled FROM part WHERE p_size > 20",
)
def maps_structs(spark, sf_dir):
    made = F.map_from_entries(F.array(F.struct(F.lit("size").alias("k"), F.col("p_size").alias("v")), F.struct(F.lit("one").alias("k"), F.lit(1).alias("v"))))
    big = F.map_filter(made, lambda k, v: v > 20)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.named_struct(F.lit("brand"), F.col("p_brand")).alias("s"), big.alias("m"))
    return rows.where("m['size'] IS NOT NULL").select("p_partkey", "s.brand", (F.col("m")["size"] * 2).alias("doubled"))


@query(
    "p57_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM events",
)
def json(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    by_path = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), (by_path + 1).alias("k1"))


@query("p58_hashes", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))
