"""Filter interaction audit: what each of five filters removes in every order of applying them.

Every document becomes a mask of the filters that it fails, and documents are
counted by (part, mask): at most 32 cells a part, whatever the number of
documents. Each cell then folds across the array of all 120 orders with
higher-order functions: along an order, a running flag says whether the cell's
documents are still in, which gives a struct of weighted counts per step, 600 a
cell. The structs of a part's cells are merged by elementwise sums. All of it is
expressions of the DataFrame API.

A copy is told from the first of its text by an equi-join on (digest, id) with
the smallest id of each digest, so a text with very many copies is one row of one
side, and its copies are spread by their ids.

Defined results: null text is empty and null languages are the part ``''``;
copies of the smallest id's row itself are no duplicates, and rows without an id
have no order, so they never fail E nor make others fail; a document is good or
toxic if any of its label rows says so, and labels without an id mark nothing;
ties cannot arise, as a step's counts are sums; an empty table gives no rows.
Texts of any length are read whole. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_STEP = f"struct<filter: string, {', '.join(f'{name}: bigint' for name in COUNTS)}>"


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, digest, mask`` of every document; the mask's bits 0 to 3 are the failures of A to D."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        text.alias("text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
    )
    n = F.size("words")
    failed = [
        n < 100,
        F.lit(100) * F.size(F.array_distinct("words")) < F.lit(80) * n,
        F.lit(100) * F.regexp_count("text", F.lit("[A-Z]")) > F.lit(10) * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(fails, 1 << bit).otherwise(0) for bit, fails in enumerate(failed)), F.lit(0))
    return read.select("doc_id", "part", _digest("text").alias("digest"), mask.alias("mask"))


def _digest(text) -> Column:
    return F.unhex(F.sha2(text, 256))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, docs, good, toxic``: how many documents fail just these filters."""
    texts = docs.select(F.col(id_col).alias("doc_id"), _digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = failures(docs, id_col, text_col, part_col).join(said, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    counted = rows.groupBy("part", mask.alias("mask"))
    return counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _folded(orders: Column) -> Column:
    """The cell's structs for the steps of all orders, one order after another."""

    def along(order: Column) -> Column:
        def step(state: Column, place: Column) -> Column:
            letter = order.substr(place, F.lit(1))
            bit = F.position(letter, F.lit(FILTERS)) - 1
            fails = F.getbit(F.col("mask"), bit) == 1
            there = state["there"]
            if_so = lambda holds, weight: F.when(holds, F.col(weight)).otherwise(F.lit(0)).cast("bigint")
            counts = [
                if_so(there & ~fails, "docs"),
                if_so(there & fails, "docs"),
                if_so(~there & fails, "docs"),
                if_so(F.col("mask") == F.call_function("shiftleft", F.lit(1), bit), "docs"),
                if_so(there & fails, "good"),
                if_so(there & fails, "toxic"),
            ]
            one = F.struct(letter.alias("filter"), *[c.alias(name) for name, c in zip(COUNTS, counts)])
            return F.struct((there & ~fails).alias("there"), F.concat(state["steps"], F.array(one)).alias("steps"))

        start = F.struct(F.lit(True).alias("there"), F.array().cast(f"array<{_STEP}>").alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda state: state["steps"])

    return F.flatten(F.transform(orders, along))


def _merged(of_cells: Column) -> Column:
    """Elementwise sums of the cells' arrays of structs."""

    def plus(a: Column, b: Column) -> Column:
        return F.struct(a["filter"].alias("filter"), *[(a[name] + b[name]).alias(name) for name in COUNTS])

    rest = F.slice(of_cells, F.lit(2), F.size(of_cells))
    return F.aggregate(rest, F.element_at(of_cells, 1), lambda merged, cell: F.zip_with(merged, cell, plus))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: the counts of the step's filter there, and its ``shapley`` sum.

    A part's cells, at most 32, meet in one row before they are merged.
    """
    orders = F.array(*map(F.lit, ORDERS))
    folded = cells(docs, labels, id_col, text_col, part_col).select("part", _folded(orders).alias("steps"))
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("of_cells")).select("part", _merged(F.col("of_cells")).alias("steps"))

    def removed(letter: str) -> Column:
        own = F.filter("steps", lambda s: s["filter"] == letter)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, s: total + s["removed"])

    shares = F.array(*map(removed, FILTERS)).alias("shares")
    rows = merged.select("part", "steps", shares).select("part", "shares", F.posexplode("steps").alias("place", "at"))
    return rows.select(
        "part",
        F.element_at(orders, (F.floor(F.col("place") / len(FILTERS)) + 1).cast("int")).alias("filter_order"),
        (F.col("place") % len(FILTERS) + 1).cast("int").alias("step"),
        *[F.col("at")[name].alias(name) for name in COUNTS],
        F.element_at("shares", F.position(F.col("at")["filter"], F.lit(FILTERS))).alias("shapley"),
    )
