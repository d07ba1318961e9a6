"""Sketches that are stored by part and merged later."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _slots(item: str, width: int, depth: int) -> Column:
    """A counter for the item in each row of a count-min sketch."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(row), item), F.lit(width)) for row in range(depth)])


def count_min(rows: DataFrame, item: str, by: list[str], error: float, confidence: float) -> DataFrame:
    """``by, row, slot, n``: the counters of a count-min sketch of ``item`` for each group.

    An estimate is never below the count, and above it by more than ``error`` times
    the rows of its group with a chance of at most ``1 - confidence``. A sketch has at
    most ``width * depth`` counters, which are summed up where the rows are read.
    Sketches of equal shape merge by ``merged_counts``. Null items are not counted.
    """
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / (1 - confidence)))
    slots = rows.where(F.col(item).isNotNull()).select(*by, F.posexplode(_slots(item, width, depth)).alias("row", "slot"))
    return slots.groupBy(*by, "row", "slot").agg(F.count("*").alias("n"))


def merged_counts(counters: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of all groups together that agree in ``by``."""
    return counters.groupBy(*by, "row", "slot").agg(F.sum("n").alias("n"))


def point_estimates(counters: DataFrame, items: DataFrame, item: str, by: list[str], error: float, confidence: float) -> DataFrame:
    """``by, item, estimate`` for every distinct item and every group that ``items`` asks for."""
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / (1 - confidence)))
    asked = items.select(*by, item).where(F.col(item).isNotNull()).distinct()
    slots = asked.select(*by, item, F.posexplode(_slots(item, width, depth)).alias("row", "slot"))
    counted = slots.join(counters, [*by, "row", "slot"], "left").fillna(0, ["n"])
    return counted.groupBy(*by, item).agg(F.min("n").alias("estimate"))
