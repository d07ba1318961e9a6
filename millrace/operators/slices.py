"""Windows over keys that may hold any share of the rows: a scan in two levels.

The rows of hot keys are cut into time slices of about equal numbers of rows. What a
window carries along is summed up per (key, slice), scanned over the slices of a
key, and applied inside each slice, so a hot key is spread over as many tasks as it
has slices. Keys that are not hot keep all their rows in slice 0.

Null keys are a key of their own. Rows without a time come first, in slice 0. Rows of
one key at one instant stay in one slice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A key with more rows is cut into slices; so many rows are worked on in one place.
ROWS_PER_SLICE = 1_000_000
#: Slices of the time axis at most, which bounds the rows of a scan for one key.
MOST_SLICES = 4_096

#: Kinds of running totals: how rows and how slices are summed up.
_KINDS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def sliced(rows: DataFrame, key: str, time: str, rows_per_slice: int = ROWS_PER_SLICE) -> tuple[DataFrame, int]:
    """``rows`` with a column ``slice``, rising with time inside each key, and the number of slices.

    The broadcast side has at most one key for every ``rows_per_slice`` rows.
    """
    counts = rows.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_slice)
    hot_rows = counts.agg(F.sum("n")).first()[0]
    if not hot_rows:
        return rows.withColumn("slice", F.lit(0)), 1
    hot = F.broadcast(counts.select("hot_key", F.lit(True).alias("hot")))
    marked = rows.join(hot, F.col(key).eqNullSafe(F.col("hot_key")), "left").drop("hot_key").withColumn("slice_time", _micros(time).cast("double"))
    n = min(MOST_SLICES, -(-hot_rows // rows_per_slice))
    grid = F.array(*[F.lit((i + 1) / (n + 1)) for i in range(n)])
    splits = marked.where("hot").agg(F.percentile_approx("slice_time", grid, F.lit(20 * (n + 1)))).first()[0] or []
    borders = [float("-inf"), *sorted(set(splits)), float("inf")]
    placed = Bucketizer(splits=borders, inputCol="slice_time", outputCol="slice_found", handleInvalid="keep").transform(marked)
    own = F.when(F.col("hot") & F.col("slice_time").isNotNull(), F.col("slice_found").cast("int") + 1).otherwise(0)
    return placed.withColumn("slice", own).drop("hot", "slice_time", "slice_found"), len(borders)


def carried(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``summary``, which has one row per key and slice."""
    right = summary.withColumnsRenamed({key: "slice_key", "slice": "slice_of"})
    return rows.join(right, F.col(key).eqNullSafe(F.col("slice_key")) & (F.col("slice") == F.col("slice_of"))).drop("slice_key", "slice_of")


def running(rows: DataFrame, key: str, order: list[str], totals: dict[str, tuple[str, Column]], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``rows`` with running totals up to and with each row, by ``order``, whose first column is a time.

    ``totals`` gives for each new column its kind (count, sum, max or min) and what is totalled.
    """
    cut_up, n = sliced(rows, key, order[0], rows_per_slice)
    inside = Window.partitionBy(key, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = cut_up.select("*", *[_KINDS[kind][0](what).over(inside).alias(name) for name, (kind, what) in totals.items()])
    if n == 1:
        return part.drop("slice")
    summary = cut_up.groupBy(key, "slice").agg(*[_KINDS[kind][0](what).alias(name) for name, (kind, what) in totals.items()])
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(key, "slice", *[_KINDS[kind][1](name).over(earlier).alias(f"before_{name}") for name, (kind, _) in totals.items()])
    joined = carried(part, before, key)
    for name, (kind, _) in totals.items():
        own, past = F.col(name), F.col(f"before_{name}")
        merged = {"max": F.greatest, "min": F.least}.get(kind, lambda a, b: F.coalesce(a + b, a, b))(own, past)
        joined = joined.withColumn(name, merged)
    return joined.drop("slice", *[f"before_{name}" for name in totals])


def framed(
    rows: DataFrame, key: str, order: list[str], before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``rows`` with columns over ROWS frames or offsets that reach at most ``before`` rows back and ``after`` ahead.

    The rows of a key are numbered by a two-level scan and dealt to blocks by their
    number; rows near a border go to the blocks of both sides, where only the
    block's own rows are answered.
    """
    block_rows = max(rows_per_slice, before + after, 1)
    numbered = running(rows, key, order, {"position": ("count", F.lit(1))}, rows_per_slice)
    block = lambda place: F.floor(place / block_rows)
    wanted = F.sequence(block(F.col("position") - after), block(F.col("position") + before))
    copied = numbered.withColumn("block", F.explode(wanted))
    window = Window.partitionBy(key, "block").orderBy("position")
    made = copied.select("*", *[column(window).alias(name) for name, column in columns.items()])
    return made.where(F.col("block") == block(F.col("position"))).drop("block", "position")


def ends(rows: DataFrame, key: str, order: list[str], value: str, n: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``rows`` with ``firsts``, the first n values of each row's key, and ``last``, its last one."""
    cut_up, _ = sliced(rows, key, order[0], rows_per_slice)
    inside = Window.partitionBy(key, "slice")
    ranked = cut_up.withColumn("rank", F.row_number().over(inside.orderBy(*order)))
    place = F.struct(*order)
    early = F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct(*order, F.col(value).alias("end_value")))))
    summary = ranked.groupBy(key, "slice").agg(early.alias("early"), F.max_by(value, place).alias("late"))
    # A key has a row for each of its slices here.
    of_key = summary.groupBy(F.col(key).alias("end_key")).agg(
        F.array_sort(F.collect_list(F.struct("slice", "early"))).alias("slices"), F.max_by("late", "slice").alias("last")
    )
    firsts = F.transform(F.slice(F.flatten(F.col("slices.early")), 1, n), lambda e: e["end_value"])
    of_slice = summary.select(key, "slice").join(of_key.select("end_key", firsts.alias("firsts"), "last"), F.col(key).eqNullSafe(F.col("end_key"))).drop("end_key")
    return carried(cut_up, of_slice, key).drop("slice")


def range_total(rows: DataFrame, key: str, time: str, row_id: str, seconds: int, value: Column | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``row_id, total``: the rows of the key (or the sum of ``value``) in the ``seconds`` up to each row's time, peers included.

    A total over a RANGE frame is the difference of two running totals: at the
    row's time after all its peers, and just before the frame. Both are read off
    by probes that are put in the order of the rows. ``row_id`` tells rows apart.
    """
    what = F.lit(1).cast("long") if value is None else value
    base = rows.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(row_id).alias("id"), what.alias("x"))
    none = F.lit(None).cast(base.schema["x"].dataType)
    back = F.expr(f"INTERVAL '{int(seconds)}' SECOND")
    kinds = [
        base.select("k", (F.col("t") - back).alias("t"), F.lit(0).alias("kind"), "id", none.alias("x")),
        base.select("k", "t", F.lit(1).alias("kind"), F.lit(None).cast(base.schema["id"].dataType).alias("id"), "x"),
        base.select("k", "t", F.lit(2).alias("kind"), "id", none.alias("x")),
    ]
    every = reduce(DataFrame.unionAll, kinds)
    scanned = running(every, "k", ["t", "kind"], {"total": ("sum", F.col("x"))}, rows_per_slice).where("kind <> 1")
    at = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("total"))), F.lit(0))
    return scanned.groupBy(F.col("id").alias(row_id)).agg((at(2) - at(0)).alias("total"))
