"""Exact percentiles of groups of any size, without a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Splits of a round; each leaves about a share of one in so many of a group's values.
SPLITS = 63
#: Error of the first round's approximate quantiles, as a share of one in so many of the rows, and how far off its splits lie, in such errors.
FIRST_ACCURACY, FIRST_SPLITS = 10_000, (2, 64)
#: Rows that may be ranked in one task.
RANKED_ROWS = 100_000
#: Ranges that are sent to all tasks, so that the rows they are looked up for stay where they are.
SENT_RANGES = 10_000


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """A join on equal columns in which nulls are equal; the columns once."""
    right = right.withColumnsRenamed({n: f"{n}_right" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"{n}_right")) for n in names] + ([] if also is None else [also])
    return left.join(right, reduce(lambda a, b: a & b, on, F.lit(True)), how).drop(*[f"{n}_right" for n in names])


def exact_percentile(df: DataFrame, keys: list[str], value: str, share: float, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """``keys, percentile``: the interpolated percentile of ``value`` at ``share``, one row per group.

    A group's percentile lies between the values of two ranks. For each rank a
    range of values is known that holds it, and how many rows lie below. A round
    splits the ranges that hold more than ``ranked_rows`` at approximate quantiles
    of what is inside (in the first round: close around the share), counts the rows
    of each part exactly (values equal to a split
    are a part of their own) and goes on with the parts that hold the ranks, so errors
    of the approximation change the work and never the result. What is left is ranked.
    Work of a round is aggregation with partial sums, so a hot group is spread over
    all tasks, and ties never pile up. Up to SENT_RANGES ranges go to the rows; beyond
    that, rows and ranges are shuffled.

    Nulls are no values; a group without values has a null percentile; a null key is
    a group; an empty table gives no groups.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    own = [f"key{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(name) for k, name in zip(keys, own)], F.col(value).alias("v"))
    groups = cut(rows.groupBy(*own).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
    place = (F.col("n") - 1) * F.lit(share)
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place))).alias("ranks")
    open_ = groups.where("n > 0").select(*own, ranks, "least", "most", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    found, grid, accuracy = None, sorted({min(1.0, max(0.0, share + s * d / FIRST_ACCURACY)) for d in FIRST_SPLITS for s in (-1, 1)}), FIRST_ACCURACY
    while True:
        open_ = cut(open_)
        settled = open_.where("least = most").select(*own, F.explode("ranks").alias("rank"), F.col("least").alias("v"))
        found = settled if found is None else found.union(settled)
        open_ = open_.where("least < most")
        few = F.col("inside") <= ranked_rows
        n_few, n_wide = open_.agg(F.count_if(few), F.count_if(~few)).first()
        if n_few:
            found = found.union(_ranked(rows, _sent(open_.where(few), n_few), own))
        if not n_wide:
            break
        open_ = _narrowed(rows, open_.where(~few), n_wide, own, grid, accuracy)
        grid, accuracy = [(i + 1) / (SPLITS + 1) for i in range(SPLITS)], 100 * SPLITS
    found = found.groupBy(*own).agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    value_at = F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))
    joined = _joined(groups, found, own, "left")
    return joined.select(*[F.col(name).alias(k) for k, name in zip(keys, own)], value_at.alias("percentile"))


def _sent(ranges: DataFrame, n: int) -> DataFrame:
    """The ranges, marked to be sent to all tasks if they are few."""
    return F.broadcast(ranges) if n <= SENT_RANGES else ranges


def _inside(rows: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    """Each value with the ranges of its group that hold it."""
    return _joined(rows, ranges, own, also=F.col("v").between(F.col("least"), F.col("most")))


def _ranked(rows: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    order = Window.partitionBy(*own, "least").orderBy("v")
    placed = _inside(rows, ranges, own).withColumn("rank", F.row_number().over(order) - 1 + F.col("below"))
    return placed.where("array_contains(ranks, rank)").select(*own, "rank", "v")


def _narrowed(rows: DataFrame, ranges: DataFrame, n: int, own: list[str], grid: list[float], accuracy: int) -> DataFrame:
    """The parts of ``n`` ranges, split at the approximate quantiles of ``grid``, that hold their ranks."""
    near = F.array_distinct(F.percentile_approx("v", F.array(*map(F.lit, grid)), F.lit(accuracy)))
    splits = _inside(rows, _sent(ranges, n), own).groupBy(*own, "least").agg(near.alias("splits"))
    ranged = cut(_joined(ranges, splits, [*own, "least"]))
    below = lambda test: F.size(F.filter("splits", test))
    part = below(lambda s: s < F.col("v")) + below(lambda s: s <= F.col("v"))  # odd for a split itself
    inside = _inside(rows, _sent(ranged.withColumn("low", F.col("least")), n), own)
    counted = inside.groupBy(*own, "low", "ranks", "below", part.alias("part")).agg(
        F.count("*").alias("inside"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    upto = F.sum("inside").over(Window.partitionBy(*own, "low").orderBy("part")) + F.col("below")
    held = F.filter("ranks", lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("inside")))
    parts = counted.withColumn("upto", upto).select(*own, held.alias("ranks"), "least", "most", (F.col("upto") - F.col("inside")).alias("below"), "inside")
    return parts.where("size(ranks) > 0")
