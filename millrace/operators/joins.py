"""Joins that Spark has no operator for, composed of those it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.slices import ROWS_PER_SLICE, carried, sliced


#: The axis of a range join has 2 ** AXIS_BITS cells.
AXIS_BITS = 50
#: Levels of cells are this many doublings apart; the more, the fewer copies of points and the more of ranges.
LEVEL_STEP = 2


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, level_step: int = LEVEL_STEP) -> DataFrame:
    """Rows of ``points`` with each row of ``ranges`` whose [low, high] holds the point.

    The axis between the least and the largest point is halved again and again into
    dyadic cells. A range, cut off at the ends of the axis, is covered at the one level
    whose cells are at most half as long as the range, so by 3 to ``2 ** (level_step + 1) + 1``
    cells; a point is in one cell of each level that some range is covered at.
    The join is an equi-join on (level, cell) with the predicate as a check, and
    finds a pair once, as a range has one level and a point one cell of it. Ranges
    of any lengths can be mixed; what is checked is at most twice what a range
    holds for evenly spread points. At most ``AXIS_BITS / level_step + 1`` levels come to the driver.

    Nulls and NaN match nothing, infinite bounds are open ends, and a range whose
    low is above its high holds nothing. Numbers, dates and timestamps are compared as
    they are; they are only dealt to cells as doubles.
    """

    def number(column: str, frame: DataFrame):
        kind = dict(frame.dtypes)[column]
        if kind.startswith("timestamp"):
            return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
        return F.unix_date(column).cast("double") if kind == "date" else F.col(column).cast("double")

    at, begin, end = number(point, points), number(low, ranges), number(high, ranges)
    held = points.where(at.isNotNull() & ~F.isnan(at))
    finite = at.between(-1.7976931348623157e308, 1.7976931348623157e308)
    least, most = held.where(finite).agg(F.min(at), F.max(at)).first()
    least, most = (least or 0.0), (most or 0.0)
    cells = 1 << AXIS_BITS
    scale = cells / (most / 2 - least / 2) / 2 if most > least else 0.0

    def cell(x):
        """Never falls as x rises, and takes what lies beyond the axis to its ends."""
        inner = F.floor((F.least(F.greatest(x, F.lit(least)), F.lit(most)) / 2 - least / 2) * 2 * scale).cast("long")
        return F.least(F.greatest(inner, F.lit(0)), F.lit(cells - 1))

    asked = ranges.where((F.col(low) <= F.col(high)) & ~F.isnan(begin) & ~F.isnan(end))
    placed = asked.withColumns({"range_first": cell(begin), "range_last": cell(end)})
    length = F.col("range_last") - F.col("range_first") + 1
    fits = F.greatest(F.lit(0), F.length(F.bin(length)) - 2)  # cells of this level are at most half as long as the range
    placed = placed.withColumn("range_level", (fits - fits % level_step).cast("int"))
    levels = sorted(r[0] for r in placed.select("range_level").distinct().collect())
    if not levels:
        levels = [0]
    # Java shifts, with the level taken from the row.
    at_level = lambda c: F.expr(f"shiftright({c}, range_level)")
    covered = placed.withColumn("range_cell", F.explode(F.sequence(at_level("range_first"), at_level("range_last")))).drop("range_first", "range_last")
    marked = held.withColumn("range_place", cell(at)).withColumn("range_level", F.explode(F.array(*map(F.lit, levels))))
    marked = marked.withColumn("range_cell", at_level("range_place")).drop("range_place")
    joined = marked.join(covered, ["range_level", "range_cell"]).where(F.col(point).between(F.col(low), F.col(high)))
    return joined.drop("range_level", "range_cell")


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key at or before its time.

    Rows of both sides are sorted together. Those of a hot key are cut into time
    slices of about equal numbers of rows, and the last right row of a slice is
    carried on to the slices after it through a table with one row per key and slice,
    so a key with any share of the rows is spread over its slices. Right rows come
    first at equal times; null keys and left rows without a time match nothing.
    """
    payload = F.struct(*[F.col(v) for v in values])
    mine = left.select(F.struct(*left.columns).alias("asof_row"), F.col(by).alias("asof_key"), F.col(time).alias("asof_time"))
    other = right.select(F.col(by).alias("asof_key"), F.col(time).alias("asof_time"), payload.alias("asof_value")).where("asof_key IS NOT NULL AND asof_time IS NOT NULL")
    both = mine.withColumn("asof_value", F.lit(None).cast(other.schema["asof_value"].dataType)).unionByName(
        other.withColumn("asof_row", F.lit(None).cast(mine.schema["asof_row"].dataType))
    )
    both, _ = sliced(both, "asof_key", "asof_time", rows_per_slice)
    keys = Window.partitionBy("asof_key", "slice").orderBy("asof_time", F.col("asof_value").isNull())
    inside = both.withColumn("asof_found", F.last("asof_value", ignorenulls=True).over(keys)).where("asof_row IS NOT NULL")
    lasts = both.groupBy("asof_key", "slice").agg(F.max_by("asof_value", F.when(F.col("asof_value").isNotNull(), F.col("asof_time"))).alias("last"))
    earlier = Window.partitionBy("asof_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select("asof_key", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    found = F.when(F.col("asof_time").isNotNull(), F.coalesce("asof_found", "carried"))
    return carried(inside, before, "asof_key").select("asof_row.*", *[found[v].alias(f"asof_{v}") for v in values])
