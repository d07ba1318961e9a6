"""Sessions by gaps, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.slices import ROWS_PER_SLICE, carried, sliced


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``key, session_start, session_end, n`` of runs of events closer than ``gap_seconds``; the end is the last event.

    The events of a hot key are cut into time slices. Each slice counts the sessions
    that begin inside it; whether its first event goes on with the session before is
    told from the last event of the slice before, in a scan over a key's slices.
    A key's events without a time are one session.
    """
    gap = gap_seconds * 1_000_000
    rows, _ = sliced(events.select(key, time), key, time, rows_per_slice)
    rows = rows.withColumn("micros", F.unix_micros(F.col(time).cast("timestamp")))
    inside = Window.partitionBy(key, "slice").orderBy("micros")
    begins = F.when(F.row_number().over(inside) == 1, 0).otherwise(F.coalesce((F.col("micros") - F.lag("micros").over(inside) >= gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("begins", begins)
    summary = rows.groupBy(key, "slice").agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.sum("begins").alias("inner"))
    over = Window.partitionBy(key).orderBy("slice")
    opens = F.coalesce((F.col("first") - F.lag("last").over(over) >= gap).cast("int"), F.lit(1))
    scanned = summary.withColumn("opens", opens).withColumn("upto", F.sum(F.col("opens") + F.col("inner")).over(over))
    numbered = carried(rows, scanned.select(key, "slice", (F.col("upto") - F.col("inner")).alias("session")), key)
    session = F.col("session") + F.sum("begins").over(inside)  # with all peers, so that their order does not matter
    found = numbered.withColumn("session", session).groupBy(key, "session")
    return found.agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count("*").alias("n")).drop("session")
