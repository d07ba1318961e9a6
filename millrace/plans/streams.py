"""Structured Streaming queries over the events, drained to the end; fixture-derived."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import shared_dir, table
from millrace.streaming.runs import ROCKS_DB, arriving, by_time, drained, event_stream, run_to_end
from millrace.streaming.timers import timed_sessions
from millrace.streaming.upserts import UpsertSink


@query("p70_file_stream", "SELECT event_id, event_type FROM events WHERE value > 50")
def file_stream(spark, sf_dir):
    return drained(event_stream(spark, sf_dir).where("value > 50").select("event_id", "event_type"))


@query(
    "p72_tumbling",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def tumbling(spark, sf_dir):
    grouped = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type")
    counted = grouped.agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return drained(counted, "complete")


@query(
    "p73_sliding",
    """SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL 1 MINUTE * s AS start, count(*) AS n
       FROM events, (VALUES (0), (30)) v(s) GROUP BY ALL""",
)
def sliding(spark, sf_dir):
    grouped = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "30 minutes"))
    return drained(grouped.agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query(
    "p74_session",
    """WITH s AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 AS INT), 1) AS starts
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, session""",
)
def session(spark, sf_dir):
    grouped = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "30 minutes"), "user_id")
    counted = grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
    return drained(counted, "complete")


@query("p75_dedup", "SELECT count(DISTINCT user_id) AS users FROM events")
def dedup(spark, sf_dir):
    once = event_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id"])
    return drained(once.select("user_id")).agg(F.count("*").alias("users"))


@query(
    "p76_stream_static",
    """SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey""",
)
def stream_static(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return drained(event_stream(spark, sf_dir).join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query(
    "p76_stream_stream",
    """SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id
       AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR""",
)
def stream_stream(spark, sf_dir):
    clicks = event_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("cu"), F.col("ts").alias("ct"))
    buys = event_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"), F.col("ts").alias("pt"))
    on = F.expr("cu = pu AND pt >= ct AND pt <= ct + INTERVAL 1 HOUR")
    joined = clicks.withWatermark("ct", "10 minutes").join(buys.withWatermark("pt", "10 minutes"), on)
    return drained(joined.select("click_id", "purchase_id"))


def _in_time_order(spark, sf_dir, *columns: str):
    """The events, arriving by five time slices in as many micro-batches."""
    events = table(spark, sf_dir, "events").select(*columns)
    return arriving(events, by_time(events, "ts", 5), 5).withColumn("ts", F.col("ts").cast("timestamp"))


#: What arrives when, and the watermark by which a micro-batch finds a row late: that of the last but one before it.
_ARRIVALS = """
    bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
    slices AS (SELECT e.*, CAST(floor((epoch_us(ts) - lo) * 5 / (hi - lo + 1)) AS INT) AS slice FROM events e, bounds),
    arrived AS (SELECT *, slice + CASE WHEN event_id % 10 = 3 THEN 2 ELSE 0 END AS batch FROM slices),
    seen AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 10 MINUTE AS mark FROM arrived GROUP BY batch)"""


@query(
    "p77_late_rows",
    f"""WITH {_ARRIVALS},
        taken AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type FROM arrived a LEFT JOIN seen s ON s.batch = a.batch - 2
                  WHERE mark IS NULL OR time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR > mark)
        SELECT start, event_type, count(*) AS n FROM taken
        WHERE start + INTERVAL 1 HOUR <= (SELECT max(mark) FROM seen) GROUP BY ALL""",
)
def late_rows(spark, sf_dir):
    """Hourly counts when a tenth of the events come two micro-batches late: rows of windows that the watermark has passed are dropped."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    late = F.when(F.col("event_id") % 10 == 3, 2).otherwise(0)
    stream = arriving(events, by_time(events, "ts", 5) + late, 7).withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(hourly(stream))


def hourly(stream):
    counted = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "p76_stream_outer",
    """WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
            w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS mark)
       SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM c LEFT JOIN p
       ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR, w
       WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 1 HOUR < mark""",
)
def stream_outer(spark, sf_dir):
    """Clicks with the purchases of the hour after; a click without one comes out when the watermark has passed that hour."""
    stream = lambda: _in_time_order(spark, sf_dir, "event_id", "user_id", "event_type", "ts")
    clicks = stream().where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("cu"), F.col("ts").alias("ct"))
    buys = stream().where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"), F.col("ts").alias("pt"))
    on = F.expr("cu = pu AND pt >= ct AND pt <= ct + INTERVAL 1 HOUR")
    joined = clicks.withWatermark("ct", "10 minutes").join(buys.withWatermark("pt", "10 minutes"), on, "left_outer")
    return drained(joined.select("click_id", "purchase_id"))


@contextmanager
def _rocks_db(spark):
    """State of custom operators needs the RocksDB provider while their stream runs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


@query(
    "p78_timers",
    """WITH s AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 AS INT), 1) AS starts
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
       SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM n GROUP BY user_id, session
       HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def timers(spark, sf_dir):
    """The sessions of p45 that a timer closes: all but those still open at the last watermark."""
    stream = _in_time_order(spark, sf_dir, "user_id", "ts").withWatermark("ts", "10 minutes")
    users = table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id")).first()[0]
    with _rocks_db(spark):
        closed = drained(timed_sessions(stream.withColumn("micros", F.unix_micros("ts")), "user_id", 1800, users))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return closed.select(F.col("key").alias("user_id"), at("first").alias("session_start"), at("last").alias("session_end"), "n")


@query("p78_custom_state", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def custom_state(spark, sf_dir):
    """Events counted per user by a state of its own over several micro-batches; a user's rows come in frames of bounded size."""
    from pyspark.sql.streaming import StatefulProcessor

    class Count(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "n long")

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(r) for r in rows)
            self.seen.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

        def close(self):
            pass

    users = _in_time_order(spark, sf_dir, "user_id", "ts").select("user_id")
    with _rocks_db(spark):
        return upserted(users.groupBy("user_id").transformWithStateInPandas(Count(), "user_id long, n long", "Update", "None"), "user_id")


@query(
    "p79_upsert",
    "SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY user_id",
)
def upsert(spark, sf_dir):
    """Running figures of each user in update mode, in a sink with one row per key."""
    counted = _in_time_order(spark, sf_dir, "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return upserted(counted, "user_id").withColumn("latest", F.col("latest").cast("timestamp_ntz"))


def upserted(stream, *keys: str):
    """The newest row of every key after all available input."""
    folder = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    sink = UpsertSink(f"{folder}/out", keys)
    run_to_end(stream, "update", sink.write, folder)
    return sink.current(stream.sparkSession, stream.schema)


@query("p79_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def memory_sink(spark, sf_dir):
    """A memory sink, which holds its rows on the driver: here one per event type."""
    name = f"sink_{uuid.uuid4().hex}"
    counted = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    running = counted.writeStream.format("memory").queryName(name).outputMode("complete")
    running.trigger(availableNow=True).option("checkpointLocation", f"{shared_dir(spark)}/{name}").start().awaitTermination()
    return spark.table(name)
