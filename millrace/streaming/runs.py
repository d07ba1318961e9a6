"""Running a stream over files to its end and reading what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir, table

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with a zoned ``ts`` that can be watermarked."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows that one file of a staged arrival holds at most, about.
FILE_ROWS = 5_000_000


def arriving(rows: DataFrame, batch: Column, batches: int) -> DataFrame:
    """A stream of ``rows`` that arrive in micro-batches 0 to ``batches - 1``, as ``batch`` says of each row.

    The batches are staged one after another as files of the shared folder, as many
    for each, which the stream takes in that order. A batch must not be empty.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    numbered = rows.withColumn("arrival", batch)
    counts = numbered.groupBy("arrival").count().agg(F.max("count"), F.min("count"), F.count("*")).first()
    if counts[2] != batches:
        raise ValueError(f"{counts[2]} batches of {batches} have rows")
    files = min(-(-counts[0] // FILE_ROWS), counts[1])
    for number in range(batches):
        numbered.where(F.col("arrival") == number).drop("arrival").repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def by_time(rows: DataFrame, time: str, slices: int) -> Column:
    """The number, from 0, of each row's time slice; the slices are equally long."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    first, last = rows.agg(F.min(micros), F.max(micros)).first()
    return F.floor((micros - first) * slices / ((last or 0) - (first or 0) + 1)).cast("int")


def run_to_end(stream: DataFrame, mode: str, write, folder: str):
    """The finished query of a stream whose batches go to ``write(batch, number)``; restarts go on from ``folder``."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def dropped_late(query) -> int:
    """Rows that the stateful operators of a finished query dropped as late (for aggregates: after sums by task)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result after all available input, from a Parquet sink in the shared folder.

    In complete mode each batch replaces the result; in append mode batches add to it.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    run_to_end(stream, mode, write, folder)
    names = [f.name for f in stream.schema]
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(names)
