"""A keyed upsert sink: of each key the row of the newest batch counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UpsertSink:
    """A folder with a part for each batch, named by its number.

    A batch that is replayed replaces its own part, so a key has one current row
    however often batches run. A batch has at most one row of a key, as update mode
    gives it. ``compacted`` moves on to a folder with the current rows alone.
    """

    folder: str
    keys: tuple[str, ...]

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch_number={number}")

    def current(self, spark: SparkSession, schema) -> DataFrame:
        """One row per key; nulls are a key like others."""
        parts = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch_number long").parquet(self.folder)
        newest = parts.groupBy(*self.keys).agg(F.max_by(F.struct(*[f.name for f in schema]), "batch_number").alias("row"))
        return newest.select("row.*")

    def compacted(self, spark: SparkSession, schema, folder: str) -> "UpsertSink":
        """A sink that holds the current rows as a batch before all others."""
        self.current(spark, schema).write.mode("overwrite").parquet(f"{folder}/batch_number=-1")
        return UpsertSink(folder, self.keys)
