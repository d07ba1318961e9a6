"""File sinks that are read back, for checking what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from millrace.session import shared_dir


def written_and_read(df: DataFrame, format: str, partition_by: str | None = None, **options) -> DataFrame:
    """``df`` as it comes back from a new folder of the shared directory, with its own schema."""
    path = f"{shared_dir(df.sparkSession)}/sink-{uuid.uuid4().hex}"
    writer = df.write.format(format).options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
    return df.sparkSession.read.format(format).options(**options).schema(df.schema).load(path).select(df.columns)
