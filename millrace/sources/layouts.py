"""File layouts that later reads use: buckets for joins, partitions for pruning and for overwriting in part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from millrace.session import shared_dir


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/layout-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in buckets of ``key``; two with as many buckets join on it without an exchange."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", _folder(df)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files and the plan that reads them stay
    return table


def partitioned(df: DataFrame, *keys: str) -> str:
    """The folder in which ``df`` is partitioned by ``keys``."""
    folder = _folder(df)
    df.write.partitionBy(*keys).parquet(folder)
    return folder


def overwrite_partitions(df: DataFrame, folder: str, *keys: str) -> None:
    """Replaces the partitions of which ``df`` has rows; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)
