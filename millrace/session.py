"""Session and table access shared by every query."""

from __future__ import annotations

import gc
import re

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that results depend on (UTC, ANSI)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one made for a local run.

    A session without the setting is a local one (tests), where a temporary
    folder is as good as shared; it is also set as the checkpoint folder. On a
    cluster the setting must be there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        current = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now.

    They go once the driver has collected the plans they belong to, which on an
    idle driver can take long; a job in several steps needs the disk before that.
    Names of those plans must be gone or bound anew before the call.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
