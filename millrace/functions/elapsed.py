"""Elapsed time as minutes and seconds, the one data function of the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed(seconds: Column) -> Column:
    """``mm:ss`` with at least two digits each; minutes are not bounded (6000 s is ``100:00``). Null stays null."""
    minutes, rest = F.floor(seconds / 60), F.pmod(seconds, F.lit(60))
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", minutes.cast("long"), rest.cast("long")))
