"""Samples that do not depend on how the rows are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a stratum of which each gives its best before they meet.
PARTS = 256


def place_of(columns: list[str], seed: int) -> Column:
    """A hash of the columns as text; nulls are told from texts."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def stratified(rows: DataFrame, strata: list[str], size: int, identity: list[str], seed: int = 0) -> DataFrame:
    """``size`` rows of every stratum (all, if it has no more): those with the smallest hashes of ``identity``.

    The same rows for any partitioning, any order and any superset that adds larger
    hashes. A stratum's rows are first cut down in ``PARTS`` parts, so that one with a
    third of all rows does not meet in one task. Rows of equal identity are ordered by
    their other columns. Null strata are strata.
    """
    marked = rows.withColumn("sample_place", place_of(identity, seed))
    order = ["sample_place", *[c for c in rows.columns if c not in strata]]
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))
    first = marked.withColumn("sample_part", part)
    few = first.withColumn("rn", F.row_number().over(Window.partitionBy(*strata, "sample_part").orderBy(*order))).where(F.col("rn") <= size)
    best = few.withColumn("rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("rn") <= size)
    return best.select(*rows.columns)
