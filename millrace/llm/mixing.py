"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight and a linear schedule over training time t in [0, 1].
Its cumulative demand D(t) is the integral of the schedule, scaled so that D(1)
is the source's target. The source's documents are laid end to end in a fixed
pseudo-random order, epoch after epoch; the document that begins after c words
is placed at the time t with D(t) = c. A global range sort by t gives the
training order.

Scale: only (source, size, key) rows are shuffled unless the caller carries
columns along. A source's running total is split over hash buckets (about
``BUCKET_ROWS`` rows each), so a source with a third of all rows is spread over
many tasks; the totals of the buckets, one row per bucket, are summed up first.
Only per-source figures meet in one task.

Defined results: null text has size 0; the null source is a source of its own,
last in order; a document of size 0 takes 0 words and has no position; equal
``doc_id`` are ordered by size (equal rows are interchangeable); an empty table
gives an empty result; null ``doc_id`` is ordered as an empty key. Columns of
the input cannot clash, as carried rows are held in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Start and end of the linear schedule of each weight: steady, falling, rising.
RAMPS = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
EPOCHS = 3
BUCKET_ROWS = 4096
_HASH_BITS = 28


def source_targets(totals: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Targets for a table (source, source_size) with one row per source.

    Weights repeat over the sources in code-point order, null last. Targets
    share the sum of all sizes by weight; one that would pass ``epochs`` times
    its source's size stops there and its excess is shared by the others. The
    water level is found in one pass: sources reach their cap in the order of
    cap per weight.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = totals.withColumn("source_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    filling = everything.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fill_rank", F.row_number().over(filling))
        .withColumn("level", F.col("left_words").cast("double") / F.col("left_weight").cast("double"))
    )
    open_here = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("fill_rank", "level"))
    ranked = ranked.withColumn("water", F.min(open_here).over(everything))
    target = F.when(F.col("fill_rank") < F.col("water.fill_rank"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("water.level") * F.col("weight"), F.col("cap").cast("double"))
    )
    return ranked.select("source", "source_size", "source_rank", target.alias("target"))


def _time_of(words: Column, quota: Column, rank: Column, ramps) -> Column:
    """The time at which the cumulative demand of a linear schedule reaches ``words``."""
    pick = lambda i: F.element_at(F.array(*[F.lit(float(r[i])) for r in ramps]), (rank % len(ramps) + 1).cast("int"))
    start, end = pick(0), pick(1)
    area = words.cast("double") / quota * (start + end) / 2
    return F.when(words == 0, F.lit(0.0)).otherwise(2 * area / (start + F.sqrt(start * start + 2 * (end - start) * area)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
    weights=WEIGHTS,
    ramps=RAMPS,
    epochs: int = EPOCHS,
) -> DataFrame:
    """The mix: one row per document, with its place and share.

    Returns ``doc_id, source, size, source_size, target, taken, placements``,
    where ``placements`` lists ``(position, words)`` for each time the document
    is taken, the last document of a source possibly in part; with ``carry``
    also ``row``, the whole input row.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = narrow.withColumn("order_key", key)
    if not carry:
        narrow = cut(narrow)
        rows = narrow.count()
    else:
        rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    place = F.conv(F.substring("order_key", 1, _HASH_BITS // 4), 16, 10).cast("long")
    narrow = narrow.withColumn("bucket", F.shiftright(place * buckets, _HASH_BITS))

    totals = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = cut(totals)
    sources = source_targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sources, totals = sources.alias("s"), totals.alias("t")
    plan = totals.join(sources, F.col("t.source").eqNullSafe(F.col("s.source"))).select(
        "t.source", "t.bucket", "t.bucket_start", "s.source_size", "s.source_rank", "s.target"
    )

    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size")
    within = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = narrow.withColumn("within", within).alias("d")
    laid = laid.join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))
    ).select("d.*", "p.bucket_start", "p.source_size", "p.source_rank", "p.target")

    quota = F.round("target").cast("long")
    begin = F.col("bucket_start") + F.col("within")
    turns = []
    for epoch in range(epochs):
        start = begin + F.col("source_size") * epoch
        words = F.greatest(F.lit(0), F.least(F.col("size"), quota - start)).cast("long")
        turns.append(F.when(words > 0, F.struct(_time_of(start, quota, F.col("source_rank"), ramps).alias("position"), words.alias("words"))))
    placements = F.array_compact(F.array(*turns))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return laid.withColumn("placements", placements).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "placements", *(["row"] if carry else [])
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix as a training sequence: a row per placement, range-sorted by position.

    A document taken in part is given whole; that is one document per source at most.
    """
    return (
        mixed.withColumn("placement", F.explode("placements"))
        .withColumn("position", F.col("placement.position"))
        .withColumn("copy_words", F.col("placement.words"))
        .drop("placement", "placements")
        .orderBy("position", "doc_id")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, in training order, repeats included."""
    ordered = training_order(mix(docs, carry=True))
    return ordered.select("row.*")
