"""The pipeline keeps one row of each group, whatever the ids, and packs in training order over several files."""

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import mixing, ngram_join  # noqa: E402

SMALL = "/root/testdata/sf0.001"
A, B = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
SCHEMA = "doc_id long, text string, source string"


def test_one_row_of_each_group_whatever_the_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(3, B, "x"), (7, A, "y"), (7, B, "z"), (None, B, "q"), (9, A.upper(), "y"), (7, A, "w"), (7, A, "y")]
    empty = [(None, "", "e"), (None, "", "e"), (1, None, None), (1, "", None), (1, "", "x")]
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows + empty, SCHEMA).repartition(3), SMALL).collect()
    worded = sorted((r.doc_id, r.text) for r in kept if r.text)
    assert worded == [(3, B), (7, A)]
    assert sorted(map(repr, (tuple(r) for r in kept if not r.text))) == sorted(map(repr, set(empty)))
    again = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows[::-1] + empty, SCHEMA), SMALL).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, again))


def test_packed_order_is_the_training_order(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [r.doc_id for r in mixing.training_order(mixing.mix(docs)).select("doc_id").collect()]
    # Files of very unlike sizes, which Spark reads the largest first.
    mixed = pipeline.mix_sources(spark, docs, SMALL).coalesce(1)
    numbered = mixed.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(mixed.schema.add("n", "long"))
    for number, (low, high) in enumerate([(0, 20), (20, len(want) - 5), (len(want) - 5, len(want))]):
        part = tmp_path / str(number)
        numbered.where(f"n >= {low} AND n < {high}").orderBy("n").coalesce(1).drop("n").write.parquet(str(part))
        (tmp_path / "docs").mkdir(exist_ok=True)
        next(part.glob("part-00000*.parquet")).rename(tmp_path / "docs" / f"part-{number:05d}-x.parquet")
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert [r.doc_id for r in read.select("doc_id").collect()] != want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks for so little text
    try:
        pieces = pipeline.pack_sequences(spark, read, SMALL).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p.sequence_id >> 32 for p in pieces}) > 1
    pieces.sort(key=lambda p: (p.sequence_id, p.offset))
    assert [p.doc_id for p in pieces if p.start == 0] == want


def test_packed_bitmap():
    import numpy as np

    held = np.zeros(4, np.int64)
    slots = np.array([0, 63, 64, 130, 255])
    for s in slots.tolist():
        held[s >> 6] |= np.int64(np.uint64(1 << (s & 63)).view(np.int64))
    assert np.flatnonzero(ngram_join._is_held(held, np.arange(256))).tolist() == slots.tolist()
