"""op8_toxicity and pipeline: the machine is trained in a task, so its texts and working memory stay off the driver."""

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import toxicity  # noqa: E402


def test_training_is_not_done_on_the_driver(spark, monkeypatch):
    texts = [(i, f"alpha{i} beta gamma{i % 7} " + ("zornig delta" if i % 3 == 0 else "friendly")) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    here = toxicity.train(*_training(docs, held))

    def refuse(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(toxicity, "train", refuse)
    there = toxicity.fit(docs, labels)
    assert there.scale == pytest.approx(here.scale)
    assert there.weights == pytest.approx(here.weights)


def _training(docs, held):
    import numpy as np

    rows = docs.selectExpr("doc_id", "text", "xxhash64(doc_id) AS h").orderBy("h").collect()
    rows = [r for r in rows if r.doc_id not in held]
    return [r.text.encode() for r in rows], np.array([int(r.doc_id % 3 == 0) for r in rows])
