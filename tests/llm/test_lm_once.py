"""op9_lm_score tokenizes the training documents once, and its gradients are those of its loss."""

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import lm  # noqa: E402
from millrace.llm.packing import WordIds  # noqa: E402
from millrace.llm.queries import tokenizer_path  # noqa: E402

PATH = tokenizer_path("word_bpe_49k.json")


def test_rounds_read_the_ids_of_every_training_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "train_round", lambda model, texts, *rest: seen.extend(texts.select("ids", "lengths").collect()) or 0)
    texts = [f"Some  words{i % 7} and\t{i}, Zażółć {'x' * i}" for i in range(60)] + ["", " ", None, "Some words", "Some words"]
    docs = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(3)
    model = lm.fit(docs, PATH, block_bytes=500).model
    got = []
    for row in seen:
        lengths = np.frombuffer(row["lengths"], np.int64)
        got += np.split(np.frombuffer(row["ids"], np.uint16), np.cumsum(lengths)[:-1])
    encode = lambda t: WordIds(PATH).tokenizer.encode(t.lower(), add_special_tokens=False).ids
    want = [[*encode(t), model.end] for i, t in enumerate(texts) if i % 3 > 0 and t is not None]
    assert sorted(ids.tolist() for ids in got) == sorted(want)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    model = lm.AttentionModel(3000, rng.integers(0, 9, 3001) ** 3)
    texts = [np.append(np.minimum(rng.zipf(1.3, n), 3000) - 1, 3000) for n in (0, 1, 15, 40, 90, 900)]
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    model.train(np.tile(ids, 10), np.tile(lengths, 10), epochs=1)
    found = model._gradients(ids, *lm.windows_of(lengths))
    loss = lambda: -model.score(ids, lengths).astype(float).mean()
    for name, value in model.p.items():
        full = np.zeros_like(value)
        if name in lm.ROWED:
            full[found[name][0]] = found[name][1]
        else:
            full[:] = found[name]
        way, before = full / np.sqrt((full**2).sum()), value.copy()
        ends = []
        for sign in (1, -1):
            model.p[name] = (before + sign * np.float32(0.02) * way).astype(np.float32)
            ends.append(loss())
        model.p[name] = before
        assert (ends[0] - ends[1]) / 0.04 == pytest.approx((full * way).sum(), rel=0.05, abs=2e-5), name


def test_blocks_are_dealt_evenly_to_tasks(spark):
    docs = spark.createDataFrame([(i, f"words {i} of a text", True) for i in range(4000)], "doc_id long, text string, train boolean")
    found = lm.fit(docs, PATH, block_bytes=8000)
    per_task = found.dealt.rdd.mapPartitions(lambda rows: [len({r["block"] for r in rows})]).collect()
    assert found.n_blocks > 8 and per_task == [1] * found.n_blocks
