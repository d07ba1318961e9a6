"""op9_lm_score trains on all training documents, uses context for every code, and fits its weight by likelihood."""

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import lm  # noqa: E402
from millrace.llm.packing import WordIds  # noqa: E402
from millrace.llm.queries import tokenizer_path  # noqa: E402

PATH = tokenizer_path("word_bpe_49k.json")


def test_every_training_document_reaches_the_model(spark):
    word_ids = WordIds(PATH)
    words = [t[:-4] for t, _ in sorted(word_ids.tokenizer.get_vocab().items()) if t.endswith("</w>") and t[:-4].isalpha() and t.isascii()][:2500]
    rows = [(i, w + " " + w, True) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4)
    found = lm.fit(docs, PATH, train_bytes=4000)
    used = np.unique(word_ids([w.encode() for w in words])[0])
    fresh = lm.AttentionModel(found.model.end, np.ones(found.model.end + 1)).p["E"]
    assert len(used) > 2000 and (found.model.p["E"][used] != fresh[used]).any(axis=1).all()


def test_third_code_depends_on_the_context():
    model = lm.AttentionModel(2000, np.arange(2001, 0, -1))
    assert (model.codes[0, :2] == model.codes[lm.FAN**2, :2]).all()
    text = np.array([10, 0, 11, lm.FAN**2] * 8 + [2000])
    model.train(np.tile(text, 2000), np.full(2000, len(text)), epochs=3)
    logs = model.score(text, np.array([len(text)]))
    assert logs[[5, 7]].min() > np.log(0.6)  # without context, one of the two has at most 0.5


def test_weight_is_the_likeliest_whatever_the_number_of_words():
    at = lambda ratio: int(np.rint((ratio + lm.RATIO_MOST) * lm.RATIO_BINS))
    weights = [lm.likeliest({at(-2): 0.7 * n, at(2): 0.3 * n, -1: n}).weight for n in (1e4, 1e8)]
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax(sum(n * np.log(grid + (1 - grid) * np.exp(r)) for r, n in ((-2, 0.7), (2, 0.3))))]
    assert weights == pytest.approx([best, best], abs=0.005)
    assert lm.likeliest({}).weight == pytest.approx(lm.PRIOR_WEIGHT)
