from millrace.llm import lm
from millrace.llm.queries import tokenizer_path


def test_what_a_step_has_shuffled_is_released_before_the_next(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(lm, "release", lambda _: steps.append("release"), raising=False)
    monkeypatch.setattr(lm, "train_round", lambda *given: steps.append("train") or 0)
    docs = spark.createDataFrame([(i, f"some words {i % 7} and {i}", True) for i in range(200)], "doc_id long, text string, train boolean")
    lm.fit(docs, tokenizer_path("word_bpe_49k.json"))
    assert steps == ["release", *["train"] * lm.ROUNDS, "release", "train", "release"]
