"""op5_langid lists every language with evidence, however many."""

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import langid  # noqa: E402


def test_seven_languages_of_a_document_are_all_found(spark):
    letters = ["abc", "def", "ghi", "jkl", "mno", "pqr", "stu"]
    texts = [" ".join(x[i % 3] + x[i // 3 % 3] + x[i * i % 3] for i in range(200)) for x in letters]
    known = spark.createDataFrame([(i, t, f"l{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(9, " ".join(texts), None)], "doc_id long, text string, lang string")
    (row,) = langid.predict(asked, langid.fit(known)).collect()
    shares = {x["lang"]: x["share"] for x in row.languages}
    assert set(shares) == {f"l{i}" for i in range(7)} and all(0.1 < s < 0.2 for s in shares.values()) and row.score < 0.2
