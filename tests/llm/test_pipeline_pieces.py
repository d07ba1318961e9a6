"""The pieces of the pipeline's result against its stages: every document of the mix, whole, as often as it is taken."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm.packing import END_ID, WordIds  # noqa: E402
from millrace.llm.queries import tokenizer_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_run_packs_just_what_its_stages_keep(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    word_ids = WordIds(tokenizer_path("word_bpe_49k.json"))
    mixed = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = Counter((d, (*word_ids([t])[0].tolist(), END_ID)) for d, t in mixed)

    rows = corpus_pipeline.run(spark, SMALL).collect()
    room, pieces = defaultdict(list), defaultdict(Counter)
    for r in rows:
        room[r.sequence_id].append((r.offset, r.length))
        ids = tuple(int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4))
        pieces[r.doc_id][r.start, ids] += 1
    for held in room.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    for (doc, ids), n in want.items():
        covered = Counter()
        for (start, own), times in pieces[doc].items():
            assert ids[start : start + len(own)] == own
            covered.update({i: times for i in range(start, start + len(own))})
        assert covered == Counter({i: n for i in range(len(ids))})
    assert set(pieces) == {d for d, _ in want}
