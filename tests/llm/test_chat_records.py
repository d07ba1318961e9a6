import json

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import chat  # noqa: E402

PARTS = [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]
PICTURE = [{"type": "text", "text": "see"}, {"type": "image", "url": "x"}]
SAYS = [
    ({"messages": [{"role": "user", "content": "a", "name": "n"}], "id": 7, "meta": {"k": [1]}}, [("user", "a")], 0),
    ({"messages": []}, [], 0),
    ({"messages": [{"role": "user", "content": PARTS}, {"role": "assistant", "content": "c"}]}, [("user", "ab"), ("assistant", "c")], 0),
    ({"messages": [{"role": "user", "content": PICTURE}]}, [("user", json.dumps(PICTURE))], 0),
    ({"messages": [{"role": "user", "content": None}, {}]}, [("user", ""), ("", "")], 0),
    ({"messages": ["a"]}, [], 1),
    ({"prompt": "a", "completion": "b", "score": 0.5}, [("user", "a"), ("assistant", "b")], 0),
    ({"prompt": "a", "completion": "b", "response": "c"}, [], 1),
    ({"other": 1}, [], 1),
    (None, [], 1),
]


def test_no_conversation_is_lost(spark):
    rows = [(k, 0, None if record is None else json.dumps(record)) for k, (record, _, _) in enumerate(SAYS)]
    rows += [(100, 0, json.dumps({"prompt": "a", "response": "b"})), (100, 1, "{"), (100, 2, json.dumps({"messages": []}))]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, position long, record string"))
    found = {r.conv_id: (r.n_turns, r.unmapped) for r in chat.digests(turns).collect()}
    assert found == {k: (len(said), lost) for k, (_, said, lost) in enumerate(SAYS)} | {100: (2, 1)}
    told = [(r.conv_id, r.item, r.role, r.text) for r in turns.where("item IS NOT NULL AND conv_id < 100").collect()]
    assert sorted(told) == [(k, i, *turn) for k, (_, said, _) in enumerate(SAYS) for i, turn in enumerate(said)]
