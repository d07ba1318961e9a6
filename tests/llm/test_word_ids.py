"""Ids of words tokenized many in a call, against the tokenizer on each word alone."""

import random

import pyarrow.parquet as pq

from millrace.llm.packing import WordIds
from millrace.llm.queries import tokenizer_path

SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    found = sorted({w for t in texts if t for w in t.split()})
    rng = random.Random(5)
    made = ["".join(rng.choice("abzAßéÿªµº" + SIGNS + "9²́Ωж中") for _ in range(rng.randrange(1, 9))) for _ in range(5_000)]
    return found + made + [f"don{s}" for s in SIGNS] + [f"don{s}t" for s in SIGNS] + ["it's", "a'S", "b</w>", "c<|endoftext|>", "d<|", "e...,,", "f''"]


def test_ids_of_many_words_are_those_of_each():
    word_ids = WordIds(tokenizer_path("word_bpe_49k.json"))
    words = _words()
    ids, counts = word_ids.encode(words)
    want = [word_ids.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_words_with_signs_behind_them_share_calls():
    word_ids = WordIds(tokenizer_path("word_bpe_49k.json"))
    texts = []

    class Counted:
        def encode_batch_fast(self, batch, **given):
            texts.extend(batch)
            return inner.encode_batch_fast(batch, **given)

    inner, word_ids.tokenizer = word_ids.tokenizer, Counted()
    ids, counts = word_ids.encode([f"wort{'abc'[i % 3]}{'.,;:!?&&'[i % 8]}" for i in range(512)])
    assert len(texts) == 2 and len(counts) == 512 and counts.sum() == len(ids)
