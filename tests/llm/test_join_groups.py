"""op10_ngram_join: large groups of near copies, and passages that many unlinked texts share, against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import ngram_join  # noqa: E402


def texts_of(seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=120)
    near = []
    for _ in range(300):  # pairwise likeness on both sides of the threshold
        own = base[:]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        near.append(" ".join(own))
    passage = rng.choices(words, k=55)
    sharing = [" ".join(rng.choices(words, k=rng.randrange(30, 160)) + passage + rng.choices(words, k=20)) for _ in range(300)]
    return near + sharing + [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(60)]


def brute(texts: list[str]) -> list[int]:
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_groups_and_shared_passages_lose_no_link(spark):
    texts = texts_of()
    rows = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in rows)] == brute(texts)


def test_linked_sets_share_one_more_signature_than_they_may_drop():
    texts = [t.encode() for t in texts_of(8)[:360]]
    flat, ends = ngram_join.Shingler(5)(texts)
    signature, owner, allowance = ngram_join.signatures(flat, ends)
    family, drop = allowance >> ngram_join.FAMILY_BITS, allowance & (ngram_join.FAMILY - 1)
    own = [{} for _ in texts]
    for s, o, f, d in zip(signature.tolist(), owner.tolist(), family.tolist(), drop.tolist()):
        own[o].setdefault(f, (d, set()))[1].add(s)
    sets = [set(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                common = [(max(own[i][f][0], own[j][f][0]), len(own[i][f][1] & own[j][f][1])) for f in own[i].keys() & own[j].keys()]
                assert any(shared > drop for drop, shared in common)
    assert linked > 300 and np.mean(drop) > 1
