"""Vectorised code against plain loops of the same definitions."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import langid, lm, mixing, quality  # noqa: E402


def test_attention_scores_equal_a_loop_over_ids():
    rng = np.random.default_rng(4)
    model = lm.AttentionModel(300, rng.integers(0, 50, 301))
    texts = [np.append(rng.integers(0, 300, n), 300) for n in (0, 1, 15, 16, 17, 40, 90)]
    model.train(np.concatenate(texts), np.asarray([len(t) for t in texts]), epochs=2)
    got = model.score(np.concatenate(texts), np.asarray([len(t) for t in texts]))
    p, want = model.p, []
    for text in texts:
        before = np.append(model.end, text[:-1])
        for i, target in enumerate(text):
            begin = i // lm.STRIDE * lm.STRIDE
            low = max(0, begin - lm.CONTEXT)
            place = np.arange(low, i + 1) - begin + lm.CONTEXT
            x = p["E"][before[low : i + 1]] + p["P"][place]
            weights = np.exp(x @ p["K"] @ (x[-1] @ p["Q"]) * lm.DIM**-0.5)
            h = x[-1] + (weights / weights.sum()) @ (x @ p["V"]) @ p["O"]
            h = h + np.maximum(h @ p["U"] + p["u"], 0) @ p["D"]
            c1, c2, c3 = model.codes[target]
            logs = 0.0
            for z, c in (
                (h @ p["W1"] + p["b1"], c1),
                ((h * p["G2"][c1]) @ p["W2"] + p["b2"][c1], c2),
                ((h * p["G3"][c1 * lm.FAN + c2]) @ p["W3"] + p["b3"][c1 * lm.FAN + c2], c3),
            ):
                logs += z[c] - np.log(np.exp(z).sum())
            want.append(logs)
    assert np.abs(got - np.array(want)).max() < 1e-3


def test_trees_equal_a_recursive_walk():
    rng = np.random.default_rng(1)
    x = rng.random((500, 5))
    trees = quality.fit_trees(x, (x[:, 0] + x[:, 3] + 0.2 * rng.random(500) > 1).astype(float), [1, 0, 0, 1, -1])

    def walk(t, node, depth, row):
        if depth == trees.depth:
            return trees.value[t, node]
        right = row[trees.feature[t, node]] > trees.threshold[t, node]
        return walk(t, 2 * node + (2 if right else 1), depth + 1, row)

    want = [trees.base + sum(walk(t, 0, 0, row) for t in range(len(trees.feature))) for row in x[:80]]
    assert np.allclose(trees.margin(x[:80]), want)


def _mixture(like, count, members):
    """Proportions and log likelihood by very many plain steps from equal shares."""
    share = np.full(len(members), 1 / len(members))
    for _ in range(3_000):
        part = like[members] * share[:, None]
        share = ((part / part.sum(axis=0)) * count).sum(axis=1) / count.sum()
    return share, (count * np.log((like[members] * share[:, None]).sum(axis=0))).sum()


def test_mixtures_equal_the_best_of_all_subsets():
    """Three to four languages of made-up words: the set with the best penalised likelihood, and its proportions."""
    rng = random.Random(2)
    words = {lang: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)] for lang, letters in (("a", "abcdefg"), ("b", "hijklmn"), ("c", "opqrstu"), ("d", "vwxyzab"))}
    logs = np.zeros((4, 1 << langid.SLOT_BITS)) + langid.SMOOTHING
    for row, own in enumerate(words.values()):
        _, slot, count = langid.slots_of([" ".join(own * 20).encode()])
        np.add.at(logs[row], slot, count)
    model = langid.Model(list(words), np.log(logs / logs.sum(axis=1, keepdims=True)).astype(np.float32))
    texts = []
    for wanted in (("a",), ("b", "c"), ("a", "b", "c"), ("d", "a"), ("a", "b", "c", "d")):
        texts.append(" ".join(rng.choice(words[lang]) for lang in wanted for _ in range(25)).encode())
    shares, chosen = langid.mixtures(model, texts)
    for text, share, own in zip(texts, shares, chosen):
        _, slot, count = langid.slots_of([text])
        like = np.exp(model.log_p[:, slot].astype(float))
        best = None
        for n in range(1, 5):
            for members in itertools.combinations(range(4), n):
                found, value = _mixture(like, count, list(members))
                value -= langid.PENALTY * np.log(max(count.sum(), 2)) * n
                if best is None or value > best[0]:
                    best = value, members, found
        assert tuple(np.flatnonzero(own)) == best[1]
        assert np.abs(share[list(best[1])] - best[2]).max() < 0.02


def test_positions_of_the_mix_invert_the_demand(spark):
    """The demand up to a document's position, by numeric integration of its source's schedule, is what lies before it."""
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(120)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for rank, source in enumerate("abc"):
        own = [r for r in mixed if r.source == source]
        quota = round(own[0].target)
        low, high = mixing.RAMPS[rank % len(mixing.RAMPS)]
        grid = np.linspace(0, 1, 200_001)
        rate = low + (high - low) * grid
        demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid))])
        demand *= quota / demand[-1]
        turns = sorted((p.position, p.words) for r in own for p in r.placements)
        before = 0
        for position, words in turns:
            assert abs(np.interp(position, grid, demand) - before) < 0.01 + 1e-4 * quota
            before += words
        assert before == quota
    order = mixing.training_order(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and len(order) == sum(len(r.placements) for r in mixed)
