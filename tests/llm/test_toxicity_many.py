"""op8_toxicity learns insults of three letters and of other scripts."""

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import toxicity  # noqa: E402


def test_short_insults_and_those_of_other_scripts_count():
    insults = ["zuk", "дурашка", "κοπρίτης", "blorftwit"]
    bad = [f"well {i} you {w} please go on reading" for w in insults for i in range(12)]
    good = [f"well {i} you kindly please go on reading" for i in range(12 * len(insults))]
    machine = toxicity.train([t.encode() for t in bad + good], np.repeat([1, 0], len(good)))
    p = machine.probability(machine.documents(toxicity.Likeness(machine.landmarks), [f"you {w}!".encode() for w in [*insults, "fellow"]]))
    assert (p[:-1] > 0.5).all() and p[-1] < 0.5


def test_calibration_is_the_best_logistic():
    rng = np.random.default_rng(5)
    for gap in (0.2, 3.0):  # overlapping kinds, and kinds that a threshold parts
        y = np.repeat([1, -1], [15, 200])
        margins = rng.normal(0, 0.4, len(y)) + gap * y
        slope, offset = toxicity._platt(margins, y)
        best = toxicity.platt_loss(margins, y, slope, offset)
        grid = [(a, b) for a in np.linspace(-2, 40, 85) for b in np.linspace(-20, 20, 81)]
        assert best <= min(toxicity.platt_loss(margins, y, a, b) for a, b in grid) + 1e-9
        assert np.isfinite([slope, offset]).all() and abs(slope) < 50


def test_chance_bound_counts_the_expected_false_passes():
    from math import comb

    tails = toxicity._tails(4, 10, 68, toxicity._log_choose(68))
    exact = [sum(comb(10, k) * comb(58, 4 - k) for k in range(c, 5)) / comb(68, 4) for c in range(5)]
    assert np.allclose(tails, exact)
    rng = np.random.default_rng(1)
    totals = rng.integers(2, 9, 4000)
    hits = rng.hypergeometric(10, 58, totals)
    p, bound = toxicity.chance_bound(totals, hits, 10, 68)
    assert (p <= bound).sum() <= 5  # nothing to find
    totals, hits = np.append(totals, [9] * 8), np.append(hits, [9] * 8)
    p, bound = toxicity.chance_bound(totals, hits, 10, 68)
    assert (p[-8:] <= bound).all()


def test_many_unlike_insults_and_stems_with_endings_are_all_learned():
    rng = np.random.default_rng(2)
    syllables = ["ba", "do", "ke", "li", "mu", "ne", "po", "ra", "si", "tu", "va", "zo"]
    word = lambda n: "".join(rng.choice(syllables, n))
    insults = [f"qx{a}{b}" for a in "aeiou" for b in ("rk", "lm", "gn", "bd", "ft", "wz", "sk", "np")]
    said = lambda w: " ".join([word(2) for _ in range(6)] + [w] + [word(3) for _ in range(6)]) + "."
    bad = [said(w + word(1)) for w in insults for _ in range(25)]
    good = [said(word(3)) for _ in range(3 * len(bad))]
    machine = toxicity.train([t.encode() for t in bad + good], np.repeat([1, 0], [len(bad), len(good)]))
    p = machine.probability(machine.documents(toxicity.Likeness(machine.landmarks), [said(w + word(2)).encode() for w in insults]))
    clean = machine.probability(machine.documents(toxicity.Likeness(machine.landmarks), [said(word(3)).encode() for _ in range(200)]))
    assert (p > 0.5).mean() > 0.9 and (clean < 0.5).mean() > 0.98


def test_copies_are_no_evidence():
    passage = "one long and quite harmless passage with a rare wombatish remark in the midst of many other plain words that go on and on"
    bad = [f"say {i} {passage}" for i in range(30)] + [f"text {i} calls somebody a grubnik number {i}" for i in range(30)]
    good = [f"text {i} calls somebody a neighbour number {i}" for i in range(200)]
    y = np.repeat([1, -1], [len(bad), len(good)])
    stems = toxicity.telling_stems([t.encode() for t in bad + good], y)
    assert any(s.startswith(b"gru") for s in stems) and not any(s.startswith(b"wom") for s in stems)
