import random
import time

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import secret_scan  # noqa: E402


def by_marks(places, taken):
    """The stretches outside, from a mark for every offset."""
    marks = [0] * 402
    for a, b in places:
        marks[a:b] = [1] * (b - a)
    for a, _, b in taken:
        marks[a:b] = [0] * (b - a)
    return {i for i, m in enumerate(marks) if m}


@pytest.mark.parametrize("seed", range(200))
def test_outside_equals_marks(seed):
    rng = random.Random(seed)
    spans = [(a, a + rng.randrange(1, 40)) for a in (rng.randrange(360) for _ in range(rng.randrange(12)))]
    taken = sorted((a, rng.randrange(3), a + rng.randrange(1, 30)) for a in (rng.randrange(360) for _ in range(rng.randrange(12))))
    got = secret_scan._outside(spans, taken)
    assert {i for a, b in got for i in range(a, b)} == by_marks(spans, taken)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_a_long_text_full_of_spans_is_scanned_within_seconds():
    rng = random.Random(1)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    text = " ".join(f"password={''.join(rng.choices(signs, k=20))} {''.join(rng.choices(signs, k=40))}" for _ in range(29_000))
    began = time.perf_counter()
    base = secret_scan.base_spans(text)
    assert len(text) > 2_000_000 and len(base) == 29_000 and len(secret_scan.random_spans(text, base)) > 20_000
    assert time.perf_counter() - began < 30
