"""The kernel against its definition, and what it tolerates once it is trained on labelled documents."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import toxicity  # noqa: E402

ENGLISH = "trash pathetic worthless disgusting idiot loser moron clown scum stupid".split()


def _vector(word):
    """Every subsequence of three letters with the sum of DECAY to the power of its spans."""
    out = {}
    for places in combinations(range(len(word)), 3):
        span = places[-1] - places[0] + 1
        if span <= toxicity.SPAN:
            key = tuple(word[i] for i in places)
            out[key] = out.get(key, 0.0) + toxicity.DECAY**span
    return out


def _like(a, b):
    x, y = _vector(a), _vector(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm if norm else 0.0


def _brute(word, landmark):
    parts = [word, *(word[:n] for n in range(len(landmark), len(landmark) + toxicity.SLACK + 1))]
    return min(1.0, max(_like(p, landmark) for p in parts)) ** toxicity.POWER


def test_kernel_equals_the_sum_over_subsequences():
    rng = random.Random(6)
    landmarks = ["idiot", "aba", "mmmoron", "worthless", "abcabcabc"]
    words = landmarks + ["".join(rng.choice("abcidtomrn") for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    got = toxicity.Landmarks.of([w.encode() for w in landmarks]).kernel([w.encode() for w in words])
    want = np.array([[_brute(w, m) for m in landmarks] for w in words])
    assert np.abs(got - want).max() < 1e-4
    floored = toxicity.Landmarks.of([w.encode() for w in landmarks]).kernel([w.encode() for w in words], toxicity.FLOOR)
    sure = np.abs(want - toxicity.FLOOR**toxicity.POWER) > 1e-3
    assert np.abs(floored - np.where(want < toxicity.FLOOR**toxicity.POWER, 0, want))[sure].max() < 1e-4


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").select("doc_id", "toxic", "text").orderBy("doc_id").collect()
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows])
    texts, y = [(r.text or "").encode() for r in rows], np.array([r.toxic for r in rows])
    machine = toxicity.train([t for t, h in zip(texts, held) if not h], y[~held])
    return machine, [t for t, h in zip(texts, held) if h], y[held]


def _rejected(machine, texts):
    return machine.probability(machine.documents(toxicity.Likeness(machine.landmarks), texts)) >= 0.5


def test_held_out_documents(trained):
    machine, texts, y = trained
    found = _rejected(machine, texts)
    assert (found & (y > 0)).sum() / found.sum() > 0.9 and (found & (y > 0)).sum() / y.sum() > 0.85


def test_varied_insults_alone_in_a_sentence(trained):
    machine = trained[0]
    rng = random.Random(0)
    said = lambda words: _rejected(machine, [f"he was really {w} there.".encode() for w in words]).mean()
    put_in = [w[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i:] for w in ENGLISH for i in range(1, len(w)) for _ in range(4)]
    left_out = [w[:i] + w[i + 1 :] for w in ENGLISH for i in range(len(w))]
    # Signs at a word's edges count as punctuation, so only those inside stand for letters.
    alike = [w[0] + w[1:-1].replace("i", "1").replace("o", "0").replace("s", "$") + w[-1] for w in ENGLISH] + [" ".join(w) for w in ENGLISH]
    assert said(ENGLISH) == 1.0 and said(alike) == 1.0
    assert said(put_in) >= 0.8 and said(left_out) >= 0.6
