import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import periodic_runs, queries as llm  # noqa: E402


def brute(words, least=12):
    """Start, length and period of the runs, from every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def _rows(rng, kind, n):
    alphabet = rng.choice([1, 2, 2, 3, 4])
    letters = lambda m: [rng.randrange(alphabet) for _ in range(m)]
    if kind == 0:
        return letters(n)
    if kind == 1:  # the Fibonacci word
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    row = []
    while len(row) < n:
        root = letters(rng.randrange(1, 30)) if kind == 2 else letters(rng.randrange(2, 6)) * 60
        at = rng.randrange(5)
        row += (root * 6)[: rng.randrange(1, 200)] if kind == 2 else root[at : at + rng.randrange(1, 60)]
    return row


@pytest.mark.parametrize("kind", range(4))
def test_runs_equal_those_of_every_period(kind):
    rng = random.Random(kind)
    for _ in range(150):
        row = _rows(rng, kind, rng.randrange(0, 240))
        got = list(zip(*(x.tolist() for x in periodic_runs.runs(np.asarray(row, np.int64)))))
        assert got == brute(row), row


def test_one_root_shifted_at_every_break():
    """Neighbouring runs of one root that overlap by less than it: pairs of their parts repeat as well."""
    rng = random.Random(9)
    for _ in range(150):
        d = rng.randrange(1, 6)
        root, row = [rng.randrange(2) for _ in range(d)], []
        while len(row) < 200:
            at = rng.randrange(d)
            row += (root * 40)[at : at + rng.randrange(1, 50)] + [2] * (rng.random() < 0.3)
        assert list(zip(*(x.tolist() for x in periodic_runs.runs(np.asarray(row, np.int64))))) == brute(row)


def test_long_rows_take_no_more_than_their_length_allows():
    for row in ([0] * 300_000, [bin(i).count("1") % 2 for i in range(60_000)], ([0] * 50 + [1]) * 2_000 + [2] + ([0] * 49 + [1]) * 2_000):
        start, length, period = periodic_runs.runs(np.asarray(row, np.int64))
        assert len(start) <= len(row)
        for a, n, q in zip(start[:50].tolist(), length[:50].tolist(), period[:50].tolist()):
            assert row[a : a + n - q] == row[a + q : a + n]


def test_texts_are_apart_and_edges_have_their_results(spark):
    again = "one two three " * 5
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, again), (4, again), (None, again), (5, "x"), (6, "start " + again + " end"), (7, "a " * 200_000), (8, "b a b")]
    frame = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, runs string, n_words int").coalesce(1)
    found = periodic_runs.find_runs(frame).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    for r in found:
        words = (dict(rows)[r.doc_id] or "").split()
        own = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(words) and own == ([(0, 200_000, 1)] if r.doc_id == 7 else brute(words))
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.find_runs(frame.where("false")).count() == 0


def test_query_equals_its_sql(same):
    same(llm.op11_periodic_runs, llm.OP11_SQL)
