"""op10_ngram_join: classes that share many buckets meet in few of them, and every pair meets."""

import random
from itertools import combinations

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import ngram_join  # noqa: E402


def test_pairs_meet_in_few_of_their_buckets(spark):
    rng = random.Random(5)
    members: dict[int, set[int]] = {}
    for bucket in rng.sample(range(-(1 << 40), 1 << 40), 150):
        # Keys 0 to 29 share nearly all buckets, 30 to 59 few.
        members[bucket] = {k for k in range(60) if rng.random() < (0.9 if k < 30 else 0.02)}
    rows = [(b, k, k // 3, 300, 0, 0, 0, 0) for b, keys in members.items() for k in keys]
    sketch = ", ".join(f"s{i} long" for i in range(ngram_join.SKETCH_WORDS))
    found = ngram_join._meetings(spark.createDataFrame(rows, f"bucket long, key long, root long, size long, {sketch}"), 80).collect()
    meetings = [p for keys in members.values() for p in combinations(sorted(keys), 2) if p[0] // 3 != p[1] // 3]
    assert {(r.a, r.b) for r in found} == set(meetings)
    assert len(meetings) > 40_000 and len(found) < 2 * len(set(meetings))
