"""The cuts of packing against every cover of short streams."""

import numpy as np

from millrace.llm import packing


def cost_of(cuts, penalty_at, capacity):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        size = b - a
        padding = 0 if size & (size - 1) == 0 else capacity - size
        total += padding + penalty_at[b] + packing.WINDOW_COST
    return total


def covers(points, capacity):
    """All ways to cover the stream by windows between cut points."""

    def on(at):
        if at == len(points) - 1:
            yield [points[at]]
            return
        for to in range(at + 1, len(points)):
            if points[to] - points[at] > capacity:
                break
            for rest in on(to):
                yield [points[at], *rest]

    return on(0)


def test_cuts_are_cheapest():
    rng = np.random.default_rng(5)
    for capacity in (16, 32, 64):
        for _ in range(40):
            points = np.concatenate([[0], np.cumsum(rng.integers(1, capacity // 2, rng.integers(2, 12)))]).astype(np.int64)
            penalty = rng.choice([0, packing.SENTENCE_PENALTY, packing.HARD_PENALTY], len(points)).astype(np.int64)
            penalty[0] = penalty[-1] = 0
            penalty_at = dict(zip(points.tolist(), penalty.tolist()))
            found = packing.best_cuts(points, penalty, capacity).tolist()
            assert found[0] == 0 and found[-1] == points[-1]
            assert all(0 < b - a <= capacity for a, b in zip(found, found[1:]))
            least = min(cost_of(c, penalty_at, capacity) for c in covers(points.tolist(), capacity))
            assert cost_of(found, penalty_at, capacity) == least
