import numpy as np
import pytest

from millrace.operators import vectors as V
from millrace.plans import registry

SCHEMA = "vec_id long, embedding array<float>, cell string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "c") for i, v in rows], SCHEMA)


def _brute(rows, asked, k):
    known = [(i, np.float32(v).astype(float)) for i, v in rows if v is not None]
    out = {}
    for i, q in known:
        if i in asked:
            best = sorted(((-round(float(q @ v), 6), j) for j, v in known if j != i))[:k]
            out[i] = [j for _, j in best]
    return out


def _found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, -r.dot, r.vec_id)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("rows_of, queries_of", [(4_096, 1_024), (30, 7)])
def test_exact_search_in_blocks_equals_brute_force(spark, monkeypatch, rows_of, queries_of):
    """A third of the vectors are equal, so a query has very many ties; some are null."""
    monkeypatch.setattr(V, "BLOCK_ROWS", rows_of)
    monkeypatch.setattr(V, "BLOCK_QUERIES", queries_of)
    rng = np.random.default_rng(2)
    same = rng.normal(size=8)
    rows = [(i, None if i % 41 == 7 else same if i % 3 == 0 else rng.normal(size=8)) for i in range(300)]
    frame = _frame(spark, rows).repartition(3)
    asked = {i for i in range(0, 300, 10)}
    assert _found(V.nearest(frame, frame.where("vec_id % 10 = 0"), 5)) == _brute(rows, asked, 5)
    assert V.nearest(frame, frame.where("false"), 5).count() == V.nearest(frame.where("false"), frame, 5).count() == 0


def _recall(found, exact):
    return sum(len(set(found.get(q, ())) & set(best)) for q, best in exact.items()) / sum(map(len, exact.values()))


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_the_index(spark, sf):
    exact = _found(registry.queries()["p68_vector_topk"](spark, f"/root/testdata/sf{sf}"))
    found = _found(registry.queries()["p69_vector_index"](spark, f"/root/testdata/sf{sf}"))
    assert found.keys() == exact.keys() and _recall(found, exact) >= 0.9


def test_an_index_of_clustered_vectors_looks_into_few_cells(spark):
    """Fitted on a part of the rows only; every row is in it."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, 16))
    rows = [(i, middles[i % 60] + 0.2 * rng.normal(size=16)) for i in range(3_000)]
    frame = _frame(spark, rows)
    V_rows = V.FIT_ROWS
    try:
        V.FIT_ROWS = 1_000
        index = V.fit(frame, 5)
    finally:
        V.FIT_ROWS = V_rows
    table = V.assigned(frame, index)
    assert table.count() == 3_000 and index.probes <= len(index.centres) / 2
    asked = frame.where("vec_id % 20 = 0")
    assert _recall(_found(V.search(index, table, asked, 5)), _brute(rows, set(range(0, 3_000, 20)), 5)) >= 0.9


def test_an_empty_index(spark):
    nothing = _frame(spark, [])
    index = V.fit(nothing, 5)
    assert V.search(index, V.assigned(nothing, index), nothing, 5).count() == 0
    one = _frame(spark, [(1, [1.0, 0.0]), (2, None)])
    index = V.fit(one, 5)
    assert V.search(index, V.assigned(one, index), one, 5).count() == 0
