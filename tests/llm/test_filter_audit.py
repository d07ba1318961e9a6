import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import filter_audit, queries as llm  # noqa: E402

DOCS = "doc_id long, text string, lang string, part string, mask int, digest string, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def _fails(docs):
    smallest = {}
    for doc, text, _ in docs:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    for doc, text, lang in docs:
        text = text or ""
        words = [w.decode() for w in text.encode().split()]
        own = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)]
        own += [any(c in "#$%&*|" for c in text), doc is not None and doc > smallest[text]]
        yield doc, lang or "", {f for f, x in zip("ABCDE", own) if x}


def brute(docs, labels):
    good, toxic = ({d for d, *flags in labels if flags[k] == 1 and d is not None} for k in (0, 1))
    parts = defaultdict(list)
    for doc, part, own in _fails(docs):
        parts[part].append((own, doc in good, doc in toxic))
    rows = []
    for part, own in parts.items():
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            there = own
            for step, f in enumerate(order, 1):
                gone = [x for x in there if f in x[0]]
                left = [x for x in there if f not in x[0]]
                failing = sum(f in x[0] for x in own)
                unique = sum(x[0] == {f} for x in own)
                lines.append(("".join(order), step, len(left), len(gone), failing - len(gone), unique, sum(x[1] for x in gone), sum(x[2] for x in gone), f))
                shapley[f] += len(gone)
                there = left
        rows += [(part, *line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(rows)


def _got(spark, docs, labels):
    a = spark.createDataFrame([(d, t, lang, "p", 9, "x", "q") for d, t, lang in docs], DOCS)
    b = spark.createDataFrame([(*row, "t") for row in labels], LABELS)
    return sorted(map(tuple, filter_audit.audit(a, b).collect()))


def _text(rng):
    words = [rng.choice(["w", "W", "été", "UP"]) + str(rng.randrange(rng.choice([5, 4000]))) for _ in range(rng.choice([0, 1, 99, 100, 101, 250]))]
    return rng.choice(["", " ", "\t\n"]) + rng.choice([" ", "\v\r"]).join(words) + rng.choice(["", "", "#", " | "])


@pytest.mark.parametrize("seed", range(2))
def test_audit_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [_text(rng) for _ in range(25)] + [None, ""]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "fr", "", None])) for _ in range(120)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    assert _got(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(150_000))
    docs = [(3, long, "en"), (1, long, "de"), (1, long, "de"), (None, long, None), (None, None, None), (2, "A" * 9, "")]
    labels = [(3, 1, 1), (3, 1, 1), (3, 0, None), (None, 1, 1)]
    assert _got(spark, docs, labels) == brute(docs, labels)
    assert _got(spark, docs, []) == brute(docs, [])
    assert _got(spark, [], labels) == []


def test_rows_are_whole_and_no_python_runs(spark):
    frame = llm.op13_filter_audit(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
    rows = frame.collect()
    assert len(rows) == 600 * len({r.part for r in rows}) and {r.step for r in rows} == {1, 2, 3, 4, 5}


def test_query_equals_its_sql(same):
    same(llm.op13_filter_audit, llm.OP13_SQL)
