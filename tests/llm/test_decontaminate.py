import random
import re
from collections import Counter

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import decontaminate, queries as llm  # noqa: E402

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, hits string, items int, words string"
ITEMS = "item_id string, text string, words string"


def _words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = _words(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item or "")
    out = []
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc, len(words), len(hit), sorted(found)))
    return Counter(map(repr, out))


def _found(spark, docs, items):
    a = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    rows = decontaminate.find(a, b).collect()
    union = lambda hits: len({i for h in hits for i in range(h.begin, h.end)})
    told = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(a, b).collect())
    assert told == Counter((r.doc_id, r.n_words, union(r.hits), len(r["items"]), bool(r.hits)) for r in rows)
    return Counter(repr((r.doc_id, r.n_words, union(r.hits), r["items"])) for r in rows)


def _cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "é", "ab", "7"] if seed % 2 else [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", "-", ".\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([1, 2, 3, 9, 10, 11, 40])) if seed % 2 == 0 or k > 2 else text(30)) for k in range(12)]
    docs = []
    for d in range(40):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1].split()
            at = rng.randrange(len(words))
            parts += [" ".join(words[at : at + rng.randrange(5, 25)]).upper(), text(rng.randrange(0, 300))]
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_hits_equal_brute_force(spark, seed):
    docs, items = _cases(seed)
    assert _found(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    ten = " ".join(f"k{i}" for i in range(10))
    long = "filler words " * 60_000 + ten + " tail" * 50_000
    items = [("b", ten), ("b", ten), (None, ten), ("e", None), ("f", " .,"), ("g", "Solo"), ("a", ten + " k10")]
    docs = [(None, ten), (1, None), (2, ""), (3, long), (4, ten), (4, ten), (5, "k9 " + ten.upper().replace(" ", "--") + " k10"), (6, "solo\x00SOLO solos"), (7, ten[:-1])]
    assert _found(spark, docs, items) == brute(docs, items)
    assert _found(spark, docs, []) == brute(docs, [])
    assert not _found(spark, [], items)


def test_a_benchmark_of_many_groups_gives_the_same(spark, monkeypatch):
    docs, items = _cases(2)
    items += [("long", " ".join(f"v{i % 977}x{i % 13}" for i in range(5_000)))]
    docs += [(99, " ".join(f"v{i % 977}x{i % 13}" for i in range(2_990, 3_020)))]  # over the border of two pieces
    docs += [docs[-1], (None, docs[-1][1]), (100, None), *[(200 + k, items[0][1]) for k in range(30)]]
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 12_000)
    assert _found(spark, docs, items) == brute(docs, items)


def test_equal_keys_of_unlike_strings_are_told_apart(monkeypatch):
    """With a hash that is always nought every string meets every other."""
    monkeypatch.setattr(decontaminate, "_mixed", lambda h: h * decontaminate.np.uint64(0))
    pieces = [("x", "a b c d"), ("y", "d c b a"), ("z", "a b c d")]
    table = decontaminate.Benchmark(pieces, window=3)
    texts = ["a b c a d c b", "c b a", "b c"]
    got = table.search([t.encode().split() for t in texts])
    assert [([tuple(map(int, h)) for h in hits], [table.ids[k] for k in own]) for hits, own in got] == [([(0, 3), (4, 7)], ["x", "y", "z"]), ([(0, 3)], ["y"]), ([], [])]


def test_query_equals_its_sql(same):
    same(llm.op12_decontaminate, llm.OP12_SQL)
