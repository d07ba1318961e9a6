"""The opN queries on the smallest tables against brute force written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import queries as llm  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(duck_rows):
    return duck_rows("SELECT doc_id, text, lang, source FROM documents")


@pytest.fixture(scope="module")
def duck_rows(request):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return lambda sql: con.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(llm.queries()[name], llm.oracle_sql()[name])


def test_op1(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(llm.tokenizer_path("word_bpe_49k.json"))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in documents}
    rows = llm.op1_pack(spark, SMALL).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes()) and len(own) == r.length
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for runs, whole in [(pieces[d], len(i)) for d, i in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(runs):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 2048
    sizes = np.array([sum(n for _, n in s) for s in sequences.values()])
    padding = np.where(sizes & (sizes - 1), 2048 - sizes, 0)
    assert padding.sum() < 0.03 * sizes.sum()


def test_op3(spark, documents):
    rows = {r.doc_id: r for r in llm.op3_media(spark, SMALL).collect()}
    assert len(rows) == len(documents)
    by_text = {}
    for d, text, *_ in documents:
        data = (text or "").encode()
        payload = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(text, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)


def test_op4(spark, documents):
    rows = {r.doc_id: r for r in llm.op4_quality(spark, SMALL).collect()}
    for d, text, *_ in documents:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert (r.n_symbols, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", text or "")), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_op4_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = llm.op4_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.97


def test_op5(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = llm.op5_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 24, 0),
)


def test_op7(spark, documents):
    rows = {r.doc_id: r for r in llm.op7_secrets(spark, SMALL).collect()}
    for d, text, *_ in documents:
        spans = [(m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
        written = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = rows[d]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert set(written) <= set(r.spans.split(","))


def test_op8(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = llm.op8_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert np.mean([p == t for p, t in held]) > 0.93


def test_op9(spark, documents):
    rows = {r.doc_id: r for r in llm.op9_lm_score(spark, SMALL).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in documents}
    tokens = {d: [w.lower() for w in (t or "").encode().split()] + [None] for d, t, *_ in documents}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    scores = {r.doc_id: r.predicted for r in llm.op8_toxicity(spark, SMALL).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, p in scores.items() if not p} and clean.columns == columns
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    groups = {r.component_id for r in llm.op10_ngram_join(spark, SMALL).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups) and single.columns == columns
    safe = corpus_pipeline.redact_secrets(spark, docs, SMALL)
    assert safe.columns == columns
    for r in safe.collect():
        assert r.n_chars == len(r.text) and not any(len(m[g]) >= least for _, p, least, g in BASE for m in p.finditer(r.text) if "SECRET" not in m[0])
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    taken = {r.doc_id: -(-r.taken // max(1, r.size)) for r in llm.op2_source_mix(spark, SMALL).collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in taken.items() if n})
    assert corpus_pipeline.run(spark, SMALL).count() > 0
