"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import json
from collections import Counter, defaultdict

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import chat, langid, lm, media, mixing, ngram_join, packing, quality, secret_scan, toxicity  # noqa: E402
from millrace.llm.queries import tokenizer_path  # noqa: E402

#: Names that the operators use inside.
EXTRAS = ("size", "key", "position", "row", "source_size", "signature", "block", "train", "order_key", "text_hash", "fit_id", "first_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRAS)
PROSE = " ".join(f"word{i % 61} and{i % 17}." for i in range(90))
LONG = " ".join(f"token{i * i % 4001}" for i in range(120_000))
ROWS = [
    (None, None, None, None),
    (1, "", "en", "a"),
    (2, None, None, "b"),
    (3, LONG, "en", "a"),
    (4, PROSE, "en", None),
    (5, PROSE, "fr", "b"),
    (6, PROSE + " tail", "en", "b"),
    (6, PROSE + " tail", "en", "b"),
    (7, " \t\n\v\f\r ", None, "c"),
    (8, "   \U0001f600 été 12", "fr", "a"),
    (9, "password = hunter2hunter2", "en", "a"),
    (10, "two words", "en", "b"),
    (11, "two words", "en", "b"),
    (None, "two  WORDS", "en", "c"),
]


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), *["x"] * len(EXTRAS)) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, ROWS)


@pytest.fixture(scope="module")
def nothing(spark):
    return _frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (4, None, None), (4, 1, 0), (4, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")


IDS = Counter(r[0] for r in ROWS)


def _ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_pack(docs, nothing):
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    whole = defaultdict(int)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0 and r.start + r.length <= r.doc_tokens
        whole[r.doc_id] += r.length
    assert set(whole) == set(IDS) and whole[1] == whole[2] == whole[7] == 1 and whole[4] == whole[5] and whole[3] > 120_000
    assert packing.pack(nothing, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_mix(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert all(r.taken == 0 and not r.placements for r in rows if r.size == 0)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    assert set(by_source) == {"a", "b", "c", None}
    for own in by_source.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)} and abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert mixing.mix(nothing).count() == 0


def test_media(docs, nothing):
    rows = media.through_archive(docs).collect()
    assert Counter(r.key for r in rows) == Counter(None if d is None else str(d) for d in IDS.elements())
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) for r in rows)
    assert media.through_archive(nothing).count() == 0


def test_a_damaged_member_is_read_again_alone(spark, tmp_path, monkeypatch):
    payloads = [(str(i), bytes([i]) * 64) for i in range(5)]
    media.store(spark.createDataFrame(payloads, media.WRITE_SCHEMA).coalesce(1), str(tmp_path))
    reader = media.ArchiveReader(str(tmp_path), 200)
    true_read, calls = media._member, Counter()

    def failing(fs, path, info):
        calls[info.header_offset] += 1
        if info.header_offset and calls[info.header_offset] == 1:
            raise OSError("lost")
        return true_read(fs, path, info)

    monkeypatch.setattr(media, "_member", failing)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted((k, media.decode_png(m)) for k, m in got) == payloads
    assert sorted(calls.values()) == [1, 2, 2, 2, 2]


def test_quality(docs, nothing, labels):
    rows = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in rows) == IDS and all(not r.kept for r in rows if r.base_failed)
    assert {r.base_failed for r in rows if r.doc_id in (None, 1, 2, 7)} == {True}
    empty = quality.judge(nothing, quality.fit(nothing, labels.where("false")))
    assert empty.count() == 0


def test_trees_are_monotone_where_asked():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    trees = quality.fit_trees(x, (x[:, 0] + 0.3 * rng.random(600) > 0.6).astype(float), [-1, 0, 1])
    base = rng.random((200, 3))
    for feature, sign in ((0, -1), (2, 1)):
        higher = base.copy()
        higher[:, feature] += 0.2
        assert (sign * (trees.margin(higher) - trees.margin(base)) >= -1e-9).all()


def test_langid(docs, nothing):
    rows = langid.predict(docs, langid.fit(docs)).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    assert all((r.lang_pred == "und" and r.score == 0) for r in rows if r.doc_id in (1, 2, 7))
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, langid.fit(docs)).count() == 0


def test_a_mixed_document_has_both_languages(spark):
    english, french = "the quick brown fox and the lazy dog were there with them ", "le renard brun et le chien sont dans la maison avec eux "
    known = _frame(spark, [(1, english * 20, "en", "a"), (2, french * 20, "fr", "a")])
    asked = _frame(spark, [(3, english * 3 + french * 3, None, "a"), (4, english * 3, None, "a")])
    rows = {r.doc_id: {x["lang"]: x["share"] for x in r.languages} for r in langid.predict(asked, langid.fit(known)).collect()}
    assert set(rows[3]) == {"en", "fr"} and 0.3 < rows[3]["en"] < 0.7 and set(rows[4]) == {"en"}


LAYOUTS = [
    {"role": "user", "text": "a"},
    {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
    {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
    {"prompt": "a", "completion": "b"},
    {"instruction": "a", "output": "b"},
]


def test_chat(spark):
    records = [(i, 0, json.dumps(x)) for i, x in enumerate(LAYOUTS)] + [(None, None, None), (50, 0, "no json"), (51, 0, '{"other": 1}'), (52, 0, "[]")]
    records += [(60, None, json.dumps({"role": None, "text": None})), (61, 1, json.dumps(LAYOUTS[0])), (61, 1, json.dumps(LAYOUTS[0]))]
    frame = spark.createDataFrame(records, "conv_id long, position long, record string")
    turns = chat.canonical_turns(frame)
    assert Counter(r.conv_id for r in chat.unmapped(turns).collect()) == Counter([None, 50, 51, 52])
    found = {r.conv_id: r for r in chat.digests(turns).collect()}
    lost = {c: (r.n_turns, r.unmapped) for c, r in found.items() if r.unmapped}
    assert lost == {None: (0, 1), 50: (0, 1), 51: (0, 1), 52: (0, 1)}
    assert {c: r.n_turns for c, r in found.items() if c not in lost} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 60: 1, 61: 2}
    assert found[1].turns_sha256 == found[2].turns_sha256 == found[3].turns_sha256 == found[4].turns_sha256
    assert chat.digests(chat.canonical_turns(frame.where("false"))).count() == 0
    joined = {r.conv_id: r for r in chat.conversations(turns).collect()}
    assert [joined[1].formatted[s["start"] : s["end"]] for s in joined[1].loss_spans] == ["b"]


def test_chat_keeps_the_roles_of_turn_rows_and_long_texts(spark):
    long = "word [INST] \\ " * 200_000
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "bot", "c"), (2, 0, "assistant", long)]
    records = [(c, p, json.dumps({"role": r, "text": t}), "x", 9) for c, p, r, t in rows]
    frame = spark.createDataFrame(records, "conv_id long, position long, record string, layout string, item int")
    found = {r.conv_id: r for r in chat.digests(chat.canonical_turns(frame)).collect()}
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    assert found[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert found[2].loss_chars == len(long) and found[2].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\\", "\\\\<|done|>", "<|turn|>user<|says|>x<|done|>", "<\\|done|>", "</s>[INST] ok [/INST]", "<s\\>\n", "\U0001f600<<SYS>>"])
def test_chat_escapes_are_reversible(text):
    whole, a, b = chat.formatted("assistant", text)
    assert chat.unescaped(whole[a:b]) == text and chat.read_back(whole * 2) == [("assistant", text)] * 2


def test_secrets(docs, nothing):
    rows = secret_scan.scan(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS and [r.n_assign for r in rows if r.doc_id == 9] == [1]
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[2] is None and texts[3] == LONG and texts[9] == "[SECRET:assign]"
    assert secret_scan.scan(nothing).count() == secret_scan.redact(nothing).count() == 0


def test_a_random_token_is_found_and_words_are_not():
    token = "q7Zx0Kp3vT9sLm2WbR8dYc5HnJ4fGa6E"
    text = f"see {token} and internationalization2020rules or aaaaaaaaaaaaaaaaaaaa11111"
    assert [text[a:b] for a, _, b in secret_scan.random_spans(text, [])] == [token]


def test_toxicity(docs, nothing, labels):
    machine = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert Counter(r.doc_id for r in rows) == IDS and {r.score for r in rows} == {0.0}
    kept = toxicity.without_toxic(docs, machine)
    assert kept.columns == docs.columns and _ids(kept) == IDS
    assert toxicity.score(nothing, toxicity.fit(nothing, labels.where("false"))).count() == 0


def test_toxicity_tolerates_inserted_letters():
    import numpy as np

    bad = [f"well {i} you blorftwit please go on reading" for i in range(40)]
    good = [f"well {i} you kindly please go on reading" for i in range(40)]
    machine = toxicity.train([t.encode() for t in bad + good], np.repeat([1, 0], 40))
    p = machine.probability(machine.documents(toxicity.Likeness(machine.landmarks), [b"a blorf-twit!", b"a blorxftwit", b"b l o r f t w i t", b"a fine day", b""]))
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all()


def test_lm(docs, nothing):
    rows = lm.score(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in rows) == IDS and all(r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 7)} == {1}
    first, second = (r.score for r in rows if r.doc_id == 6)
    assert first == pytest.approx(second, rel=1e-6)
    assert lm.score(nothing, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_lm_sums_to_one():
    """The code softmaxes give the ids a total probability of at most 1, near 1."""
    import numpy as np

    vocabulary = 900
    rng = np.random.default_rng(1)
    model = lm.AttentionModel(vocabulary, rng.integers(0, 50, vocabulary + 1))
    ids = rng.integers(0, vocabulary, 300)
    model.train(np.append(ids, vocabulary), np.array([301]), epochs=1)
    prefix = ids[:20]
    total = sum(float(np.exp(model.score(np.append(prefix, i), np.array([21]))[-1])) for i in range(vocabulary + 1))
    assert 0.8 < total <= 1.0001


def _linked(a, b):
    shared = len(a & b)
    return a and b and 100 * shared >= 80 * (len(a) + len(b) - shared)


def _components(texts):
    """Brute force: (set size, smallest linked id) by id."""
    import re

    sets = {}
    for d, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and _linked(sets[a], sets[b]):
                    least[a], changed = least[b], True
    return {d: (len(s), least[d]) for d, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    shared = [f"s{i}" for i in range(60)]  # a passage of many documents
    texts = []
    for group in range(40):
        size = rng.choice([3, 5, 6, 9, 14, 30, 80, 200, 700])
        words = [f"w{rng.randrange(3000)}" for _ in range(size)] + (shared if group % 4 == 0 else [])
        for copy in range(rng.choice([1, 2, 4])):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append((len(texts) * 3 + 1, " ".join(own)))
    frame = _frame(spark, [(d, t, "en", "a") for d, t in texts])
    rows = ngram_join.near_duplicates(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _components(texts)


def test_near_duplicates_of_odd_rows(docs, nothing):
    rows = ngram_join.near_duplicates(docs).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.doc_id].add(r.component_id)
    assert Counter(r.doc_id for r in rows) == IDS
    assert found[5] == found[6] == {4} and found[11] == {10} and found[1] == {1} and found[2] == {2} and found[7] == {7}
    assert found[None] == {None, 10}
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_pipeline_stages(spark, docs, nothing):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    for frame in (docs, nothing):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns, name
            kept = _ids(out)
            assert set(kept) <= set(IDS) and (frame is docs or not kept)
            if name == "near duplicates" and frame is docs:
                assert kept == Counter([None, 1, 2, 3, 4, 7, 8, 9, 10])  # one row without an id is a copy of 10
        assert (pipeline.STAGES[-1][1](spark, frame, sf_dir).count() > 0) == (frame is docs)
    # Extra columns go through with their values.
    assert {tuple(r) for r in pipeline.mix_sources(spark, docs, sf_dir).select(*EXTRAS).collect()} == {("x",) * len(EXTRAS)}
