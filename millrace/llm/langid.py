"""Language identification by mixture inference over n-grams.

Each language has a distribution over hashed byte n-grams, counted by Spark over
the whole texts of all documents to learn from: every task adds up its own
counts, one row per language and filled slot, so the size of what is summed does
not depend on the length of texts. A document is a mixture of languages; its
proportions are estimated by expectation-maximisation over its n-grams. The set
of languages is chosen by penalised likelihood: beginning with the likeliest
language, the one that raises the likelihood most is added while it gains more
than PENALTY times the log of the document's n-gram count. The prediction is the
language with the largest proportion.

Many documents are worked on at once: sums per document run over the flat list
of distinct n-grams of a block.

Defined results: null text, and text without a letter, is ``und`` with score 0;
so is everything if nothing was learned; equal rows are predicted alike; ties go
to the first language by code point; null languages are not learned; null ids
are kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import blocks, crc_remainder

ORDERS = (2, 3)
SLOT_BITS = 16
SMOOTHING = 0.5
STEPS = 8
PENALTY = 3.0
UNKNOWN = "und"
HELD_MODULUS, HELD_REMAINDER = 3, 1
BLOCK_BYTES = 1 << 20
_FACTORS = {2: 0x9E3779B97F4A7C15, 3: 0xC2B2AE3D27D4EB4F}
#: Bytes that are no letters in any encoding stand for a space: digits, punctuation and controls.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def slots_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, count) of the hashed n-grams of lower-cased texts, by text and slot."""
    plain = [t.decode().lower().encode().translate(_PLAIN) for t in texts]
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join([b"", *plain, b""]), np.uint8)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
    text = np.repeat(np.arange(len(texts)), sizes)
    text = np.concatenate([[0], text])  # the leading space
    spaced = data == 32
    start = ~(spaced[:-1] & spaced[1:])  # nothing begins between two spaces
    keys = []
    value = data.astype(np.uint64)
    gram = value.copy()
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:-1] | (value[order - 1 :] << np.uint64(8 * (order - 1)))
        if order not in ORDERS:
            continue
        slot = (gram * np.uint64(_FACTORS[order])) >> np.uint64(64 - SLOT_BITS)
        ok = start[: len(slot)] & (text[: len(slot)] == text[order - 1 :])
        keys.append((text[: len(slot)][ok] << SLOT_BITS) | slot[ok].astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> SLOT_BITS, key & ((1 << SLOT_BITS) - 1), count


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x slots


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over every text with a language, and their smoothed logs."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in blocks(batches, block_bytes=BLOCK_BYTES):
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            text, slot, count = slots_of(texts)
            for lang in set(langs):
                own = (langs == lang)[text]
                total = sums.setdefault(lang, np.zeros(1 << SLOT_BITS, np.int64))
                total += np.bincount(slot[own], count[own], minlength=1 << SLOT_BITS).astype(np.int64)
        for lang, total in sums.items():
            filled = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(filled), pa.string()), pa.array(filled), pa.array(total[filled])], names=["lang", "slot", "n"])

    rows = known.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), 1 << SLOT_BITS))
    counts[np.searchsorted(languages, rows["lang"]), rows["slot"]] = rows["n"] if len(rows) else 0
    counts += SMOOTHING
    return Model(list(languages), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the columns of each text, given where each text's columns start."""
    return np.add.reduceat(values, starts, axis=-1)


def _converge(share: np.ndarray, like: np.ndarray, count: np.ndarray, text: np.ndarray, starts: np.ndarray):
    """Expectation-maximisation from ``share`` (languages x texts): (proportions, log likelihood of each text)."""
    for step in range(STEPS + 1):
        mix = np.maximum((like * share[:, text]).sum(axis=0), np.float32(1e-30))
        if step == STEPS:
            return share, _sums((count * np.log(mix)).astype(np.float64), starts)
        share = share * _sums(like * (count / mix), starts)
        share /= np.maximum(share.sum(axis=0), np.float32(1e-30))


def mixtures(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the languages, whether the language is in the set), texts x languages."""
    n, k = len(texts), len(model.languages)
    text, slot, count = slots_of(texts)
    count = count.astype(np.float32)
    share, chosen = np.zeros((k, n), np.float32), np.zeros((k, n), bool)
    present, starts = np.unique(text, return_index=True)
    if not len(present):
        return share.T, chosen.T
    logs = model.log_p[:, slot]
    top = logs.max(axis=0)
    like = np.exp(logs - top)
    single = _sums((count * (logs - top)).astype(np.float64), starts)  # relative to ``top``, as all likelihoods here
    total = _sums(count.astype(np.float64), starts)
    chosen[single.argmax(axis=0), present] = True
    share[:] = chosen
    best = single.max(axis=0)
    # What is still growing: the texts (their numbers), and their columns of the arrays above.
    for _ in range(k - 1):
        own = np.repeat(np.arange(len(present)), np.diff(np.append(starts, len(text))))
        mix = np.maximum((like * share[:, present][:, own]).sum(axis=0), np.float32(1e-30))
        gain = _sums(like * (count / mix), starts) / total - 1
        gain[chosen[:, present]] = -np.inf
        extra = gain.argmax(axis=0)
        # The likelihood is concave: it cannot gain more than its slope towards the new language.
        may = total * gain.max(axis=0) > PENALTY * np.log(np.maximum(total, 2))
        if not may.any():
            break
        columns = may[own]
        like, count, total, best = like[:, columns], count[columns], total[may], best[may]
        sizes = np.bincount(own, minlength=len(present))[may]
        present, extra, starts = present[may], extra[may], np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(present)), sizes)
        text = own
        trial = chosen[:, present]
        trial[extra, np.arange(len(present))] = True
        begin = np.where(trial, np.maximum(share[:, present], np.float32(0.1)), np.float32(0))
        found, value = _converge(begin / begin.sum(axis=0), like, count, own, starts)
        better = value - best > PENALTY * np.log(np.maximum(total, 2))
        if not better.any():
            break
        chosen[:, present[better]], share[:, present[better]] = trial[:, better], found[:, better]
        columns = better[own]
        like, count, total, best = like[:, columns], count[columns], total[better], value[better]
        sizes = sizes[better]
        present, starts = present[better], np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(present)), sizes)
    return share.T.astype(np.float64), chosen.T


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, languages``: the main language, its proportion, and all of the set with theirs."""
    names = np.asarray([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, block_bytes=BLOCK_BYTES):
            n = len(texts)
            letters = np.fromiter((any(map(str.isalpha, t.decode())) for t in texts), bool, n)
            pred, score, sets = np.full(n, len(names) - 1), np.zeros(n), [[] for _ in range(n)]
            some = np.flatnonzero(letters)
            if len(some) and model.languages:
                share, chosen = mixtures(model, [texts[i] for i in some])
                pred[some], score[some] = share.argmax(axis=1), share.max(axis=1)
                for row, i in enumerate(some):
                    sets[i] = [(names[j], float(share[row, j])) for j in np.flatnonzero(chosen[row])]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            found = [[{"lang": a, "share": b} for a, b in s] for s in sets]
            yield pa.record_batch(
                [batch.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(found, kind)],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning."""
    return crc_remainder(id_col, HELD_MODULUS) == HELD_REMAINDER
