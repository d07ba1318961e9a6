"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The statistics of every whole text are computed where it is read, with numpy
over blocks of bounded bytes. The trees are fitted on the driver with at most
FIT_ROWS labelled rows (a documented bound, chosen by hash), then flattened into
arrays of nodes - feature, threshold, value - that score a block of documents
level by level. Constrained features may only move the score in the stated
direction: more symbols, repeats or duplicate lines never raise it.

Defined results: null text has no words and fails the base rule, as does an
empty one; without labels of both kinds the trees keep everything that passes
the base rule; equal rows are scored alike, and labelled rows of equal hashes are
chosen by id and label, so ties do not matter; null ids are kept; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import Codes, blocks, split_words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FIT_ROWS = 8000
ROUNDS, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 60, 3, 0.2, 64, 20, 1.0
THRESHOLD = 0.5
#: Feature name: -1 if more of it must not raise the score, 0 if unconstrained.
CONSTRAINTS = {
    "log_words": 0,
    "word_length": 0,
    "distinct_share": 0,
    "upper_share": 0,
    "digit_share": 0,
    "punctuation_share": 0,
    "bang_share": 0,
    "line_words": 0,
    "longest_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
}
FEATURES = list(CONSTRAINTS)
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: bytes, chars: bytes) -> int:
    return len(text.translate(None, chars))


def repeated_words(codes: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in it.

    Windows are named exactly by doubling: a pair of adjacent names gets a name
    of its own, from single words to pairs, fours and eights. ``window`` is a
    power of two.
    """
    docs = len(ends) - 1
    doc = np.repeat(np.arange(docs), np.diff(ends))
    names, step = codes, 1
    while step < window:
        if len(names) <= step:
            return np.zeros(docs, np.int64)
        pair = names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    last = window - 1
    inside = doc[: len(names)] == doc[last : last + len(names)]
    start = np.flatnonzero(inside)
    if not len(start):
        return np.zeros(docs, np.int64)
    own = names[start] * docs + doc[start]
    _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
    begins = start[count[inverse] > 1]
    delta = np.zeros(len(codes) + 1, np.int64)
    np.add.at(delta, begins, 1)
    np.add.at(delta, begins + window, -1)
    covered = np.cumsum(delta[:-1]) > 0
    return np.bincount(doc[covered], minlength=docs)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS per text, FEATURES per text)."""
    words, ends = split_words(texts)
    codes = Codes().of(words)
    n = len(texts)
    n_words = np.diff(ends)
    repeat = repeated_words(codes, ends) if len(codes) else np.zeros(n, np.int64)
    counts = np.zeros((n, len(COUNTS)), np.int64)
    features = np.zeros((n, len(FEATURES)))
    for i, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        dup_lines = len(lines) - len(set(lines))
        chars = _without(text, _SPACE + _CONTINUATION)
        symbols = len(text) - _without(text, SYMBOLS)
        own = words[ends[i] : ends[i + 1]]
        counts[i] = len(own), chars, symbols, dup_lines, repeat[i]
        w, c = max(1, len(own)), max(1, chars)
        features[i] = (
            np.log1p(len(own)),
            chars / w,
            len(set(own)) / w,
            (len(text) - _without(text, _UPPER)) / c,
            (len(text) - _without(text, _DIGITS)) / c,
            (len(text) - _without(text, _PUNCTUATION)) / c,
            text.count(b"!") / w,
            len(own) / max(1, len(lines)),
            np.log1p(max(map(len, own), default=0)),
            symbols / w,
            dup_lines / max(1, len(lines)),
            repeat[i] / w,
        )
    counts[:, 0] = n_words
    return counts, features


@dataclass
class Trees:
    """Complete trees as node arrays; node k has children 2k+1 (value <= threshold) and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node]
        return total


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds=ROUNDS, depth=DEPTH, rate=RATE) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature is only taken if its children's values are
    in order; the midpoint then bounds the values below, so the whole tree, and
    with it the sum, is monotone in that feature.
    """
    nodes = 2 ** (depth + 1) - 1
    out = Trees(np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes)), 0.0, depth)
    if not len(y) or y.min() == y.max():
        out.base = 20.0 if not len(y) or y[0] else -20.0
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = y.mean()
    out.base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), out.base)

    def grow(t, node, rows, level, low, high, g, h):
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + RIDGE), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * MIN_LEAF:
            for f, e in enumerate(edges):
                b = binned[rows, f]
                size = len(e) + 1
                gl, hl = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gr, hr = gs - gl, hs - hl
                ok = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF)
                if signs[f]:
                    left, right = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
                    ok &= (right - left) * signs[f] >= 0
                gain = np.where(ok, gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gs**2 / (hs + RIDGE), -np.inf)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, gl[k], hl[k]))
        if best[1] is None:
            stack = [node]  # the value stands in every leaf below
            while stack:
                k = stack.pop()
                out.value[t, k] = rate * value
                stack += [j for j in (2 * k + 1, 2 * k + 2) if j < nodes]
            margin[rows] += rate * value
            return
        f, k, gl, hl = best[1]
        out.feature[t, node], out.threshold[t, node] = f, edges[f][k]
        bounds = [(low, high), (low, high)]
        if signs[f]:
            left, right = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-(gs - gl) / (hs - hl + RIDGE), low, high)
            middle = (left + right) / 2
            bounds = [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
        goes = binned[rows, f] > k
        grow(t, 2 * node + 1, rows[~goes], level + 1, *bounds[0], g, h)
        grow(t, 2 * node + 2, rows[goes], level + 1, *bounds[1], g, h)

    for t in range(rounds):
        p = _sigmoid(margin)
        grow(t, 0, np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p))
    return out


_FEATURE_SCHEMA = ", ".join(f"{c} double" for c in FEATURES)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col="doc_id", text_col="text", label_col="quality") -> Trees:
    """Trees fitted on at most ``fit_rows`` labelled rows, chosen by hash of the id."""
    chosen = (
        labels.select(F.col(id_col).alias("fit_id"), F.col(label_col).cast("double").alias("fit_label"))
        .where("fit_id IS NOT NULL AND fit_label IS NOT NULL")
        .orderBy(F.xxhash64("fit_id"), "fit_id", "fit_label")
        .limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["fit_id"]).select("fit_id", "fit_label", "text")

    def run(batches):
        for batch, found in blocks(batches):
            x = statistics(found)[1]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *(pa.array(x[:, i]) for i in range(len(FEATURES)))],
                names=["fit_id", "fit_label", *FEATURES],
            )

    # A repeated id can add rows beyond the labels; the bound holds for the rows fetched.
    rows = texts.mapInArrow(run, f"fit_id long, fit_label double, {_FEATURE_SCHEMA}")
    got = rows.orderBy(F.xxhash64("fit_id"), *rows.columns).limit(fit_rows).toPandas()
    return fit_trees(got[FEATURES].to_numpy(), got["fit_label"].to_numpy(), list(CONSTRAINTS.values()))


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, the trees' ``score`` and ``kept`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            counts, features = statistics(texts)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            score = _sigmoid(trees.margin(features))
            yield pa.record_batch(
                [
                    batch.column(0),
                    *(pa.array(counts[:, i]) for i in range(len(COUNTS))),
                    pa.array(failed),
                    pa.array(score),
                    pa.array(~failed & (score >= threshold)),
                ],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
