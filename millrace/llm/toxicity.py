"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings is the sum over their common subsequences of three
letters, gaps allowed up to a span of SPAN letters, of DECAY to the power of
both spans; it is normalised to 1 for equal strings and raised to POWER, a kernel
again, so that many faint likenesses do not add up to a word. Insults with gaps, dropped or
inserted letters keep most of their subsequences. Letters are lower-cased, look-
alike digits and signs become letters, other signs inside a word are dropped,
and runs of single letters also count as one word.

Landmarks are stems: beginnings of STEM_LEAST to STEM_MOST letters (a shorter word
is its own) that tell toxic documents from others. Each beginning in the labelled
texts is tested by the hypergeometric odds of its documents' labels; sentences said before
do not count again, nor documents with more than COPY_SHARE of their word triples from others, so that copies are no evidence. All beginnings at least LEAST_ODDS times likelier in toxic documents that pass with false
discoveries controlled at FALSE_SHARE (for discrete tests: the expected number of
chance passes of all beginnings, by their own counts) are landmarks, but for
those that tell no more than a stem of theirs that is one. A word is compared with a landmark as a
whole and by its own beginnings of the landmark's length and up to SLACK letters more,
whichever is more alike, so that endings hide no stem.

As spans are bounded, a word's subsequences can be listed, and its kernel with
all landmarks is a sum of rows of one table; each distinct word is worked out
once per task, with a memory bounded in bytes. A sentence is described by its largest
kernel with each landmark (values under FLOOR count as 0), mapped by the inverse
root of the landmarks' own kernel matrix. The machine is trained on sentences of
labelled documents, of a toxic document those that the machine so far finds
toxic (multiple instances), and on landmarks with a letter put in or left out, which enter
the scale of the probabilities too, on at most FIT_DOCS labelled rows chosen by hash.
Letters of every script have codes; words of fewer than three letters have no subsequence, and text without spaces no words. A
document's score is that of its most toxic sentence, as a probability.

Defined results: null and empty texts score as a sentence without any likeness;
without labels of both kinds, or without any telling stem, everything scores the share of toxic labels,
halved so that nothing is rejected (0 without labels); repeated labels of a document
are separate rows; null labels are not learned; equal rows score alike; ties among
stems and labels are broken by value, so reruns agree; null ids
are kept; an empty table gives no rows. Other columns are not read by
``score`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import Codes, blocks, crc_remainder, give_back, grouped, split_words, spread

SPAN, DECAY, FLOOR, POWER = 7, 0.9, 0.65, 2
STEM_LEAST, STEM_MOST, SLACK = 3, 12, 2
#: A document of so many word triples with a larger share of them from others is a copy; of shorter ones only repeated sentences are.
COPY_SHARE, COPY_LEAST = 0.7, 20
#: How much likelier a stem must be in toxic documents: long ones have more of all words.
LEAST_ODDS = 4
#: Expected share of false stems among those admitted.
FALSE_SHARE = 0.05
#: Share of the toxic class's weight that landmarks with a letter put in or left out have.
VARIANT_SHARE = 0.2
#: Words whose kernels are worked out together.
WORDS_AT_ONCE = 8_000
FIT_DOCS = 5000
ROUNDS, RIDGE, MARGIN = 4, 1e-6, 1.5
SPACED_LEAST = 4
#: Bytes that a task may spend on remembered words, and what a word without likeness takes of them.
MEMORY_BYTES, WORD_BYTES = 40 << 20, 160
HELD_MODULUS = 5
_LETTERS = 64
#: Signs and digits that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}
_CODE = np.full(0x110000, 0, np.uint8)  # 0: not a letter
for _c in range(0x110000):
    if chr(_c).isalpha():
        _low = chr(_c).lower()[0]
        _CODE[_c] = ord(_low) - 96 if "a" <= _low <= "z" else 27 + ord(_low) % 5 if _c < 0x250 else 32 + ord(_low) % 32
for _sign, _letter in LOOKALIKES.items():
    _CODE[ord(_sign)] = ord(_letter) - 96
_EDGE = b".,;:!?\"'()[]{}*%&#$~-_<>|/\\"
_PATTERNS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words in a row, and the number of letters of each."""
    stripped = [w.strip(_EDGE) for w in words]
    joined = b"\n".join(stripped).decode(errors="replace") + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    word = np.concatenate([[0], np.cumsum(points == 10)[:-1]])
    code = _CODE[np.minimum(points, 0x10FFFF)]
    kept = code > 0
    return code[kept], np.bincount(word[kept], minlength=len(words)).astype(np.int64)


def subsequences(code: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight): each occurrence of a subsequence in each word with its decay, unsorted."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # letters from here to the word's end
    wide = code.astype(np.int64)
    words, keys, weights = [], [], []
    for i, j in _PATTERNS:
        at = np.flatnonzero(left > j)
        words.append(word[at])
        keys.append((wide[at] * _LETTERS + wide[at + i]) * _LETTERS + wide[at + j])
        weights.append(np.full(len(at), DECAY ** (j + 1), np.float32))
    return np.concatenate(words), np.concatenate(keys), np.concatenate(weights)


def merged(word: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each distinct subsequence of a word, sorted by word."""
    both, inverse = np.unique(word * _LETTERS**3 + key, return_inverse=True)
    return both // _LETTERS**3, both % _LETTERS**3, np.bincount(inverse, weight, minlength=len(both))


def beginnings(code: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` letters of every word, and how many each has."""
    own = np.minimum(lengths, most)
    return code[spread(np.cumsum(lengths) - lengths, own)], own


@dataclass
class Landmarks:
    """The table of normalised landmark vectors: subsequences that any of them has x landmarks."""

    table: np.ndarray
    row_of: np.ndarray  # the table's row of each subsequence, -1 for none
    lengths: np.ndarray  # letters of each landmark

    @classmethod
    def of(cls, words: list[bytes]) -> "Landmarks":
        code, lengths = letters_of(words)
        word, key, weight = merged(*subsequences(code, lengths))
        used, row = np.unique(key, return_inverse=True)
        table = np.zeros((len(used), len(words)), np.float32)
        table[row, word] = weight
        row_of = np.full(_LETTERS**3, -1, np.int32)
        row_of[used] = np.arange(len(used))
        return cls(table / np.maximum(np.sqrt((table**2).sum(axis=0)), 1e-12), row_of, lengths)

    def _products(self, code: np.ndarray, lengths: np.ndarray, columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, its products with the landmarks of ``columns``, its norm) of all words that share a subsequence with a landmark."""
        word, key, weight = merged(*subsequences(code, lengths))
        norm = np.sqrt(np.bincount(word, weight * weight, minlength=len(lengths)))
        at = np.flatnonzero(self.row_of[key] >= 0)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((0, len(columns)), np.float32), norm[:0]
        starts = np.flatnonzero(np.diff(word[at], prepend=-1))
        rows = word[at][starts]
        sums = np.add.reduceat(self.table[self.row_of[key[at]]][:, columns] * weight[at, None].astype(np.float32), starts, axis=0)
        return rows, sums, norm[rows]

    def kernel(self, words: list[bytes], floor: float = 0.0) -> np.ndarray:
        """Words x landmarks, the better of the whole word and its beginnings; values under ``floor`` are 0.

        A beginning's product with a landmark is at most the whole word's, equal
        subsequences unmerged, and merging only lengthens a vector; words that
        stay under ``floor`` by these bounds are done.
        """
        n, most = len(words), self.table.shape[1]
        out = np.zeros((n, most), np.float32)
        code, lengths = letters_of(words)
        word, key, weight = subsequences(code, lengths)
        at = np.flatnonzero(self.row_of[key] >= 0)
        order = at[np.argsort(word[at], kind="stable")]
        if not len(order):
            return out
        own = word[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums = np.add.reduceat(self.table[self.row_of[key[order]]] * weight[order, None], starts, axis=0)
        rows = own[starts]
        short = np.minimum(lengths[rows][:, None], self.lengths[None, :])
        maybe = sums >= floor * _least_norm(short)
        ends = np.cumsum(lengths)
        for length in np.unique(self.lengths).tolist():
            columns = np.flatnonzero(self.lengths == length)
            mine = rows[maybe[:, columns].any(axis=1)]
            if not len(mine):
                continue
            letters = code[spread(ends[mine] - lengths[mine], lengths[mine])]
            for take in (None, *range(length, length + SLACK + 1)):
                part = (letters, lengths[mine]) if take is None else beginnings(letters, lengths[mine], take)
                found, products, norm = self._products(*part, columns)
                at = np.ix_(mine[found], columns)
                out[at] = np.maximum(out[at], products / norm[:, None])
        out[out < floor] = 0
        return np.minimum(out, 1) ** POWER


def _least_norm(letters: np.ndarray) -> np.ndarray:
    """The norm of a string of so many letters if all its subsequences differ."""
    square = sum(np.maximum(letters - j, 0) * DECAY ** (2 * (j + 1)) for _, j in _PATTERNS)
    return np.maximum(np.sqrt(square), 1e-12).astype(np.float32)


class Likeness:
    """Kernel values of words with the landmarks, remembered for those that reach FLOOR."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        self.codes, self.row = Codes(), np.zeros(0, np.int64)
        self.ends, self.single = np.zeros(0, bool), np.zeros(0, bool)
        self.rows = np.zeros((0, self.landmarks.table.shape[1]), np.float32)

    def _learn(self) -> None:
        new = self.codes.take_new()
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            values = self.landmarks.kernel(part, FLOOR)
            like = values.any(axis=1)
            self.row = np.concatenate([self.row, np.where(like, len(self.rows) + np.cumsum(like) - 1, -1)])
            self.rows = np.concatenate([self.rows, values[like]])
            self.ends = np.concatenate([self.ends, np.fromiter((w[-1] in b".!?" for w in part), bool, len(part))])
            self.single = np.concatenate([self.single, np.fromiter((len(w) == 1 for w in part), bool, len(part))])

    def _spaced(self, words: list[bytes], codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last letter, code of the joined word) of each run of single letters."""
        single = self.single[codes]
        follows = single[1:] & single[:-1] & (text[1:] == text[:-1])
        run = np.concatenate([[0], np.cumsum(~follows)]) if len(codes) else np.zeros(0, np.int64)
        size = np.bincount(run[single], minlength=1)
        first = {}
        for r in np.flatnonzero(size >= SPACED_LEAST).tolist():
            at = int(np.searchsorted(run, r))
            first[at + int(size[r]) - 1] = b"".join(words[at : at + int(size[r])])
        codes = self.codes.of(list(first.values()))
        self._learn()
        return np.fromiter(first, np.int64, len(first)), codes

    def sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, largest kernel with each landmark) of every sentence with any likeness."""
        if self.rows.nbytes + WORD_BYTES * len(self.codes) > MEMORY_BYTES:
            self.forget()
        words, bounds = split_words(texts)
        codes = self.codes.of(words)
        self._learn()
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        ended = self.ends[codes]
        ended[bounds[1:][np.diff(bounds) > 0] - 1] = True
        sentence = np.cumsum(ended) - ended
        place, joined = self._spaced(words, codes, text)
        row = np.concatenate([self.row[codes], self.row[joined]])
        text, sentence = np.concatenate([text, text[place]]), np.concatenate([sentence, sentence[place]])
        at = np.flatnonzero(row >= 0)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((0, self.rows.shape[1]), np.float32)
        at = at[np.argsort(sentence[at], kind="stable")]
        starts = np.flatnonzero(np.diff(sentence[at], prepend=-1))
        return text[at][starts], np.maximum.reduceat(self.rows[row[at]], starts, axis=0)


@dataclass
class Machine:
    landmarks: Landmarks
    root: np.ndarray
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]
    constant: float | None = None

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.root @ self.weights + self.bias

    def documents(self, likeness: Likeness, texts: list[bytes]) -> np.ndarray:
        """Margin of each text's most toxic sentence, one without any likeness included."""
        text, features = likeness.sentences(texts)
        out = np.full(len(texts), self.margins(np.zeros((1, self.root.shape[0])))[0])
        np.maximum.at(out, text, self.margins(features))
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margins), self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * bounded(margins) + b, -50, 50)))


def bounded(margins: np.ndarray) -> np.ndarray:
    """Margins squeezed into (-MARGIN, MARGIN), in their order: beyond the machine's own target they say no more."""
    return MARGIN * np.tanh(margins / MARGIN)


def _solve_svm(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge machine with weighted rows, by Newton steps on its active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(z.shape[1]) * RIDGE * share.sum()
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(30):
        za = z[active] * share[active, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _targets(y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Smoothed targets, (n + 1) / (n + 2) and 1 / (n + 2) for n labels of a kind, and both n."""
    up, down = float(share[y > 0].sum()), float(share[y <= 0].sum())
    return np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2)), up, down


def platt_loss(margins: np.ndarray, y: np.ndarray, slope: float, offset: float, share: np.ndarray | None = None) -> float:
    """Cross-entropy of the logistic with smoothed targets, rows weighted by ``share``."""
    share = np.ones(len(y)) if share is None else share
    target, _, _ = _targets(y, share)
    z = slope * margins + offset
    return float((share * (np.logaddexp(0, z) - target * z)).sum())


def _platt(margins: np.ndarray, y: np.ndarray, share: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic that fits the labels best: Newton, each step halved while it raises the loss."""
    share = np.ones(len(y)) if share is None else share
    target, up, down = _targets(y, share)
    z, w = np.stack([margins, np.ones(len(y))], axis=1), np.array([0.0, np.log((up + 1) / (down + 1))])
    loss = platt_loss(margins, y, *w, share)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + 1e-9 * np.eye(2), z.T @ (share * (p - target)))
        while np.abs(step).max() > 1e-9 and (now := platt_loss(margins, y, *(w - step), share)) > loss:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        w, loss = w - step, now
    return float(w[0]), float(w[1])


def _log_choose(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def _tails(total: int, toxic: int, docs: int, factorial: np.ndarray) -> np.ndarray:
    """P(at least c of ``total`` documents are toxic), c = 0 .. most, if drawn by chance from ``docs`` with ``toxic`` toxic ones."""
    c = np.arange(max(0, total - (docs - toxic)), min(total, toxic) + 1)
    choose = lambda n, k: factorial[n] - factorial[k] - factorial[n - k]
    p = np.exp(choose(toxic, c) + choose(docs - toxic, total - c) - choose(docs, total))
    tail = np.cumsum(p[::-1])[::-1]
    return np.minimum(np.concatenate([np.ones(c[0]), tail]), 1)


def chance_bound(totals: np.ndarray, hits: np.ndarray, toxic: int, docs: int, share: float = FALSE_SHARE) -> tuple[np.ndarray, float]:
    """p of each count of ``hits`` of ``totals``, and the largest p at which the expected chance passes are at most ``share`` of the passes."""
    factorial = _log_choose(docs)
    p, attainable, gains = np.ones(len(totals)), [], []
    for total in np.unique(totals).tolist():
        tails = _tails(total, toxic, docs, factorial)
        mine = totals == total
        p[mine] = tails[hits[mine]]
        some = tails[tails < 0.01][::-1]  # rising
        attainable.append(some)
        gains.append(np.diff(some, prepend=0) * mine.sum())
    attainable, gains = np.concatenate(attainable or [p[:0]]), np.concatenate(gains or [p[:0]])
    order = np.argsort(attainable, kind="stable")
    attainable, expected = attainable[order], np.cumsum(gains[order])
    found = np.sort(p[p < 0.01])
    upto = np.searchsorted(attainable, found * (1 + 1e-9), side="right")
    chance = np.concatenate([[0.0], expected])[upto]
    passes = np.searchsorted(found, found, side="right")
    good = np.flatnonzero(chance <= share * passes)
    return p, float(found[good[-1]]) * (1 + 1e-9) if len(good) else 0.0


@dataclass
class _Stems:
    """Beginnings of one length, with toxic and other documents that have them."""

    key: np.ndarray
    parent: np.ndarray  # key of the beginning one letter shorter
    word: np.ndarray  # a word that has it
    toxic: np.ndarray
    clean: np.ndarray


def _stems(code: np.ndarray, lengths: np.ndarray, doc: np.ndarray, word: np.ndarray, y: np.ndarray, letters: int) -> _Stems:
    """``doc, word`` are the occurrences that count; ``code, lengths`` the letters of the distinct words."""
    able = lengths >= letters
    starts = (np.cumsum(lengths) - lengths)[able]
    key, parent = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64)
    value = np.zeros(len(starts), np.uint64)
    for i in range(letters):
        before = value
        value = (value + code[starts + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    key[able], parent[able] = value, before
    has = able[word]
    distinct, first, of = np.unique(key, return_index=True, return_inverse=True)
    pair = np.unique(of[word[has]] * len(y) + doc[has])
    stem, label = pair // len(y), y[pair % len(y)] > 0
    toxic, clean = (np.bincount(stem[k], minlength=len(distinct)) for k in (label, ~label))
    some = (toxic + clean > 0) & able[first]
    return _Stems(distinct[some], parent[first[some]], first[some], toxic[some], clean[some])


def _copies(code: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Which documents of COPY_LEAST word triples or more have more than COPY_SHARE of them from documents before."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    triple = (code[:-2] + np.uint64(1)) * factor
    triple ^= code[1:-1] + np.uint64(1)
    triple *= factor
    triple ^= code[2:] + np.uint64(1)
    inside = doc[:-2] == doc[2:]
    triple, owner = triple[inside], doc[:-2][inside]
    order = np.argsort(triple, kind="stable").astype(np.uint32)
    triple, owner = triple[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]])) if len(triple) else order
    seen = owner != np.repeat(owner[starts], np.diff(starts, append=len(triple)))
    triples = np.bincount(owner, minlength=docs)
    return (np.bincount(owner[seen], minlength=docs) > COPY_SHARE * triples) & (triples >= COPY_LEAST)


def telling_stems(texts: list[bytes], y: np.ndarray) -> list[bytes]:
    """The beginnings that tell toxic documents, by evidence; see the module's notes."""
    codes, code, counts = Codes(), [np.zeros(0, np.uint32)], []
    for some in grouped(texts):
        words, bounds = split_words(some)
        code.append(codes.of(words).astype(np.uint32))
        counts.append(np.diff(bounds))
    code, bounds = np.concatenate(code), np.concatenate([[0], np.cumsum(np.concatenate(counts or [[]]))]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    known = list(codes)
    del codes, counts, words
    ended = np.fromiter((w[-1] in b".!?" for w in known), bool, len(known))[code]
    ended[bounds[1:][np.diff(bounds) > 0] - 1] = True
    sentence = (np.cumsum(ended) - ended).astype(np.int32)
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    if not len(starts):
        return []
    # Equal words in equal places of a sentence give equal sums.
    said = (np.arange(len(code), dtype=np.uint64) - starts.astype(np.uint64)[sentence]) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)
    said *= code + np.uint64(1)
    said = np.add.reduceat(said, starts)
    _, new = np.unique(said, return_index=True)
    copies = _copies(code, doc, len(texts))
    fresh = np.zeros(len(starts), bool)
    fresh[new] = True
    fresh = fresh[sentence] & ~copies[doc]
    pair = np.unique(doc[fresh].astype(np.uint64) << np.uint64(32) | code[fresh])
    doc, code = (pair >> np.uint64(32)).astype(np.int32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    del pair, fresh, sentence, said
    letters, lengths = letters_of(known)
    levels = [_stems(letters, lengths, doc, code, y, k) for k in range(STEM_LEAST, STEM_MOST + 1)]
    for shorter, longer in zip(levels, levels[1:]):
        # A beginning that one longer beginning has all documents of is told by that one.
        at = np.searchsorted(shorter.key, longer.parent)
        at = np.minimum(at, max(0, len(shorter.key) - 1))
        same = (shorter.key[at] == longer.parent) & (shorter.toxic[at] == longer.toxic) & (shorter.clean[at] == longer.clean) if len(at) else at
        keep = np.ones(len(shorter.key), bool)
        keep[at[same]] = False
        shorter.key, shorter.parent, shorter.word, shorter.toxic, shorter.clean = (
            x[keep] for x in (shorter.key, shorter.parent, shorter.word, shorter.toxic, shorter.clean)
        )
    toxic, clean = np.concatenate([x.toxic for x in levels]), np.concatenate([x.clean for x in levels])
    n1, n = int((y[~copies] > 0).sum()), int((~copies).sum())
    p, bound = chance_bound(toxic + clean, toxic, n1, n)
    size = np.repeat(np.arange(STEM_LEAST, STEM_MOST + 1), [len(x.key) for x in levels])
    word = np.concatenate([x.word for x in levels])
    first = np.cumsum(lengths) - lengths
    passed = np.flatnonzero((p <= bound) & (toxic * (n - n1) >= LEAST_ODDS * clean * n1))
    spelled = [letters[first[w] : first[w] + k].tobytes() for w, k in zip(word[passed].tolist(), size[passed].tolist())]
    order = sorted(range(len(passed)), key=lambda i: (p[passed[i]], spelled[i]))
    factorial = _log_choose(n)
    admitted: dict[bytes, tuple[int, int]] = {}
    for i in order:
        a, b = int(toxic[passed[i]]), int(clean[passed[i]])
        stem = spelled[i]
        kin = [v for k, v in admitted.items() if stem.startswith(k) or k.startswith(stem)]
        if all(_tells_more(a, b, *k, bound, factorial) for k in kin):
            admitted[stem] = (a, b)
    at = {spelled[i]: passed[i] for i in order}
    return [_spelling(known[word[at[s]]], len(s)) for s in admitted]


def _tells_more(a: int, b: int, toxic: int, clean: int, bound: float, factorial: np.ndarray) -> bool:
    """Whether a of a + b documents is more than chance where a kindred stem has ``toxic`` of ``toxic + clean``."""
    if a > toxic or b > clean:  # the shorter of the two: what it has beyond the longer must tell by itself
        a, b = max(0, a - toxic), max(0, b - clean)
        return a > 0 and a * (clean + 1) > 2 * b * (toxic + 1) and a >= 3
    return bool(_tails(a + b, toxic, toxic + clean, factorial)[a] <= bound)


def _spelling(word: bytes, letters: int) -> bytes:
    """The shortest beginning of ``word`` with so many letters."""
    text = word.decode(errors="replace").strip(_EDGE.decode())
    for i in range(1, len(text) + 1):
        if letters_of([text[:i].encode()])[1][0] >= letters:
            return text[:i].lower().encode()
    return word


def inserted(word: bytes) -> list[bytes]:
    """The word with a letter put in at each inner place."""
    text = word.decode(errors="replace")
    return [(text[:i] + chr(97 + (7 * i + len(text)) % 26) + text[i:]).encode() for i in range(1, len(text))]


def dropped(word: bytes) -> list[bytes]:
    """The word without one of its letters, if three are left."""
    text = word.decode(errors="replace")
    return [(text[:i] + text[i + 1 :]).encode() for i in range(len(text))] if len(text) > STEM_LEAST else []


def train(texts: list[bytes], labels: np.ndarray) -> Machine:
    """The machine of labelled documents; labels are 1 or 0."""
    y = np.where(labels > 0, 1, -1)
    words = telling_stems(texts, y) if len(y) and abs(y.sum()) < len(y) else []
    if not words:
        empty = Landmarks.of([b""])
        return Machine(empty, np.eye(1), np.zeros(1), 0.0, (1.0, 0.0), constant=float((y > 0).mean()) * 0.49 if len(y) else 0.0)
    landmarks = Landmarks.of(words)
    gram = landmarks.kernel(words).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    likeness = Likeness(landmarks)
    text, features = [np.zeros(0, np.int64)], [np.zeros((0, len(words)), np.float32)]
    before = 0
    for some in grouped(texts):
        own, found = likeness.sentences(some)
        text.append(own + before)
        features.append(found)
        before += len(some)
    text, features = np.concatenate(text), np.concatenate(features)
    x = features @ root
    # First guess: a toxic document's sentences with a telling stem. Variants of these with
    # a letter put in or left out are toxic sentences too.
    toxic = (y[text] > 0) & (features.max(axis=1, initial=0) > 0.9)
    varied = landmarks.kernel([v for w in words for v in (*inserted(w), *dropped(w))], FLOOR)
    variants = varied @ root
    clean = np.vstack([x[y[text] < 0], np.zeros((1, x.shape[1]))])
    machine = Machine(landmarks, root, np.zeros(len(root)), 0.0, (1.0, 0.0))
    for _ in range(ROUNDS):
        rows = [x[toxic], variants, clean]
        shares = (1 - VARIANT_SHARE, VARIANT_SHARE, 1.0)
        share = np.concatenate([np.full(len(r), part / max(1, len(r))) for r, part in zip(rows, shares)])
        target = np.repeat([1.0, 1.0, -1.0], [len(r) for r in rows])
        machine.weights, machine.bias = _solve_svm(np.vstack(rows), target, share)
        now = (y[text] > 0) & (machine.margins(features) > 0)
        if (now == toxic).all():
            break
        toxic = now
    margins = np.concatenate([machine.documents(likeness, some) for some in grouped(texts)])
    share = np.full(len(varied), VARIANT_SHARE * (y > 0).sum() / len(varied))
    every = np.concatenate([margins, machine.margins(varied)])
    machine.scale = _platt(bounded(every), np.append(y, np.ones(len(varied))), np.append(np.ones(len(y)), share))
    return machine


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine trained on at most ``fit_docs`` labelled rows, chosen by hash of the id; held-out ids are left out."""
    chosen = (
        labels.select(F.col(id_col).alias("fit_id"), F.col(label_col).cast("int").alias("fit_label"))
        .where("fit_id IS NOT NULL AND fit_label IS NOT NULL")
        .where(~held_out("fit_id"))
        .orderBy(F.xxhash64("fit_id"), "fit_id", "fit_label")
        .limit(fit_docs)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["fit_id"]).select("fit_id", "fit_label", "text")
    rows = texts.orderBy(F.xxhash64("fit_id"), "fit_id", "fit_label", F.xxhash64("text")).limit(fit_docs).select("text", "fit_label")
    fitted = rows.mapInArrow(_fitted, "machine binary").collect()
    return pickle.loads(fitted[0].machine) if fitted else train([], np.zeros(0, np.int32))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the machine trained on the rows of a task; the texts and what training takes stay off the driver."""
    texts, labels = [], [np.zeros(0, np.int32)]
    for batch in batches:
        texts += batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        labels.append(np.asarray(batch.column("fit_label")))
    machine = pickle.dumps(train(texts, np.concatenate(labels)))
    del texts, labels
    give_back()
    yield pa.record_batch([pa.array([machine], pa.binary())], names=["machine"])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = Likeness(machine.landmarks)
        for batch, texts in blocks(batches):
            p = machine.probability(machine.documents(likeness, texts))
            yield pa.record_batch([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores less than ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = Likeness(machine.landmarks)
        for batch, texts in blocks(batches, text_col):
            p = machine.probability(machine.documents(likeness, texts))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept from learning."""
    return crc_remainder(id_col, HELD_MODULUS) == 0
