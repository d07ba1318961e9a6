"""Packing documents into fixed windows by order-preserving dynamic programming.

The ids of the documents of a partition form one stream. Windows of at most
``capacity`` ids cover it in order; the cuts between them minimise the sum over
windows of

    padding + penalty of the cut at the window's end + WINDOW_COST

where a cut is allowed after a document (no penalty), after a sentence
(SENTENCE_PENALTY) and, only within a stretch of more than LONG_STRETCH ids
without either, at HARD_STEP intervals (HARD_PENALTY). Padding is capacity minus
length, and none at a length that is a power of two. With g(j) = cost(j) +
position(j), the best start of a window that ends at i is the smallest g among
the cut points in reach, which a monotone queue holds; the power-of-two lengths
add at most log2(capacity) further transitions each.

Scale: documents are packed where they are read, so nothing is shuffled. The
partition is worked off in blocks of about BLOCK_IDS ids; the windows at the end
of a block are left open and join the next one. Memory is one block plus the
longest document. Order is the order of the table within each input partition,
which is the same in every attempt of a task that reads files.

Defined results: null or empty text gives the end id alone; equal rows are
packed as often as they come; an empty table gives no pieces; a null id is kept.
Other columns are not read. Ties: of equally cheap starts of a window the latest
is taken; a power-of-two length only where it is cheaper.
"""

from __future__ import annotations

import functools
import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import Codes, blocks, split_words, spread

CAPACITY = 2048
END_ID = 1
SENTENCE_PENALTY = 16
HARD_PENALTY = 96
WINDOW_COST = 128
LONG_STRETCH = 256
HARD_STEP = 64
BLOCK_IDS = 1 << 20
OPEN_WINDOWS = 16
#: Words that a task remembers, and how many of them stay when they are more, and for the worker's next task.
VOCABULARY_LIMIT, VOCABULARY_KEPT = 400_000, 150_000
#: Plain words tokenized as one text, and words whose encodings are held at once.
WORDS_PER_CALL, WORDS_AT_ONCE = 256, 4096
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Words of one or two pre-tokens: Latin-1 letters, and signs after them (an apostrophe might take letters with it).
_PLAIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+([!-&(-/:-@[-`{-~]*)")
_SPACES = bytes.maketrans(b"\t\n\r", b"   ")


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer drops white space and treats words apart, so a text's ids are
    those of its words in a row; each distinct word is tokenized once. Only
    space, tab, line feed and carriage return part words here, so that any other
    white space is left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    @classmethod
    @functools.cache
    def of(cls, path: str) -> "WordIds":
        """The one of this Python worker, so that later tasks find frequent words known."""
        return cls(path)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word); WORDS_AT_ONCE words' encodings are held at a time."""
        parts = [self._encode(words[a : a + WORDS_AT_ONCE]) for a in range(0, len(words), WORDS_AT_ONCE)]
        ids, counts = zip(*parts) if parts else ([np.zeros(0, np.uint32)], [np.zeros(0, np.int64)])
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word).

        Words of Latin-1 letters are one pre-token each, and signs after the letters
        one more; each ends with the only id of a word end in it. Many of them go
        through one call, parted by spaces.
        """
        plain, other, pieces = [], [], []
        for i, word in enumerate(words):
            if found := _PLAIN.fullmatch(word):
                plain.append(i)
                pieces.append(2 if found[1] else 1)
            else:
                other.append(i)
        joined = [" ".join([words[i] for i in plain[a : a + WORDS_PER_CALL]]) for a in range(0, len(plain), WORDS_PER_CALL)]
        flat = self._ids(joined)
        after, last = np.flatnonzero(self.closes[flat]) + 1, np.cumsum(pieces, dtype=np.int64) - 1
        if len(after) != sum(pieces):
            raise ValueError("the tokenizer does not end each word with one word-end id")
        single = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.diff(after[last], prepend=0)
        counts[other] = [len(ids) for ids in single]
        ids = np.zeros(int(counts.sum()), np.uint32)
        first = np.cumsum(counts) - counts
        ids[spread(first[plain], counts[plain])] = flat
        ids[spread(first[other], counts[other])] = np.fromiter(chain.from_iterable(single), np.uint32)
        return ids, counts

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)

    def forget(self) -> None:
        self.codes = Codes()
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.ends_sentence = np.zeros(0, bool)

    def shrink(self, words: int = VOCABULARY_KEPT) -> None:
        """Keeps the words seen first, which are mostly the frequent ones."""
        if len(self.codes) > words:
            self.codes = self.codes.first(words)
            self.first = self.first[: words + 1].copy()
            self.ids = self.ids[: self.first[-1]].copy()
            self.ends_sentence = self.ends_sentence[:words].copy()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text, positions after the sentence ends), END_ID not yet added."""
        words, ends = [], [0]
        for text in texts:
            found = text.translate(_SPACES).split(b" ")
            words += [w for w in found if w] if b"" in found else found
            ends.append(len(words))
        ids, lengths, codes = self.look_up(words)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        per_text = np.diff(upto[np.asarray(ends)])
        return ids, per_text, upto[1:][self.ends_sentence[codes]]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, ids per word, code of each word)."""
        if len(self.codes) > VOCABULARY_LIMIT:
            self.shrink()
        codes = self.codes.of(words)
        if new := self.codes.take_new():
            flat, counts = self.encode([w.decode() for w in new])
            self.ids = np.concatenate([self.ids, flat])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
            marks = np.fromiter((w[-1] in b".!?" for w in new), bool, len(new))
            self.ends_sentence = np.concatenate([self.ends_sentence, marks])
        lengths = (self.first[1:] - self.first[:-1])[codes]
        ids = self.ids[spread(self.first[:-1][codes], lengths)]
        return ids, lengths, codes


def cut_points(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream may be cut, 0 first, and the penalty of each."""
    points = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends])).astype(np.int64)
    gaps = np.diff(points)
    long = np.flatnonzero(gaps > LONG_STRETCH)
    extra = np.zeros(0, np.int64)
    if len(long):
        count = (gaps[long] - 1) // HARD_STEP
        extra = np.repeat(points[long], count) + HARD_STEP * (spread(np.zeros(len(long), np.int64), count) + 1)
    every = np.union1d(points, extra)
    penalty = np.full(len(every), SENTENCE_PENALTY, np.int64)
    penalty[np.searchsorted(every, extra)] = HARD_PENALTY
    penalty[np.searchsorted(every, np.concatenate([[0, total], doc_ends]).astype(np.int64))] = 0
    return every, penalty


def best_cuts(points: np.ndarray, penalty: np.ndarray, capacity: int) -> np.ndarray:
    """The cut points of the cheapest cover of the stream, 0 and the end included."""
    short: list[tuple[int, int]] = []
    size = 1
    while size < capacity:
        at = np.searchsorted(points, points - size)
        hit = np.flatnonzero((points >= size) & (points[np.minimum(at, len(points) - 1)] == points - size))
        short += zip(hit.tolist(), at[hit].tolist())
        size *= 2
    short.sort()
    short.append((len(points), 0))
    place, extra = points.tolist(), (penalty + WINDOW_COST).tolist()
    cost, lead, back = [0], [0], [0]
    queue = deque([0])
    next_short = 0
    for i in range(1, len(place)):
        here = place[i]
        while place[queue[0]] < here - capacity:
            queue.popleft()
        start = queue[0]
        least = lead[start] + capacity - here
        while short[next_short][0] == i:
            other = short[next_short][1]
            if cost[other] < least:
                least, start = cost[other], other
            next_short += 1
        least += extra[i]
        cost.append(least)
        back.append(start)
        mine = least + here
        lead.append(mine)
        while queue and lead[queue[-1]] >= mine:
            queue.pop()
        queue.append(i)
    chosen = [len(place) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return points[np.asarray(chosen[::-1])]


class Packer:
    """Packs a stream of documents, block by block."""

    def __init__(self, capacity: int, sequence_base: int):
        self.capacity, self.next_sequence = capacity, sequence_base
        self.ids: list[np.ndarray] = []
        self.sentences: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, position of its first id, its number of ids); a negative position lies in a former block
        self.held = 0

    def add(self, doc_ids: list, ids: np.ndarray, per_text: np.ndarray, sentence_ends: np.ndarray) -> None:
        after = np.cumsum(per_text)
        whole = np.insert(ids, after, END_ID).astype(np.uint32)
        shift = np.searchsorted(after, sentence_ends, side="left")  # end ids of the documents before
        self.sentences.append(self.held + sentence_ends + shift)
        counts = per_text + 1
        starts = self.held + np.cumsum(counts) - counts
        self.docs += zip(doc_ids, starts.tolist(), counts.tolist())
        self.ids.append(whole)
        self.held += len(whole)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of the windows that are settled; all of them when ``last``."""
        if not self.held:
            return None
        ids = np.concatenate(self.ids)
        starts = np.asarray([d[1] for d in self.docs], np.int64)
        counts = np.asarray([d[2] for d in self.docs], np.int64)
        ends = starts + counts
        sentences = np.concatenate(self.sentences)
        cuts = best_cuts(*cut_points(self.held, ends, sentences), self.capacity)
        if not last:
            cuts = cuts[: max(2, int(np.searchsorted(cuts, self.held - OPEN_WINDOWS * self.capacity)))]
        settled = int(cuts[-1])
        bounds = np.union1d(cuts, starts[(starts > 0) & (starts < settled)])
        begin, end = bounds[:-1], bounds[1:]
        doc = np.searchsorted(starts, begin, side="right") - 1
        window = np.searchsorted(cuts, begin, side="right") - 1
        raw = ids.astype("<u4").tobytes()
        batch = pa.record_batch(
            [
                pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                pa.array(begin - starts[doc]),
                pa.array(end - begin),
                pa.array(counts[doc]),
                pa.array(self.next_sequence + window),
                pa.array(begin - cuts[window]),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary()),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        self.next_sequence += len(cuts) - 1
        self.ids = [ids[settled:]]
        self.sentences = [sentences[sentences > settled] - settled]
        self.docs = [(d, s - settled, n) for d, s, n in self.docs if s + n > settled]
        self.held -= settled
        return batch


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents packed into sequences.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: the
    piece's ids (unsigned 32-bit little-endian), its place in its document and in
    its sequence. A sequence's pieces fill it from offset 0 without gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        word_ids = WordIds.of(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        for batch, texts in blocks(batches):
            packer.add(batch.column(0).to_pylist(), *word_ids(texts))
            if packer.held >= BLOCK_IDS and (pieces := packer.flush(last=False)):
                yield pieces
                del pieces
        if pieces := packer.flush(last=True):
            yield pieces
        word_ids.shrink()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
