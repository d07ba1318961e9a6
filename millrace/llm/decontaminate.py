"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark at once.

Test strings are windows of consecutive words, so the alphabet is the words of the
benchmark; a word that it lacks is one letter that occurs in no test string. For
each length of test string there are three tables. A shift table, by the hash of a
block of up to three words, says how far the search may move on when the block
stands at its end: as far as the block is from the end of the nearest test string
that holds it. Where that is nought, the block's hash bucket selects the test
strings with this suffix, narrowed by a hash of the whole string, and the words are
compared directly. Test strings are distinct in a table, so a window that very many
items share is compared once. Many stretches of text move on side by side in numpy.

Documents are searched where they are read. The benchmark is cut into pieces of at
most ``PIECE_WORDS`` words (with the words that windows need beyond their end), dealt
to ``ceil(bytes / GROUP_BYTES)`` groups by the hash of item and piece. One pass over the
documents searches for one group's windows, so tables and broadcasts keep their size
however large the benchmark is. With one group that is all, and nothing of the
documents is shuffled. The passes for further groups write what they find, for texts
in which they find anything, to the shared folder; it is merged by the texts' digests
and joined to the documents' ids, so texts themselves are never shuffled or written.

Defined results: null text has no words; items without words ask for nothing; rows
of one item id are one item, and an item without an id counts as the empty id; equal
rows are judged alike and all stay; null document ids are kept; ties cannot arise, as
hits are sets; an empty benchmark hits nothing, an empty table gives no rows. Texts
are searched whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import blocks, spread
from millrace.session import cut

#: ASCII characters that belong to words, all others of ASCII part them.
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
_CLEAN = bytes(c if c > 127 or c in _WORD else 32 for c in bytes(range(256)).lower())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

WINDOW = 10
#: Words of a block at most, whose hash is looked up in the shift table.
BLOCK = 3
SHIFT_BITS = 20
#: Windows that begin in one piece of an item.
PIECE_WORDS = 1_000
#: Bytes of benchmark text whose windows are searched in one round.
GROUP_BYTES = 8 << 20
#: Words of a stretch of text that is searched on its own, side by side with others.
LANE = 128

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` codes from each start."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(length):
        h = _mixed(h * _SPREAD + codes[starts + k].astype(np.uint64) + np.uint64(1))
    return h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class Lengths:
    """The tables of all test strings of one length, given as starts in ``codes`` and the item of each."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.codes = codes
        suffix = _bucket(_hashes(codes, starts + length - self.block, self.block))
        whole = _hashes(codes, starts, length) >> np.uint64(SHIFT_BITS)
        keys = (suffix.astype(np.uint64) << np.uint64(64 - SHIFT_BITS)) | whole
        order = np.argsort(keys, kind="stable")
        keys, starts, items = keys[order], starts[order], items[order]
        # Equal strings become one; of the rare different ones with equal keys each stays.
        words = codes[starts[:, None] + np.arange(length)] if len(starts) else np.zeros((0, length), np.int32)
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (words[1:] == words[:-1]).all(axis=1)
        first = np.flatnonzero(~same)
        self.keys, self.starts = keys[first], starts[first]
        self.items, self.item_ends = items, np.append(first, len(items))
        most = length - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, most, np.uint8)
        for k in range(length - self.block + 1):
            np.minimum.at(self.shift, _bucket(_hashes(codes, self.starts + k, self.block)), length - self.block - k)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``text`` a test string begins, and which."""
        lanes = np.arange(self.length - 1, len(text), LANE)
        stop = np.minimum(lanes + LANE, len(text))
        at, ends = lanes, []
        while len(at):
            moved = self.shift[_bucket(_hashes(text, at - self.block + 1, self.block))]
            ends.append(at[moved == 0])
            at = at + np.maximum(moved, 1)
            there = at < stop
            at, stop = at[there], stop[there]
        begins = (np.concatenate(ends) if ends else np.zeros(0, np.int64)) - self.length + 1
        suffix = _bucket(_hashes(text, begins + self.length - self.block, self.block)).astype(np.uint64)
        keys = (suffix << np.uint64(64 - SHIFT_BITS)) | (_hashes(text, begins, self.length) >> np.uint64(SHIFT_BITS))
        found, which = [], []
        place = np.searchsorted(self.keys, keys)
        while len(begins):
            possible = np.flatnonzero(place < len(self.keys))
            possible = possible[self.keys[place[possible]] == keys[possible]]
            begins, keys, place = begins[possible], keys[possible], place[possible]
            equal = np.ones(len(begins), bool)
            for k in range(self.length):
                equal &= text[begins + k] == self.codes[self.starts[place] + k]
            found.append(begins[equal])
            which.append(place[equal])
            place = place + 1
        return (np.concatenate(found), np.concatenate(which)) if found else (begins, place)

    def items_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each found string in a row, and how many each has."""
        first = self.item_ends[which]
        n = self.item_ends[which + 1] - first
        return self.items[spread(first, n)], n


class Benchmark:
    """The tables for pieces of items, each an item id and words joined by spaces."""

    def __init__(self, pieces: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({item for item, _ in pieces})
        number = {item: k for k, item in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        codes = [np.zeros(0, np.int32)]
        n, items = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for k, (item, joined) in enumerate(pieces):
            words = joined.encode().split(b" ")
            n[k], items[k] = len(words), number[item]
            codes.append(np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        whole, length = np.concatenate(codes), np.minimum(n, window)
        first, strings = np.cumsum(n) - n, n - length + 1
        begin, items, length = spread(first, strings), np.repeat(items, strings), np.repeat(length, strings)
        self.tables = [Lengths(whole, begin[length == m], items[length == m], int(m)) for m in np.unique(length)]

    def search(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text's words the (begin, end) pairs of hit stretches and the ids' numbers of the items found, each sorted."""
        sizes = np.asarray([len(words) + 1 for words in texts], np.int64)  # a letter of no test string follows each text
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for words, end in zip(texts, ends):
            flat[end - 1 - len(words) : end - 1] = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        hit = np.zeros(len(flat) + 1, np.int32)
        seen = []
        for table in self.tables:
            begins, which = table.occurrences(flat)
            np.add.at(hit, begins, 1)
            np.add.at(hit, begins + table.length, -1)
            of_text = np.searchsorted(ends, begins, side="right")
            pairs = np.unique(of_text * len(table.starts) + which)  # a string once for each text
            items, n = table.items_of(pairs % len(table.starts)) if len(pairs) else (pairs, pairs)
            seen.append(np.unique(np.repeat(pairs // max(1, len(table.starts)), n) * len(self.ids) + items))
        inside = np.diff(np.cumsum(hit) > 0, prepend=False).nonzero()[0]
        stretches = inside.reshape(-1, 2)  # no stretch crosses texts, as a letter without a hit parts them
        every = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        texts_of_stretch, texts_of_item = np.searchsorted(ends, stretches[:, 0], side="right"), every // max(1, len(self.ids))
        out = []
        for k in range(len(texts)):
            a, b = np.searchsorted(texts_of_stretch, [k, k + 1])
            c, d = np.searchsorted(texts_of_item, [k, k + 1])
            out.append((stretches[a:b] - (ends[k] - sizes[k]), every[c:d] % max(1, len(self.ids))))
        return out


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text, A-Z in lower case."""
    return text.translate(_CLEAN).split()


def pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, words`` (joined by spaces) of the pieces in which all windows of all items lie."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower())
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.size("words") - window)
    begins = F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS))).alias("begin")
    cuts = rows.select("item_id", "words", begins)
    own = F.slice("words", F.col("begin") + 1, F.lit(PIECE_WORDS + window - 1))
    return cuts.select("item_id", F.array_join(own, " ").alias("words")).distinct()


_FOUND = "doc_id long, digest string, n_words long, hits array<struct<begin: long, end: long>>, items array<string>"
_HITS, _ITEMS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def _pass(tables, window: int, every: bool):
    """A pass for one group of pieces; of all documents, or only of those with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(tables.value, window)
        for batch, texts in blocks(batches):
            split = [words_of(t) for t in texts]
            found = benchmark.search(split)
            hits = [[{"begin": int(a), "end": int(b)} for a, b in own] for own, _ in found]
            items = [[benchmark.ids[k] for k in own] for _, own in found]
            columns = [batch.column(0), batch.column(1), pa.array(map(len, split), pa.int64()), pa.array(hits, _HITS), pa.array(items, _ITEMS)]
            made = pa.record_batch(columns, names=["doc_id", "digest", "n_words", "hits", "items"])
            yield made if every else made.filter(pa.array([bool(i) for i in items], pa.bool_()))

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, hits`` (begin and end of stretches of words) and ``items`` found, of each document.

    Stretches of one group of pieces are apart from each other; those of several may overlap.
    """
    spark = docs.sparkSession
    asked = pieces(benchmark, window=window)
    total = asked.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item_id")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / GROUP_BYTES))
    text = F.col(text_col)
    digest = F.sha2(F.coalesce(text, F.lit("")), 256) if groups > 1 else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), text.alias("text"))

    def tables(number: int):
        own = asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(groups)) == number)
        return spark.sparkContext.broadcast([(r["item_id"], r["words"]) for r in own.collect()])  # about GROUP_BYTES

    found = rows.mapInArrow(_pass(tables(0), window, every=True), _FOUND)
    if groups == 1:
        return found.drop("digest")
    more = []
    for number in range(1, groups):
        shared = tables(number)
        more.append(cut(rows.mapInArrow(_pass(shared, window, every=False), _FOUND).select("digest", "hits", "items")))
        shared.unpersist()
    # Copies of a text have equal hits, so a digest keeps one entry for each group.
    merged = reduce(DataFrame.union, more).groupBy("digest").agg(F.collect_set(F.struct("hits", "items")).alias("more"))
    every = lambda name: F.flatten(F.concat(F.array(name), F.coalesce(F.col(f"more.{name}"), F.array())))
    return found.join(merged, "digest", "left").select("doc_id", "n_words", every("hits").alias("hits"), F.array_sort(F.array_distinct(every("items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Counts of words and hit words, and the number and digest of the items found, of every document."""
    found = find(docs, benchmark, id_col, text_col, window)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    more = lambda past, s: F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["begin"], past["upto"]))
    add = lambda past, s: F.struct((past["n"] + more(past, s)).alias("n"), F.greatest(past["upto"], s["end"]).alias("upto"))
    hit = F.aggregate(F.array_sort("hits"), start, add, lambda past: past["n"])  # words in the union of the stretches
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
