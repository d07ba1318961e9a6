"""Helpers for tasks that work on the bytes of whole texts with numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of text after which a task gives free memory back; more often costs a tenth of its time.
GIVE_BACK_BYTES = 4 << 20


def give_back() -> None:
    """Hands memory that is free in this Python worker back to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library of most Linux systems
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into pieces of bounded text; null texts become empty."""
    give_back()  # what the task before has left
    worked = 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        if len(column) == 0:
            continue
        sizes = np.asarray(pc.binary_length(column.cast(pa.binary())).fill_null(0)).astype(np.int64)
        group = np.cumsum(sizes) // block_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            texts = piece.column(piece.schema.get_field_index(text_col)).cast(pa.binary()).fill_null(b"").to_pylist()
            yield piece, texts
            del piece, texts
            worked += int(sizes[a:b].sum())
            if worked >= GIVE_BACK_BYTES:  # what the work on these blocks has left, so that it does not add up
                give_back()
                worked = 0
    give_back()


def grouped(texts: list[bytes], block_bytes: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The texts in order, in runs of bounded bytes."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= block_bytes:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


class Codes(dict):
    """Numbers words in order of first sight; ``new`` lists those not yet worked on."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = code = len(self)
        self.new.append(word)
        return code

    def first(self, n: int) -> "Codes":
        """The n words seen first, which are mostly the frequent ones, with their numbers; none may be new."""
        kept = Codes()
        kept.update(islice(self.items(), n))
        return kept

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in a row, and where each text's words begin and end."""
    words: list[bytes] = []
    ends = [0]
    for text in texts:
        words += text.split()
        ends.append(len(words))
    return words, np.asarray(ends, dtype=np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every run, one run after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def crc_remainder(column, modulus: int):
    """``crc32`` of the id as text, modulo: how rows are held out (null ids count as an empty text)."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
