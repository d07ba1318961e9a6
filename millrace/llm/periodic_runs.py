"""Periodic runs: maximal repetitions of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least
``max(least, 2 * q)`` long, that cannot be made longer on either side. The dictionary
numbers, for every power of two, the factors of that many words, each from the two
halves of the level before; only factors that occur twice in their text stay.

For a run whose period is between L and 2 L words, the factor of L words at its start
occurs again one period on. So at each level the occurrences of a factor that follow
each other within 2 L words propose periods. Occurrences no more than L / 2 apart are
in arithmetic progression, as their factor has that period, and all lie in one run of
it; pairs inside such a progression propose nothing but the difference. Between two
progressions there are only two kinds of pairs that can lie a new period apart: any
occurrence of the first with the beginning of the second, and their two ends. (If the
first progression's run ends inside the new run, so must the second's, a period on;
if it does not, then the second's begins a period after the new run.) Another
progression begins over L / 2 words after the last, so three following ones are looked
at. Proposals one word apart with one period are one stretch; its ends are found
with the dictionary, level by level, and stretches that several periods propose keep
the smallest. Work and memory are in proportion to n log n at worst, whatever repeats.

Texts are worked on where they are read, many small ones together; nothing is
shuffled.

Defined results: null text has no words and no runs; null ids are kept; equal rows give
equal rows; runs are in the order of start, then period, so there are no ties; an empty
table gives no rows. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import Codes, blocks, spread, split_words

LEAST_LENGTH = 12
#: The smallest factors that propose periods have 2 ** FIRST_LEVEL words; 3 times that is at most LEAST_LENGTH.
FIRST_LEVEL = 2
#: Progressions that can begin within twice a factor's length after one.
FOLLOWING = 3


class Factors:
    """Where factors of one length occur that occur twice, and their numbers."""

    def __init__(self, places: np.ndarray, keys: np.ndarray):
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = count[number] > 1
        self.places, self.numbers = places[twice], number[twice]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The number of the factor at each place, or -1."""
        found = np.searchsorted(self.places, places)
        found[found == len(self.places)] = 0
        return np.where(self.places[found] == places, self.numbers[found], -1) if len(self.places) else np.full(len(places), -1)


def dictionary(codes: np.ndarray) -> list[Factors]:
    """The factors of 1, 2, 4, ... words of a row of codes, as far as any occurs twice."""
    levels = [Factors(np.arange(len(codes)), codes)]
    while len(levels[-1].places):
        half, step = levels[-1], 1 << (len(levels) - 1)
        second = half.at(half.places + step)
        both = second >= 0
        levels.append(Factors(half.places[both], half.numbers[both] * (int(half.numbers.max()) + 1) + second[both]))
    return levels[:-1]


def proposals(factors: Factors, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that the occurrences of factors of ``size`` words propose; a stretch once."""
    order = np.lexsort((factors.places, factors.numbers))
    place, number = factors.places[order], factors.numbers[order]
    tight = (number[1:] == number[:-1]) & (np.diff(place) <= size // 2)
    begins = np.flatnonzero(np.append(True, ~tight))
    ends = np.append(begins[1:], len(place)) - 1
    first, last, own = place[begins], place[ends], number[begins]
    of = np.repeat(np.arange(len(begins)), ends - begins + 1)
    found = []
    if size == 1 << FIRST_LEVEL:
        more = ends > begins
        found.append((first[more], place[begins[more] + 1] - first[more]))
    for k in range(1, FOLLOWING + 1):
        after = of + k
        there = after < len(begins)
        i, after = np.flatnonzero(there), after[there]
        period = first[after] - place[i]
        good = (own[after] == number[i]) & (period <= 2 * size)
        found.append((place[i[good]], period[good]))
        if len(begins) > k:
            period = last[k:] - last[:-k]
            good = (own[k:] == own[:-k]) & (period <= 2 * size)
            found.append((last[:-k][good], period[good]))
    where, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((where, period))
    where, period = where[order], period[order]
    fresh = np.ones(len(where), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (np.diff(where) > 1)
    return where[fresh], period[fresh]


def _alike(levels: list[Factors], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from a and from b on (or before them) are equal."""
    a, b, begin = a.copy(), b.copy(), a
    for k in range(len(levels) - 1, -1, -1):
        back = 0 if forward else 1 << k
        mine = levels[k].at(a - back)
        step = np.where((mine >= 0) & (mine == levels[k].at(b - back)), 1 << k, 0)
        a, b = (a + step, b + step) if forward else (a - step, b - step)
    return np.abs(a - begin)


def runs(codes: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a row of codes, by start, then period."""
    if least < 3 << FIRST_LEVEL:
        raise ValueError(f"runs shorter than {3 << FIRST_LEVEL} are not searched for")
    levels = dictionary(codes)
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(FIRST_LEVEL, len(levels)):
        where, period = proposals(levels[k], 1 << k)
        start = where - _alike(levels, where, where + period, forward=False)
        end = where + period + _alike(levels, where, where + period, forward=True)
        good = end - start >= np.maximum(least, 2 * period)
        found.append((start[good], end[good], period[good]))
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def runs_of_texts(words: list, ends: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, ...]:
    """Text number, start in the text, length and period of all runs, for the words of texts in a row."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    # A word counts for its own text only, so that no factor occurs in two texts or across their border.
    code = text * (len(words) + 1) + Codes().of(words)
    # Texts are set apart by a place whose code occurs once.
    row = np.full(len(words) + len(ends), -1, np.int64)
    row[np.arange(len(words)) + text] = code
    row[np.append(ends[1:], len(words)) + np.arange(len(ends))] = -1 - np.arange(len(ends))
    start, length, period = runs(row, least)
    of = np.searchsorted(ends + np.arange(len(ends)), start, side="right") - 1
    return of, start - ends[of] - of, length, period


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs`` (start, length, period, in words) and ``collapsed`` of every text.

    ``collapsed`` is the text's words joined by single spaces, without those that a run
    holds after its first period.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            words, ends = split_words(texts)
            of, start, length, period = runs_of_texts(words, ends, least)
            dropped = np.zeros(len(words) + 1, np.int64)
            np.add.at(dropped, ends[of] + start + period, 1)
            np.add.at(dropped, ends[of] + start + length, -1)
            keep = np.cumsum(dropped)[:-1] == 0
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
            collapsed = []
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                own = words[a:b] if cuts[k] == cuts[k + 1] else [words[j] for j in np.flatnonzero(keep[a:b]) + a]
                collapsed.append(b" ".join(own))
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found).cast(_RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
