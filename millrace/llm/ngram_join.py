"""N-gram Jaccard join by PartEnum signatures.

Two sets of word shingles with Jaccard similarity of at least g differ in at
most (a + b)(1 - g) / (1 + g) elements, a and b their sizes. Sizes are cut into
bands; in a band whose largest size is r, two linked sets differ in at most
k = 2r(1 - g) / (1 + g) elements. The domain (64-bit shingle hashes) is dealt into
n1 parts and each part into n2 cells. As k differences cannot bring more than k2
differences to each of more than k / (k2 + 1) parts, linked sets agree in some
part on n2 - k2 of its cells: every such subset of cells of every part, hashed
with its place, is a signature, and linked sets share one. A set emits signatures
for its own band, and for the next one if a set of that band can be linked to it.

Empty projections would be shared by everybody, so they are not emitted. To
spoil all projections of a part that are not empty takes a difference in
min(k2 + 1, cells with elements) cells; if these sum up, over a set's parts, to
more than it can differ from a partner in its reach, it meets every partner in a
projection that is not empty. Else the
set is called short; it also emits the signatures of another dealing of the
domain, and so on for DEALINGS dealings, the last with its empty projections. Two
linked sets either meet where one of them is not short, or both emit the next
dealing: no link is lost.

More parts are cut than differences can spoil, and most sets are smaller than their
band's largest, so linked sets share not one but some number t of signatures of
each dealing in which one of them is not short: what is left of a set's cells to
spoil, by k2 + 1. A set therefore drops its t - 1 most crowded signatures of a
dealing, in one order for all sets: of the t that two linked sets share, the least
crowded comes after t - 1 others in both sets, so neither drops it. That takes away
the signatures that a passage or line common to many texts brings about.

Sets that are equal form a class and take part once, by a 64-bit fingerprint.
Signature buckets with more than one class are kept. First every class is
compared with its NEIGHBOURS in an order of each bucket (linear in the bucket), the links
are closed to components, and only pairs of classes that share a bucket but are
still in different components are compared in a second round, in blocks of at
most BLOCK classes, behind lower bounds on the difference (sizes, and parity
sketches: each element flips one bit, so the bits that differ are at most the
elements that differ). A sketch of 256 bits thins out the pairs where they are
made, one of as many bits as the set has elements those that are left. A pair comes
out of its first common bucket and of few others. Pairs are
verified by the exact sizes of intersection and union. Components are closed by
alternating large-star and small-star steps. What is quadratic is left to buckets
whose classes are like each other in most parts and yet not linked.

The sets of the classes in question are made again from their texts, as sets of
all classes would be larger than the input. A bitmap of at most PRESENT_BITS bits
tells tasks which texts they can pass over; what it passes beyond need goes when
the sets are joined with the pairs, so its bound only decides how much is moved.

Hash collisions: shingles, classes and signatures are 64-bit hashes. An equal
signature only adds a comparison; for n distinct sets, two share a fingerprint
with odds of n * n / 2**65.

Defined results: a text without words has an empty set and is linked with
nothing; one with fewer than n words has its whole sequence as the only shingle;
equal rows are linked; null ids count as larger than any other and come back
null unless linked to a smaller one; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.textcodes import Codes, blocks, split_words, spread
from millrace.session import cut, release

N_WORDS = 5
PERCENT = 80
BAND_RATIO = 1.6
DEALINGS = 4
#: Parts beyond those that differences can spoil, in percent and at least: for parts without elements, and to drop crowded signatures.
ROOM_PERCENT, ROOM_LEAST = 6, 3
FAMILY_BITS = 12
FAMILY = 1 << FAMILY_BITS
#: Classes before it in a bucket that a class is first compared with, and the classes of a bucket lined up at once.
NEIGHBOURS, LINE = 2, 4096
SKETCH_WORDS = 4
BLOCK = 512
#: Buckets of a class that it has with it where it meets others, to tell whether they have met before.
RECALLED = 16
#: Largest bitmap of wanted texts that tasks are given, and its bits for each of them.
PRESENT_BITS, BITS_EACH = 1 << 26, 16
#: Words that a task remembers, how many of them it keeps beyond that, and fingerprints that it remembers.
VOCABULARY_LIMIT, VOCABULARY_KEPT, SEEN_LIMIT = 200_000, 80_000, 200_000
_M = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of texts; words are hashed once each."""

    def __init__(self, n: int):
        self.n = n
        self.codes, self.hashes = Codes(), np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes, sorted within each text, text after text; where each text's begin and end)."""
        if len(self.codes) > VOCABULARY_LIMIT:
            self.codes, self.hashes = self.codes.first(VOCABULARY_KEPT), self.hashes[:VOCABULARY_KEPT].copy()
        words, ends = split_words([t.lower() for t in texts])
        codes = self.codes.of(words)
        if new := self.codes.take_new():
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        word = self.hashes[codes]
        rolled = np.zeros(max(0, len(word) - self.n + 1), np.uint64)
        for j in range(self.n):
            rolled = rolled * _M + word[j : j + len(rolled)]
        rolled = mix64(rolled)
        parts, bounds = [], [0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= self.n:
                own = np.sort(rolled[a : b - self.n + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                whole = np.uint64(b - a)
                for w in word[a:b]:
                    whole = np.uint64((int(whole) * int(_M) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                own = mix64(np.array([whole], np.uint64) ^ _M)
            else:
                own = rolled[:0]
            parts.append(own)
            bounds.append(bounds[-1] + len(own))
        flat = np.concatenate(parts) if parts else rolled[:0]
        return flat, np.asarray(bounds, np.int64)


def fingerprints(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; 0 for empty ones."""
    sizes = np.diff(ends)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = ends[:-1][full]
        sums = np.add.reduceat(mix64(flat + _M), starts)
        other = np.bitwise_xor.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
        out[full] = mix64(sums * _M + mix64(other + sizes[full].astype(np.uint64)))
    return out


class Band(NamedTuple):
    """Sizes low to high, the most differences k of a link there, and how the domain is dealt."""

    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int


def bands(largest: int, percent: int = PERCENT, ratio: float = BAND_RATIO) -> list[Band]:
    """Bands of sizes up to ``largest`` at least, from the first size that can be linked to another set."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * ratio))
        k = 2 * high * (100 - percent) // (100 + percent)
        if k == 0:
            n1, n2, k2 = 1, 1, 0
        elif k <= 2:
            n1, n2, k2 = k + 1, 1, 0
        else:
            n2, k2 = (3, 1) if high <= 150 else (2, 1)
            n1 = k // (k2 + 1) + 1
            n1 += max(ROOM_LEAST, n1 * ROOM_PERCENT // 100)
        out.append(Band(low, high, k, n1, n2, k2))
        low = high + 1
    return out


def signatures(flat: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of its set, allowance) for all sets; an allowance is the family * FAMILY + how many signatures the set may drop there."""
    sizes = np.diff(ends)
    table = bands(int(sizes.max(initial=0)) * 2 + 2, percent)
    lows = np.array([b.low for b in table])
    band = np.searchsorted(lows, sizes, side="right") - 1
    next_low = lows[np.minimum(band + 1, len(lows) - 1)]
    full = np.flatnonzero(sizes)
    upward = full[100 * sizes[full] >= percent * next_low[full]]
    sets = np.concatenate([full, upward])
    where = np.concatenate([band[full], band[upward] + 1])
    found, owner, allowed = [], [], []
    for dealing in range(DEALINGS):
        if not len(sets):
            break
        short = np.zeros(len(sets), bool)
        for shape in sorted({(table[b].n2, table[b].k2) for b in np.unique(where).tolist()}):
            mine = np.flatnonzero([(table[b].n2, table[b].k2) == shape for b in where.tolist()])
            sig, own, allowance, few = _dealt(flat, ends, sets[mine], where[mine], table, shape, dealing, percent)
            found.append(sig)
            owner.append(own)
            allowed.append(allowance)
            short[mine] = few
        sets, where = sets[short], where[short]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner), np.concatenate(allowed)


def _dealt(flat, ends, sets, where, table, shape, dealing, percent):
    """Signatures of one dealing for sets whose bands share (n2, k2), their owners and allowances, and which of the sets are short."""
    n2, k2 = shape
    sizes = np.diff(ends)[sets]
    n1 = np.array([table[b].n1 for b in where.tolist()], np.int64)
    partner = np.minimum([table[b].high for b in where.tolist()], 100 * sizes // percent)
    most = (sizes + partner) * (100 - percent) // (100 + percent)
    first_part = np.cumsum(n1) - n1
    parts = int(n1.sum())
    elements = flat[spread(ends[:-1][sets], sizes)]
    seed = np.uint64((dealing + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
    placed = mix64(elements ^ mix64(np.repeat(where.astype(np.uint64), sizes) * _M + seed))
    part = (placed >> np.uint64(8)).astype(np.int64) & 0x7FFFFFFFFFFF
    cell = (np.repeat(first_part, sizes) + part % np.repeat(n1, sizes)) * n2 + (placed & np.uint64(0xFF)).astype(np.int64) % n2
    sums = np.zeros(parts * n2, np.uint64)
    np.add.at(sums, cell, mix64(elements + seed))
    filled = np.bincount(cell, minlength=parts * n2).reshape(-1, n2) > 0
    sums = sums.reshape(-1, n2)
    of_set = np.repeat(np.arange(len(sets)), n1)
    to_spoil = np.bincount(of_set, np.minimum(filled.sum(axis=1), k2 + 1), minlength=len(sets))
    few = to_spoil <= most
    shared = np.where(few, 1, -(-(to_spoil - most) // (k2 + 1)))  # parts with a common signature, at least
    allowance = ((where * DEALINGS + dealing) * FAMILY + np.minimum(shared - 1, FAMILY - 1)).astype(np.int32)
    number = np.arange(parts) - np.repeat(first_part, n1)
    place = np.repeat(where, n1) * 1_000_003 + number
    last = dealing == DEALINGS - 1
    found, owner, allowed = [], [], []
    for j, subset in enumerate(combinations(range(n2), n2 - k2)):
        kept = np.flatnonzero(filled[:, subset].any(axis=1) | last)
        value = mix64(place[kept].astype(np.uint64) * _M + np.uint64(j + 16 * dealing))
        for c in subset:
            value = mix64(value + sums[kept, c] + np.uint64(c))
        found.append(value)
        owner.append(sets[of_set[kept]])
        allowed.append(allowance[of_set[kept]])
    return np.concatenate(found), np.concatenate(owner), np.concatenate(allowed), few


def sketches(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of all sets, set after set, as 64-bit words, and where each set's begin and end.

    A sketch has as many bits as the set has elements, rounded up to a power of
    two, 64 * SKETCH_WORDS at least; the halves of a longer one, laid over each
    other by exclusive or, are the sketch of half the length.
    """
    sizes = np.diff(ends)
    bits = np.maximum(64 * SKETCH_WORDS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    first = np.cumsum(bits) - bits
    slot = (mix64(flat ^ np.uint64(0xD6E8FEB86659FD93)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    count = np.bincount(np.repeat(first, sizes) + slot, minlength=int(bits.sum()))
    words = np.packbits((count & 1).astype(np.uint8)).view(np.int64)
    return words, np.concatenate([[0], np.cumsum(bits // 64)])


def folded(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sketches of SKETCH_WORDS words: sets x words."""
    short = words.reshape(-1, SKETCH_WORDS)
    starts = ends[:-1] // SKETCH_WORDS
    return np.bitwise_xor.reduceat(short, starts, axis=0) if len(starts) else short


def _unlike(a: str, b: str):
    """The bits in which two sketches differ, the longer folded to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    word = lambda w, i: F.get(w, i).bitwiseXOR(F.coalesce(F.get(w, i + n), F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, i: t + F.bit_count(word(a, i).bitwiseXOR(word(b, i))))


def _sets_of(docs: DataFrame, n: int, emit, schema: str) -> DataFrame:
    """``emit(batch, sets, ends)`` over blocks of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        seen: dict = {}
        for batch, texts in blocks(batches):
            flat, ends = shingler(texts)
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            yield emit(batch, flat, ends, seen)

    return docs.mapInArrow(run, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges (a, b); the root is the smallest node reachable."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state


def _presence(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes of ``ids`` (one column), and its bits."""
    bits = 1 << 13
    wanted = BITS_EACH * ids.count()
    while bits < min(wanted, PRESENT_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("held")).toPandas()
    held = np.zeros(bits // 64, np.int64)
    held[words["word"].to_numpy()] = words["held"].to_numpy()
    return held, bits


def _is_held(held: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bitmap, packed in 64-bit words, holds each slot."""
    return (held[slot >> 6] >> (slot & 63)) & 1 > 0


def _held(docs: DataFrame, n: int, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, hashes`` of the classes with these keys, and maybe of others; one row each."""
    keys = keys.distinct()
    held, bits = _presence(classes.join(keys, "key").select("first_doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for _, texts in blocks(b.filter(pa.array(_is_held(held, np.asarray(b.column(0))))) for b in batches):
            flat, ends = shingler(texts)
            sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _signed(flat))
            yield pa.record_batch([_signed(fingerprints(flat, ends)), sets], names=["key", "hashes"])

    slots = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("slot"), "text")
    return slots.mapInArrow(run, "key long, hashes array<long>").join(keys, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, docs: DataFrame, n: int, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked; wide sketches first, then the sets themselves."""
    wide = lambda side: classes.select(F.col("key").alias(side), F.col("size").alias(f"size_{side}"), F.col("wide").alias(f"wide_{side}"))
    near = (100 + percent) * _unlike("wide_a", "wide_b") <= (100 - percent) * (F.col("size_a") + F.col("size_b"))
    pairs = cut(pairs.join(wide("a"), "a").join(wide("b"), "b").where(near).select("a", "b"))
    release(docs.sparkSession)
    sets = cut(_held(docs, n, pairs.select(F.col("a").alias("key")).union(pairs.select("b")), classes))
    release(docs.sparkSession)
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    linked = 100 * shared >= percent * (F.size("ha") + F.size("hb") - shared)
    return cut(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"))


def _may_link(percent: int):
    """Lower bounds: the sizes allow a link, and the sketches do not differ in more bits than a link allows."""
    smaller, larger = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    differ = sum((F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 * smaller >= percent * larger) & ((100 + percent) * differ <= (100 - percent) * (smaller + larger))


def _crowded_dropped(signed: DataFrame) -> DataFrame:
    """``bucket, key, crowd`` of the signatures that more than one class has, without those that a class may drop.

    Each class drops its most crowded ones, in one order for all: the least
    crowded signature that two linked sets share is none of them.
    """
    bucket = Window.partitionBy("signature")
    family = Window.partitionBy("key", F.shiftright("allowance", FAMILY_BITS)).orderBy(F.col("crowd").desc(), "signature")
    return (
        signed.withColumn("pivot", F.min("key").over(bucket))
        .withColumn("last", F.max("key").over(bucket))
        .withColumn("members", F.bit_xor(F.xxhash64("key")).over(bucket))
        .withColumn("crowd", F.count("*").over(bucket))
        .where("pivot <> last")
        .select("signature", "key", "allowance", "crowd", F.xxhash64("pivot", "last", "members").alias("bucket"))
        .withColumn("rank", F.dense_rank().over(family))
        .where(F.col("rank") > F.col("allowance").bitwiseAND(F.lit((1 << FAMILY_BITS) - 1)))
        .groupBy("bucket", "key")
        .agg(F.max("crowd").alias("crowd"))
    )


def _apart(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``bucket, key, crowd, root`` of the buckets whose classes are not all in one component."""
    if roots is None:
        named = shared.withColumn("root", F.col("key"))
    else:
        named = shared.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    return named.join(mixed, "bucket")


def _chain(sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, of classes that are neighbours in a bucket and may be linked.

    A bucket's classes are lined up in an order of its own, those of a large
    bucket in several lines, so that a large group of like classes is joined
    up by few pairs a class, whatever the buckets' sizes.
    """
    line = F.pmod(F.xxhash64("bucket", "key", F.lit(1)), F.ceil(F.col("crowd") / LINE))
    order = Window.partitionBy("bucket", "line").orderBy(F.xxhash64("key", "bucket"), "key")
    kept = ["key", "size", *(f"s{i}" for i in range(SKETCH_WORDS))]
    lined = sketched.withColumn("line", line).withColumn("own", F.struct(*kept))
    near = lined.select("own", *(F.lag("own", k).over(order).alias(f"own{k}") for k in range(1, NEIGHBOURS + 1)))
    named = lambda x, s: [x["key"].alias(s), x["size"].alias(f"size_{s}"), *(x[f"s{i}"].alias(f"s{s}{i}") for i in range(SKETCH_WORDS))]
    pairs = None
    for k in range(1, NEIGHBOURS + 1):
        some = near.select(*named(F.col("own"), "a"), *named(F.col(f"own{k}"), "b")).where(F.col("b").isNotNull() & _may_link(percent))
        some = some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = some if pairs is None else pairs.union(some)
    return pairs.distinct()


def _meetings(apart: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, of classes of a bucket that are in different components and may be linked.

    ``apart`` holds ``bucket, key, root, size`` and the short sketches. Classes that
    are much alike share most of their buckets, so a pair meets only where none of
    the RECALLED buckets before this one, in one order for all, is common to both:
    in its first common bucket always, and in few others.
    """
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(-RECALLED, -1)
    members = apart.groupBy("bucket").agg(F.count("*").alias("members"))
    apart = cut(apart.withColumn("before", F.collect_list("bucket").over(before)).join(members, "bucket"))
    block_count = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = apart.withColumn("block", F.pmod(F.xxhash64("key"), block_count).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), block_count - 1))
    )
    meet = [F.col("bucket"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    side = lambda s: dealt.select(
        *meet,
        F.col("block").alias(f"block_{s}"),
        F.col("key").alias(s),
        F.col("root").alias(f"root_{s}"),
        F.col("size").alias(f"size_{s}"),
        F.col("before").alias(f"before_{s}"),
        *(F.col(f"s{i}").alias(f"s{s}{i}") for i in range(SKETCH_WORDS)),
    )
    return (
        side("a")
        .join(side("b"), ["bucket", "lo", "hi"])
        .where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")))
        .where((F.col("block_a") != F.col("block_b")) | (F.col("lo") == F.col("hi")))
        .where(_may_link(percent))
        .where(~F.arrays_overlap("before_a", "before_b"))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return grouped(docs, id_col, text_col, n, percent).select("doc_id", "n_shingles", "component_id")


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, percent: int = PERCENT, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, the group and the ``carry`` columns (long) of every row.

    ``group_key`` tells groups apart also where ids repeat with other texts; it
    is null for rows without words, which are linked with nothing.
    """
    carried = [F.col(c).cast("long").alias(f"carry{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carried, F.col(text_col).alias("text"))
    docs = rows.select("doc_id", "text")
    carried = [f"carry{i}" for i in range(len(carry))]

    def describe(batch, flat, ends, seen):
        words, bounds = sketches(flat, ends)
        short = folded(words, bounds)
        columns = [batch.column(c) for c in ("doc_id", *carried)] + [pa.array(np.diff(ends)), _signed(fingerprints(flat, ends))]
        columns += [pa.array(np.ascontiguousarray(short[:, i])) for i in range(SKETCH_WORDS)]
        columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words)))
        return pa.record_batch(columns, names=["doc_id", *carried, "size", "key", *(f"s{i}" for i in range(SKETCH_WORDS)), "wide"])

    longs = ", ".join(f"{c} long" for c in ("doc_id", *carried, "size", "key", *(f"s{i}" for i in range(SKETCH_WORDS))))
    described = cut(_sets_of(rows, n, describe, f"{longs}, wide array<long>"))
    alike = ["size", *(f"s{i}" for i in range(SKETCH_WORDS)), "wide"]
    classes = described.where("size > 0").groupBy("key").agg(F.min("doc_id").alias("first_doc"), *(F.first(c).alias(c) for c in alike))
    classes = cut(classes)

    def sign(batch, flat, ends, seen):
        prints = fingerprints(flat, ends)
        fresh = []
        for i, p in enumerate(prints.tolist()):
            if p and p not in seen:
                seen[p] = None
                fresh.append(i)
        fresh = np.asarray(fresh, np.int64)
        sizes = np.diff(ends)[fresh]
        sig, owner, allowance = signatures(flat[spread(ends[:-1][fresh], sizes)], np.concatenate([[0], np.cumsum(sizes)]), percent)
        return pa.record_batch([_signed(sig), _signed(prints[fresh][owner]), pa.array(allowance)], names=["signature", "key", "allowance"])

    signed = _sets_of(docs, n, sign, "signature long, key long, allowance int")
    shared = cut(_crowded_dropped(signed))
    release(docs.sparkSession)

    # Round 1: each class against its neighbours in every bucket.
    sketched = cut(_apart(shared, None).join(classes.drop("first_doc", "wide"), "key"))
    chain = cut(_chain(sketched, percent))
    links = _verified(chain, docs, n, classes, percent)
    release(docs.sparkSession)

    # Round 2: classes that share a bucket and are still apart.
    roots = components(links)
    apart = _apart(shared, roots).join(classes.drop("first_doc", "wide"), "key")
    pairs = _meetings(apart, percent).distinct().join(chain, ["a", "b"], "left_anti")
    more = _verified(cut(pairs), docs, n, classes, percent)
    roots = components(links.union(more))

    firsts = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), "first_doc"
    )
    named = firsts.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = firsts.join(named, "root").select("key", "component_id", F.col("root").alias("group_key"))
    return described.join(named, "key", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "group_key",
        *(F.col(c).alias(name) for c, name in zip(carried, carry)),
    )
