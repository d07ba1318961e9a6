"""Secret scans: fixed patterns, and a battery of randomness tests for what has no pattern.

Candidates are runs of encoding characters with letters and digits, apart from them
runs of letters alone, and the parts of both between the separators that are foreign
to an encoding (a path around a token, say). For each the smallest encoding that holds
all its characters is inferred, and three tests
compare it with a uniform source over that alphabet: chi-squared of the
character counts, runs above and below the middle, and serial correlation at lag
1. Their p-values are combined by Fisher's method; a candidate that is unlikely
to be random is dropped. What remains could still be text too short to tell, so
a second p-value asks how likely text of that length would look so uniform (a
non-central chi-squared, whose excess grows with the length). False discoveries
are controlled over all candidates of the document by the Benjamini-Hochberg
rule with weights in proportion to length, for each of the three kinds apart, so that
long words do not hide a token. Discoveries that overlap are one; of one that touches
a fixed pattern the rest outside it is kept.

Everything happens where the text is read; nothing is shuffled. Offsets are code
points, ends exclusive.

Defined results: null text is empty and has no spans; equal rows are scanned
alike; spans of one start are in the order of their kinds, so there are no ties;
null ids are kept; an empty table gives no rows. Other columns are not
read by ``scan`` and are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import blocks

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base scan and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Parts of a candidate that one encoding holds whatever surrounds them.
PARTS = tuple(re.compile(f"[A-Za-z0-9{own}]{{16,}}={{0,2}}") for own in ("+/", "_-", ""))
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
RANDOM_LEAST_P = 0.001
DISCOVERY_RATE = 0.005
#: Encodings from the smallest alphabet to the largest.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "upper26": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "lower26": string.ascii_lowercase,
    "lower36": string.digits + string.ascii_lowercase,
    "upper36": string.digits + string.ascii_uppercase,
    "letters52": string.ascii_letters,
    "base62": string.digits + string.ascii_letters,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}
#: Percentages of a to z in English text.
LETTER_PERCENT = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)


def _text_excess(alphabet: str) -> float:
    """Chi-squared per character of English text against a uniform alphabet.

    One character in ten is a digit, and one letter in ten a capital where there are both cases.
    """
    share = dict.fromkeys(alphabet, 0.0)
    for c, percent in zip(string.ascii_lowercase, LETTER_PERCENT):
        for own, part in ((c, 0.9), (c.upper(), 0.1)):
            if own in share:
                share[own] += percent * part
    letters = sum(share.values())
    digits = [c for c in alphabet if c.isdigit()]
    for c in share:
        share[c] = (0.9 if digits else 1.0) * share[c] / letters if not c.isdigit() else 0.1 / len(digits)
    k = len(alphabet)
    return sum((p - 1 / k) ** 2 * k for p in share.values())


_EXCESS = {name: _text_excess(a) for name, a in ENCODINGS.items()}
_SETS = {name: frozenset(a) for name, a in ENCODINGS.items()}
_RANK = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}


def _normal_above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(x: float, df: float) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * df)
    return _normal_above(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def encoding_of(token: str) -> str | None:
    chars = set(token.rstrip("="))
    return next((name for name, own in _SETS.items() if chars <= own), None)


def battery(token: str) -> tuple[float, float] | None:
    """(p-value of being random, p-value of text looking as uniform), or None without an encoding."""
    name = encoding_of(token)
    if name is None:
        return None
    token = token.rstrip("=")
    n, k, rank = len(token), len(ENCODINGS[name]), _RANK[name]
    chi = k / n * sum(c * c for c in Counter(token).values()) - n
    uniform = chi_squared_p(chi, k - 1)
    values = [rank[c] for c in token]
    high = [v >= k / 2 for v in values]
    n1 = sum(high)
    n0 = n - n1
    if n0 and n1:
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        runs_p = 2 * _normal_above(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = 2.0 ** (1 - n)
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / power if power else 1.0
    serial_p = 2 * _normal_above(abs(serial + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs_p, serial_p))
    excess = n * _EXCESS[name]
    text_p = 1 - _normal_above((chi - (k - 1 + excess)) / math.sqrt(2 * (k - 1 + 2 * excess)))
    return chi_squared_p(fisher, 6), text_p


def discoveries(tests: list[tuple[int, float]], rate: float = DISCOVERY_RATE) -> set[int]:
    """Weighted Benjamini-Hochberg over (length, p-value): the indices that are discoveries."""
    if not tests:
        return set()
    mean = sum(n for n, _ in tests) / len(tests)
    scaled = sorted((p * mean / n, i) for i, (n, p) in enumerate(tests))
    last = max((r for r, (q, _) in enumerate(scaled, 1) if q <= rate * r / len(tests)), default=0)
    return {i for _, i in scaled[:last]}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches that are too short are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the battery finds random, without what ``taken`` covers."""
    families = [], [], []  # whole candidates, their parts, letters alone
    for m in CANDIDATE.finditer(text):
        whole = m.span()
        parts = {(whole[0] + x.start(), whole[0] + x.end()) for own in PARTS for x in own.finditer(m[0])} - {whole}
        for place in [whole, *sorted(parts)]:
            token = text[slice(*place)]
            if _LETTER.search(token):
                families[2 if not _DIGIT.search(token) else int(place != whole)].append(place)
    kept = []
    for places in families:
        tests, tested = [], []
        for a, b in places:
            result = battery(text[a:b])
            if result:
                tests.append((b - a, result[1] if result[0] >= RANDOM_LEAST_P else 1.0))
                tested.append((a, b))
        kept += [tested[i] for i in discoveries(tests)]
    return [(a, 3, b) for a, b in _outside(kept, taken) if any(map(str.isalnum, text[a:b]))]


def _union(places: list[tuple[int, int]]) -> list[list[int]]:
    """The union of ``places`` as runs in order that do not overlap."""
    union: list[list[int]] = []
    for a, b in sorted(places):
        if union and a < union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    return union


def _outside(places: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of ``places`` without ``taken``, as runs that do not overlap; one walk along both."""
    gone, at, out = _union([(start, end) for start, _, end in taken]), 0, []
    for a, b in _union(places):
        while at < len(gone) and gone[at][1] <= a:
            at += 1
        k = at
        while k < len(gone) and gone[k][0] < b:
            if a < gone[k][0]:
                out.append((a, gone[k][0]))
            a = max(a, gone[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts and digest, and all ``spans`` (kind, start, end) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            counts, digests, spans = [[], [], []], [], []
            for raw in texts:
                text = raw.decode()
                base = base_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every = sorted(base + random_spans(text, base))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every])
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, _SPANS)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans array<struct<kind: string, start: long, end: long>>"
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redacted(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by ``[SECRET:kind]`` of its first."""
    base = base_spans(text)
    out, at, until = [], 0, -1
    for a, k, b in sorted(base + random_spans(text, base)):
        if a >= until:
            out += [text[at:a], f"[SECRET:{KINDS[k]}]"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; null texts stay null, rows and columns stay."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            known = batch.column(position).is_valid().to_pylist()
            clean = pa.array([redacted(t.decode()) if k else None for t, k in zip(texts, known)], pa.string())
            yield batch.set_column(position, batch.schema.field(position).with_type(pa.string()), clean)

    return docs.mapInArrow(run, docs.schema)
