"""Language-model scoring with a causal self-attention model in numpy.

The model predicts subword ids of a public tokenizer: embeddings plus window
positions, one causal self-attention layer, one hidden layer, and an output over
three codes of FAN values each: three softmax levels, each gated by the codes before
it. It is trained on all training documents in rounds, each over another slice of
them: in every round, tasks train the same parameters by Adam on their part of the
slice, and the means of what they changed, weighted by the steps that touched a row,
are summed by Spark, in two steps; only the parameters are on the driver. The schedule is
one for inputs of all sizes. A text is scored in windows of CONTEXT + STRIDE ids that overlap by CONTEXT: each id is
scored once, in the window where it is one of the last STRIDE, by batched masked
attention over many windows of many texts at once.

The corpus itself is counted in full: the words of all training documents are
counted by Spark, and the model's probability of a word interpolates the product
of its subwords' attention probabilities with its share of the counts. The weight
of the attention is the likeliest on training documents set aside (one in
ASIDE_MODULUS, by hash of the text), with counts that leave them out; they are
trained on in a last round afterwards. Words never seen rest on the attention alone.

Scale: documents are dealt to blocks of about BLOCK_BYTES of text; each block
sends its distinct words, as 64-bit hashes with counts, to be summed and gets
the sums of its own words back, so that no table of all words is held anywhere
and a frequent word moves one row per block instead of one per document. The
training documents are tokenized there, once: the rounds read ids. What a
step has shuffled goes from the disk before the next one.

Defined results: null text is empty and consists of its end; a table without
training documents gives counts of 0 and an untrained attention model; if none is
set aside, the attention weighs PRIOR_WEIGHT; equal rows
score alike up to the rounding of float32; null ids are kept; an empty table gives no rows. Other columns
are not read. Ids of equal counts take their codes in order of id. Two words with equal 64-bit hashes would share their count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.packing import WordIds
from millrace.llm.textcodes import Codes, crc_remainder, give_back, split_words, spread
from millrace.session import cut, release

CONTEXT, STRIDE = 8, 16
DIM, HIDDEN, FAN = 16, 32, 37
EPOCHS, BATCH_WINDOWS, RATE = 3, 128, 1.2e-2
#: Rounds over the training documents, each over another part of them, and bytes of text for each training task.
ROUNDS, TRAIN_BYTES = 8, 16 << 20
#: Parts in which the changes of all training tasks are summed up before they meet.
SUM_PARTS = 64
ASIDE_MODULUS = 20
PRIOR_WEIGHT, PRIOR_WORDS = 0.9, 10
RATIO_BINS, RATIO_MOST = 16, 64  # bins for a unit of the log ratio, and its bound
CHUNK_ROWS = 256
MANY = 32  # places of one pair of codes that are worth a product of their own
#: Parameters with a row for each id or code, of which a step touches few.
ROWED = frozenset({"E", "G2", "b2", "G3", "b3"})
BLOCK_BYTES = 16 << 20
LEARN_IDS = 350_000  # ids whose windows a training task shuffles, about 1 MB of text
PIECE_BYTES = 1 << 20
WORDS_PACKED = 1 << 16  # words of a block in one row
SCORE_WINDOWS = 256
HELD_MODULUS, HELD_REMAINDER = 7, 2
END_HASH = -1  # stands for the end token among the word hashes
_LN10 = float(np.log(10))


#: Scores are cut off here before exp(), which float32 then holds.
_MOST = np.float32(60)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of the last axis, in place."""
    np.minimum(z, _MOST, out=z)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def _log_pick(z: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """log softmax of each row at its picked entry; shifts the rows only if exp() needs it."""
    if z.max(initial=0) > _MOST:
        z = z - z.max(axis=1, keepdims=True)
    picked = z[np.arange(len(z)), pick]
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], np.float32))


def _row_sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``index``, and the sums of the ``values`` of each."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts laid end to end: (first scored place, places scored, whether a text's first) of each."""
    per_text = -(-lengths // STRIDE)
    begin = np.repeat(np.cumsum(lengths) - lengths, per_text)
    number = spread(np.zeros(len(lengths), np.int64), per_text)
    left = np.repeat(lengths, per_text) - number * STRIDE
    return begin + number * STRIDE, np.minimum(left, STRIDE), number == 0


class AttentionModel:
    """Parameters and the three things done with them: train, score, and nothing else."""

    def __init__(self, vocabulary: int, counts: np.ndarray, seed: int = 7):
        """``counts`` of the ids in the training documents order the codes and set the output biases; id ``vocabulary`` is the end."""
        rng = np.random.default_rng(seed)
        self.end = vocabulary
        small = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        rank = np.empty(vocabulary + 1, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(vocabulary + 1)
        self.codes = np.stack([rank % FAN, rank // FAN % FAN, rank // FAN**2], axis=1)
        self.pair = (self.codes[:, 0] * FAN + self.codes[:, 1]).astype(np.int16)  # sorts by radix
        self.id_type = np.min_scalar_type(vocabulary)
        mass = np.zeros(FAN**3)
        mass[(self.codes * [FAN**2, FAN, 1]).sum(axis=1)] = counts + 0.05
        mass = mass.reshape(FAN, FAN, FAN) + 1e-6
        bias = lambda m: np.log(m / m.sum(axis=-1, keepdims=True)).astype(np.float32)
        self.p = {
            "E": (rng.standard_normal((vocabulary + 1, DIM)) * 0.3).astype(np.float32),
            "P": small(CONTEXT + STRIDE, DIM),
            "Q": small(DIM, DIM), "K": small(DIM, DIM), "V": small(DIM, DIM), "O": small(DIM, DIM),
            "U": small(DIM, HIDDEN), "u": np.zeros(HIDDEN, np.float32), "D": small(HIDDEN, DIM),
            "W1": small(DIM, FAN), "W2": small(DIM, FAN), "W3": small(DIM, FAN),
            "G2": np.ones((FAN, DIM), np.float32), "G3": np.ones((FAN**2, DIM), np.float32),
            "b1": bias(mass.sum(axis=(1, 2))), "b2": bias(mass.sum(axis=2)), "b3": bias(mass).reshape(FAN**2, FAN),
        }
        self.step, self.m1, self.m2 = 0, {}, {}
        offset = np.arange(CONTEXT + STRIDE)
        self.causal = np.where(offset[None, :] <= CONTEXT + np.arange(STRIDE)[:, None], 0, -1e9).astype(np.float32)

    def _gather(self, ids: np.ndarray, start: np.ndarray, first: np.ndarray):
        """Input ids (the id before each place) and the mask of the keys before a text's first place."""
        place = start[:, None] + np.arange(-CONTEXT - 1, STRIDE - 1)
        inputs = ids[np.clip(place, 0, len(ids) - 1)]
        inputs[first, CONTEXT] = self.end
        mask = np.zeros(inputs.shape, np.float32)
        mask[first, :CONTEXT] = -1e9
        return inputs, mask

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each id, of texts laid end to end, each closed by the end id.

        Adjacent matrices are multiplied out beforehand, and all rows of a chunk meet in one product.
        """
        out = np.zeros(len(ids), np.float32)
        starts, sizes, firsts = windows_of(lengths)
        p = self.p
        ask, say = p["Q"] @ p["K"].T * np.float32(DIM**-0.5), p["V"] @ p["O"]
        ones = np.ones((CONTEXT + STRIDE, 1), np.float32)
        first_code, second_code, third_code = np.ascontiguousarray(self.codes.T)
        for at in range(0, len(starts), SCORE_WINDOWS):
            start, size = starts[at : at + SCORE_WINDOWS], sizes[at : at + SCORE_WINDOWS]
            inputs, mask = self._gather(ids, start, firsts[at : at + SCORE_WINDOWS])
            x = p["E"][inputs]
            x += p["P"]
            asked = x[:, CONTEXT:].reshape(-1, DIM)
            a = (asked @ ask).reshape(len(x), STRIDE, DIM) @ x.transpose(0, 2, 1)
            a += self.causal
            first = np.flatnonzero(mask[:, 0])
            a[first] += mask[first, None, :]
            np.exp(a, out=a)
            a /= (a.reshape(-1, CONTEXT + STRIDE) @ ones).reshape(len(x), STRIDE, 1)
            h = asked + (a @ x).reshape(-1, DIM) @ say
            m = h @ p["U"]
            m += p["u"]
            np.maximum(m, 0, out=m)
            h += m @ p["D"]
            place = start[:, None] + np.arange(STRIDE)
            if size.min() == STRIDE:
                place = place.reshape(-1)
            else:
                scored = np.arange(STRIDE) < size[:, None]
                place, h = place[scored], h[scored.reshape(-1)]
            target = ids[place]
            c1, c2 = first_code[target], second_code[target]
            z = h @ p["W1"]
            z += p["b1"]
            logs = _log_pick(z, c1)
            for level, row, pick in ((2, c1, c2), (3, c1 * FAN + c2, third_code[target])):
                gated = p[f"G{level}"].take(row, axis=0)
                gated *= h
                z = gated @ p[f"W{level}"]
                z += p[f"b{level}"].take(row, axis=0)
                logs += _log_pick(z, pick)
            out[place] = logs
        return out

    def train(self, ids: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the cross-entropy of all windows, in a fixed shuffled order."""
        for epoch in range(epochs):
            self.learn(ids, lengths, RATE * (1 - epoch / epochs), seed + epoch)

    def learn(self, ids: np.ndarray, lengths: np.ndarray, rate: float, seed: int = 11, touched: dict | None = None) -> None:
        """One pass of Adam over all windows; rows of ROWED parameters move when a step touches them.

        ``touched`` counts the steps that touched each row.
        """
        starts, sizes, firsts = windows_of(lengths)
        order = np.random.default_rng(seed).permutation(len(starts))
        for k, v in self.p.items():
            self.m1.setdefault(k, np.zeros_like(v))
            self.m2.setdefault(k, np.zeros_like(v))
        for at in range(0, len(order), BATCH_WINDOWS):
            w = order[at : at + BATCH_WINDOWS]
            self.step += 1
            now = np.float32(rate / (1 - 0.9**self.step) * np.sqrt(1 - 0.99**self.step))
            for k, g in self._gradients(ids, starts[w], sizes[w], firsts[w]).items():
                rows, g = g if k in ROWED else (slice(None), g)
                one, two = self.m1[k][rows] * np.float32(0.9), self.m2[k][rows] * np.float32(0.99)
                one += np.float32(0.1) * g
                g *= g
                g *= np.float32(0.01)
                two += g
                self.m1[k][rows], self.m2[k][rows] = one, two
                np.sqrt(two, out=two)
                two += np.float32(1e-8)
                one *= now
                one /= two
                self.p[k][rows] -= one
                if touched is not None:
                    touched[k][rows if k in ROWED else 0] += 1

    def _gradients(self, ids, start, size, first) -> dict:
        """Gradients of the mean cross-entropy; of ROWED parameters as (rows, their gradients).

        Adjacent matrices are multiplied out as in ``score``, and the scored places are in order
        of their first two codes, so that those of a code meet in one product, bias included.
        """
        p, scale = self.p, np.float32(DIM**-0.5)
        inputs, mask = self._gather(ids, start, first)
        x = p["E"][inputs]
        x += p["P"]
        keys = x.transpose(0, 2, 1)
        ask, say = p["Q"] @ p["K"].T * scale, p["V"] @ p["O"]
        wide = lambda z: z.reshape(len(x), STRIDE, -1)
        flat = lambda z: z.reshape(-1, z.shape[-1])
        asked = flat(x[:, CONTEXT:])
        left = np.empty((len(x), 2 * STRIDE, CONTEXT + STRIDE), np.float32)  # attention, and its gradient before the softmax
        right = np.empty((len(x), 2 * STRIDE, DIM), np.float32)  # gradient of the mix, and the questions
        a, asks = left[:, :STRIDE], right[:, STRIDE:]
        asks[:] = wide(asked @ ask)
        np.matmul(asks, keys, out=a)
        a += self.causal
        begins = np.flatnonzero(mask[:, 0])
        a[begins] += mask[begins, None, :]
        if a.max(initial=0) > _MOST:
            np.minimum(a, _MOST, out=a)
        np.exp(a, out=a)
        a /= (a @ np.ones(CONTEXT + STRIDE, np.float32))[:, :, None]
        mixed = flat(a @ x)
        h = asked + mixed @ say
        m = h @ p["U"]
        m += p["u"]
        np.maximum(m, 0, out=m)
        top = h + m @ p["D"]

        scored = np.flatnonzero(np.arange(STRIDE) < size[:, None])
        target = ids[(start[:, None] + np.arange(STRIDE)).reshape(-1)[scored]]
        order = np.argsort(self.pair[target], kind="stable")
        scored, target = scored[order], target[order]
        seen = np.ones((len(target), DIM + 1), np.float32)
        seen[:, :DIM] = top.take(scored, axis=0)
        dhs, g = self._code_gradients(seen, target)
        dtop = np.zeros_like(top)
        dtop[scored] = dhs

        dm = dtop @ p["D"].T
        dm *= m > 0
        g["D"], g["U"], g["u"] = m.T @ dtop, h.T @ dm, np.ones(len(dm), np.float32) @ dm
        dh = dtop + dm @ p["U"].T
        dmixed = dh @ say.T
        right[:, :STRIDE] = wide(dmixed)
        own = (dmixed * mixed) @ np.ones(DIM, np.float32)
        da = right[:, :STRIDE] @ keys
        da -= wide(own)
        ds = np.multiply(a, da, out=left[:, STRIDE:])
        dasks = flat(ds @ x)
        dsay, dask = mixed.T @ dh, asked.T @ dasks * scale
        g["V"], g["O"] = dsay @ p["O"].T, p["V"].T @ dsay
        g["Q"], g["K"] = dask @ p["K"], dask.T @ p["Q"]
        dx = left.transpose(0, 2, 1) @ right
        dh += dasks @ ask.T
        dx[:, CONTEXT:] += wide(dh)
        g["P"] = (np.ones(len(dx), np.float32) @ dx.reshape(len(dx), -1)).reshape(dx.shape[1:])
        g["E"] = _row_sums(inputs.reshape(-1).astype(self.id_type), flat(dx))
        return g

    def _code_gradients(self, seen: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, dict]:
        """Gradients of the tops ``seen`` (with a column of ones), in order of their targets' pairs of codes, and of the output."""
        p, g, n, pair = self.p, {}, len(target), self.pair[target]
        first_code = pair // FAN
        row, ones = np.arange(n), np.ones(FAN, np.float32)

        def slopes(z, picks):
            if z.max(initial=0) > _MOST:
                np.minimum(z, _MOST, out=z)
            np.exp(z, out=z)
            z *= (1 / (n * (z @ ones)))[:, None]
            z[row, picks] -= np.float32(1 / n)
            return z

        d = slopes(seen @ np.vstack([p["W1"], p["b1"]]), first_code)
        both = seen.T @ d
        g["W1"], g["b1"] = both[:DIM], both[DIM]
        dhs = d @ p["W1"].T

        for level, key, least in ((2, first_code, 1), (3, pair, MANY)):
            w, gate, bias = p[f"W{level}"], p[f"G{level}"], p[f"b{level}"]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(begin, append=n)
            rows, large = key[begin], size >= least
            many, few = np.flatnonzero(large), np.flatnonzero(~large)
            gates = gate[rows[many], :, None]
            ws = np.concatenate([gates * w, bias[rows[many], None, :]], axis=1)
            spans = list(zip(begin[many].tolist(), (begin + size)[many].tolist()))
            z = np.empty((n, FAN), np.float32)
            for (i, j), own in zip(spans, ws):
                np.matmul(seen[i:j], own, out=z[i:j])
            if len(few):
                rest = np.flatnonzero(np.repeat(~large, size))
                some, own = seen.take(rest, axis=0)[:, :DIM], gate.take(key[rest], axis=0)
                gated = some * own
                logits = gated @ w
                logits += bias.take(key[rest], axis=0)
                z[rest] = logits
            d = slopes(z, self.codes[target, level - 1])
            sums = np.empty((len(many), DIM + 1, FAN), np.float32)
            backs = np.ascontiguousarray(ws[:, :DIM].transpose(0, 2, 1))
            for (i, j), back, out in zip(spans, backs, sums):
                part = d[i:j]
                np.matmul(seen[i:j].T, part, out=out)
                dhs[i:j] += part @ back
            dgate, dbias = np.empty((len(rows), DIM), np.float32), np.empty((len(rows), FAN), np.float32)
            dgate[many], dbias[many] = (sums[:, :DIM] * w).sum(axis=2), sums[:, DIM]
            dw = (sums[:, :DIM] * gates).sum(axis=0)
            if len(few):
                part = d.take(rest, axis=0)
                back = part @ w.T
                dw += gated.T @ part
                dhs[rest] += back * own
                back *= some
                at = np.cumsum(size[few]) - size[few]
                dgate[few], dbias[few] = np.add.reduceat(back, at, axis=0), np.add.reduceat(part, at, axis=0)
            g[f"W{level}"], g[f"G{level}"], g[f"b{level}"] = dw, (rows, dgate), (rows, dbias)
        return dhs, g


_CHANGES = "param string, chunk int, rows binary, weights binary, sums binary"


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of texts laid end to end and the ids per text, some LEARN_IDS at once."""
    held, size = [], 0
    for batch in batches:
        for ids, lengths in zip(batch.column("ids").to_pylist(), batch.column("lengths").to_pylist()):
            lengths = np.frombuffer(lengths, np.int64)
            size += int(lengths.sum())
            held.append((np.frombuffer(ids, np.dtype(f"u{len(ids) // max(1, int(lengths.sum()))}")), lengths))
            if size >= LEARN_IDS:
                yield tuple(np.concatenate(part).astype(np.int64) for part in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(part).astype(np.int64) for part in zip(*held))


def _trained(model: AttentionModel, rate: float):
    """A function that trains ``model`` on a task's texts: (parameter, chunk of rows, weights, weighted changes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {k: v.copy() for k, v in model.p.items()}
        touched = {k: np.zeros(len(v) if k in ROWED else 1, np.float32) for k, v in before.items()}
        give_back()
        for ids, lengths in _learned(batches):
            model.learn(ids, lengths, rate, touched=touched)
        out = []
        for k, weights in touched.items():
            rows = np.flatnonzero(weights)
            change = (model.p[k] - before[k]).reshape(len(weights), -1)
            for part in np.split(rows, np.flatnonzero(np.diff(rows // CHUNK_ROWS)) + 1) if len(rows) else []:
                own = weights[part]
                out.append((k, int(part[0] // CHUNK_ROWS), part.astype(np.int32), own, change[part] * own[:, None]))
        columns = list(zip(*out)) or [()] * 5
        raw = [pa.array([x.tobytes() for x in c], pa.binary()) for c in columns[2:]]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *raw], names=["param", "chunk", "rows", "weights", "sums"])

    return run


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' changes of a chunk in one row."""
    weights = sums = None
    at = key[1].as_py() * CHUNK_ROWS
    for batch in batches:
        for r, w, x in zip(*(batch.column(c).to_pylist() for c in ("rows", "weights", "sums"))):
            rows, w = np.frombuffer(r, np.int32) - at, np.frombuffer(w, np.float32)
            x = np.frombuffer(x, np.float32).reshape(len(rows), -1)
            if sums is None:
                weights, sums = np.zeros(CHUNK_ROWS), np.zeros((CHUNK_ROWS, x.shape[1]))
            weights[rows] += w
            sums[rows] += x
    rows = np.flatnonzero(weights)
    raw = [pa.array([v.tobytes()], pa.binary()) for v in ((rows + at).astype(np.int32), weights[rows].astype(np.float32), sums[rows].astype(np.float32))]
    yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), *raw], names=["param", "chunk", "rows", "weights", "sums"])


def train_round(model: AttentionModel, texts: DataFrame, rate: float, tasks: int) -> int:
    """Trains ``model`` on all ``texts`` (ids, lengths) in at most ``tasks`` tasks; returns the steps taken by all."""
    changes = texts.select("ids", "lengths").coalesce(tasks).mapInArrow(_trained(model, rate), _CHANGES)
    steps = 0
    some = changes.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SUM_PARTS))).groupBy("param", "chunk", "part").applyInArrow(_summed, _CHANGES)
    for row in some.groupBy("param", "chunk").applyInArrow(_summed, _CHANGES).collect():
        rows, weights = np.frombuffer(row["rows"], np.int32), np.frombuffer(row["weights"], np.float32)
        sums = np.frombuffer(row["sums"], np.float32).reshape(len(rows), -1) / weights[:, None]
        if row["param"] in ROWED:
            model.p[row["param"]][rows] += sums
        else:
            model.p[row["param"]] += sums.reshape(model.p[row["param"]].shape)
            steps = int(weights[0])
    return steps


class _Words:
    """The distinct words of a block, with hashes and, if a tokenizer is given, ids."""

    def __init__(self, word_ids: WordIds | None = None):
        self.codes, self.hashes = Codes(), np.zeros(0, np.int64)
        self.word_ids, self.ids, self.counts = word_ids, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, ends = split_words(texts)
        codes = self.codes.of(words)
        if new := self.codes.take_new():
            fresh = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)).view(np.int64)
            self.hashes = np.concatenate([self.hashes, fresh])
            if self.word_ids is not None:
                ids, counts, _ = self.word_ids.look_up(new)
                self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
                self.first = np.cumsum(self.counts) - self.counts
        return codes, ends

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, ids per word)."""
        counts = self.counts[codes]
        return self.ids[spread(self.first[codes], counts)].astype(np.int64), counts


def _pieces(texts: list[bytes], size: int = PIECE_BYTES):
    """Runs of texts of bounded bytes: (begin, end)."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.binary()).fill_null(b"").to_pylist()


#: Rows of a block by ``kind``: its words (hash, training documents, those set aside), the ids of its training documents
#: with their counts, and, for each round, the texts of the training documents as ids.
_COUNTS = "block int, kind int, word array<long>, n array<long>, aside array<long>, ids binary, lengths binary"
_WORDS, _IDS = -1, -2


def _count_block(tokenizer_path: str):
    """A function that counts a block and tokenizes its training documents; see _COUNTS."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # a rerun trains in the same order
        train, aside = np.asarray(table.column("train")), np.asarray(table.column("aside"))
        rounds = np.asarray(table.column("round").fill_null(-1))
        words = _Words(WordIds.of(tokenizer_path))
        end = words.word_ids.tokenizer.get_vocab_size()
        total, apart = np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts, rows = _texts(table), []
        for a, b in _pieces(texts):
            codes, ends = words([t.lower() for t in texts[a:b]])
            sums = []
            for kind, before in ((train, total), (aside, apart)):
                counted = np.bincount(codes[np.repeat(kind[a:b], np.diff(ends))], minlength=len(words.hashes))
                counted[: len(before)] += before
                sums.append(counted)
            total, apart = sums
            for number in np.unique(rounds[a:b][rounds[a:b] >= 0]).tolist():
                chosen = rounds[a:b] == number
                per_text = np.diff(ends)[chosen]
                ids, per_word = words.ids_of(codes[np.repeat(chosen, np.diff(ends))]) if per_text.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                upto = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(per_text)])]
                ids = np.insert(ids, upto[1:], end).astype(np.min_scalar_type(end))
                rows.append((number, None, None, None, ids.tobytes(), (np.diff(upto) + 1).tobytes()))
        of_ids = np.bincount(words.ids, np.repeat(total, words.counts)).astype(np.int64) if len(words.ids) else np.zeros(0, np.int64)
        ids = np.flatnonzero(of_ids)
        rows.append((_IDS, ids, of_ids[ids], None, None, None))
        packed = np.append(words.hashes, END_HASH), np.append(total, train.sum()), np.append(apart, aside.sum())
        rows += [(_WORDS, *(c[at : at + WORDS_PACKED] for c in packed), None, None) for at in range(0, len(packed[0]), WORDS_PACKED)]
        kinds = [pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        block = pa.array(np.full(len(rows), table.column("block")[0].as_py()), pa.int32())
        return pa.table([block, *columns], names=["block", "kind", "word", "n", "aside", "ids", "lengths"])

    return run


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_logs double, score double, attention_score double"
)


def _words_of_block(model, tokenizer_path: str, docs: pa.Table, counts: pa.Table, column: str):
    """For each piece of a block: (begin, end, count and attention log probability of each word, the text of each)."""
    order = np.argsort(np.asarray(counts.column("word")))
    known, known_n = np.asarray(counts.column("word"))[order], np.asarray(counts.column(column))[order]
    texts, words = _texts(docs), _Words(WordIds.of(tokenizer_path))
    count_of = np.zeros(0, np.int64)
    end_count = int(known_n[np.searchsorted(known, END_HASH)]) if len(known) else 0
    for a, b in _pieces(texts):
        codes, ends = words([t.lower() for t in texts[a:b]])
        fresh = words.hashes[len(count_of) :]
        count_of = np.concatenate([count_of, known_n[np.searchsorted(known, fresh)]]) if len(fresh) else count_of
        c = np.insert(count_of[codes], ends[1:], end_count)
        text_of = np.repeat(np.arange(b - a), np.diff(ends) + 1)
        ids, per_word = words.ids_of(codes) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        per_word = np.insert(per_word, ends[1:], 1)
        ids = np.insert(ids, np.cumsum(per_word)[ends[1:] + np.arange(b - a)] - np.arange(1, b - a + 1), model.end)
        logs = model.score(ids, np.bincount(text_of, per_word, minlength=b - a).astype(np.int64))
        attention = np.bincount(np.repeat(np.arange(len(c)), per_word), logs, minlength=len(c))
        attention[per_word == 0] = -np.log(FAN**3)  # a word the tokenizer drops
        yield a, b, c, attention, text_of


def _log_share(c: np.ndarray, n_train: int) -> np.ndarray:
    """Log of each word's share of the counts; -inf for words not counted."""
    with np.errstate(divide="ignore"):
        return np.log(c / max(1, n_train))


def _ratio_block(model, tokenizer_path: str, n_rest: int, distinct: int):
    """A function for the documents set aside of a block: how often each binned log ratio of the shares comes, and sums.

    The sums: words, log likelihood of the attention, and of add-one counts, under bins out of reach.
    """

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        bins, sums = np.zeros(2 * RATIO_MOST * RATIO_BINS + 1), np.zeros(3)
        for _, _, c, attention, _ in _words_of_block(model, tokenizer_path, docs, counts, "rest"):
            ratio = np.clip(_log_share(c, n_rest) - attention, -RATIO_MOST, RATIO_MOST)
            bins += np.bincount(np.rint((ratio + RATIO_MOST) * RATIO_BINS).astype(np.int64), minlength=len(bins))
            sums += len(c), attention.sum(), np.log((c + 1) / (n_rest + distinct + 1)).sum()
        some = np.flatnonzero(bins)
        return pa.table({"bin": pa.array(np.append(some, -1 - np.arange(3))), "n": pa.array(np.append(bins[some], sums))})

    return run


class Mix(NamedTuple):
    """The attention's weight, and what the documents set aside say (nats a word)."""

    weight: float
    words: int
    mixed: float
    attention: float
    counts: float


def likeliest(bins: dict[int, float]) -> Mix:
    """The likeliest weight of the attention, by expectation-maximisation over binned log ratios."""
    sums = [bins.get(-1 - i, 0.0) for i in range(3)]
    of = sorted(b for b in bins if b >= 0)
    n, ratio = np.array([bins[b] for b in of]), np.exp(np.array(of, float) / RATIO_BINS - RATIO_MOST)
    weight = PRIOR_WEIGHT
    for _ in range(500):
        own = (n * weight / (weight + (1 - weight) * ratio)).sum() + PRIOR_WEIGHT * PRIOR_WORDS
        weight = float(own / (n.sum() + PRIOR_WORDS))
    words = max(1.0, sums[0])
    gain = float((n * np.log(weight + (1 - weight) * ratio)).sum())
    return Mix(weight, int(sums[0]), (sums[1] + gain) / words, sums[1] / words, sums[2] / words)


def _score_block(model, tokenizer_path: str, n_train: int, weight: float):
    """A function that scores the documents of a block with the counts of its words."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        out = [np.zeros(docs.num_rows) for _ in range(5)]
        for a, b, c, attention, text_of in _words_of_block(model, tokenizer_path, docs, counts, "total"):
            mixed = np.logaddexp(attention + np.log(weight), _log_share(c, n_train) + np.log1p(-weight)) if n_train else attention
            for k, v in enumerate((np.ones(len(c)), c > 0, np.log10(c + 1.0), mixed / _LN10, attention / _LN10)):
                out[k][a:b] = np.bincount(text_of, v, minlength=b - a)
        columns = [docs.column("doc_id"), pa.array(~np.asarray(docs.column("train")))]
        columns += [pa.array(out[k].astype(np.int64)) for k in range(2)] + [pa.array(out[k]) for k in range(2, 5)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_logs", "score", "attention_score"])

    return run


class Fitted(NamedTuple):
    """What ``score`` needs besides the documents, dealt to blocks, with the counts of each block's words."""

    model: AttentionModel
    mix: Mix
    steps: int
    n_train: int
    distinct: int
    n_blocks: int
    dealt: DataFrame
    own: DataFrame


def fit(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES, train_bytes: int = TRAIN_BYTES) -> Fitted:
    """Counts, the attention model and its weight, from all training documents of ``docs`` (doc_id, text, train)."""
    piece = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(ASIDE_MODULUS * ROUNDS))
    aside = F.col("train") & (piece % ASIDE_MODULUS == 0)
    number = F.when(aside, ROUNDS).otherwise(F.floor(piece / ASIDE_MODULUS)).cast("int")
    docs = docs.withColumn("aside", aside).withColumn("round", F.when(F.col("train") & F.col("text").isNotNull(), number))
    size = F.octet_length("text")
    volume, learned = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("train"), size)), F.lit(0))).first()
    n_blocks = int(volume // block_bytes) + 1

    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n_blocks)).cast("int").alias("block")
    dealt = docs.select("doc_id", "text", "train", "aside", "round", block).repartitionById(n_blocks, "block")  # a block a task
    counts = cut(dealt.groupBy("block").applyInArrow(_count_block(tokenizer_path), _COUNTS))
    release(docs.sparkSession)  # the shuffle of all texts
    of_words = counts.where(F.col("kind") == _WORDS).select("block", F.inline(F.arrays_zip("word", "n", "aside")))
    totals = of_words.groupBy("word").agg(F.sum("n").alias("total"), F.sum("aside").alias("aside"))
    n_train, distinct, n_aside, rest = totals.agg(
        F.coalesce(F.sum("total"), F.lit(0)), F.count(F.when(F.col("total") > 0, 1)), F.coalesce(F.sum("aside"), F.lit(0)), F.count(F.when(F.col("total") > F.col("aside"), 1))
    ).first()
    vocabulary = WordIds.of(tokenizer_path).tokenizer.get_vocab_size()
    of_ids = np.zeros(vocabulary + 1)
    for row in counts.where(F.col("kind") == _IDS).select(F.inline(F.arrays_zip("word", "n"))).groupBy("word").agg(F.sum("n").alias("n")).collect():
        of_ids[row["word"]] = row["n"]
    of_ids[vocabulary] = docs.where("train").count()

    model, steps = AttentionModel(vocabulary, of_ids), 0
    tasks = int(learned // train_bytes) + 1
    if learned:
        for number in range(ROUNDS):
            steps += train_round(model, counts.where(F.col("kind") == number), RATE * (1 - number / (ROUNDS + 1)), tasks)

    own = of_words.select("block", "word").join(totals.select("word", "total", (F.col("total") - F.col("aside")).alias("rest")), "word")
    own = cut(own.repartitionById(n_blocks, "block"))
    del of_words, totals
    release(docs.sparkSession)
    mix = likeliest({})
    if n_aside:
        apart = dealt.where("aside")
        here = own.join(F.broadcast(apart.select("block").distinct()), "block", "left_semi").repartitionById(n_blocks, "block")
        ratios = apart.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_ratio_block(model, tokenizer_path, n_train - n_aside, rest), "bin long, n double")
        mix = likeliest({row["bin"]: row["n"] for row in ratios.groupBy("bin").agg(F.sum("n").alias("n")).collect()})
        steps += train_round(model, counts.where(F.col("kind") == ROUNDS), RATE / (ROUNDS + 1), tasks)
        del here, ratios, counts
        release(docs.sparkSession)
    return Fitted(model, mix, steps, n_train, distinct, n_blocks, dealt, own)


def score(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Counts, base score and model score of every document; see SCHEMA and the module's notes."""
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        (crc_remainder(id_col, HELD_MODULUS) != HELD_REMAINDER).alias("train"),
    )
    found = fit(docs, tokenizer_path, block_bytes)
    run = _score_block(found.model, tokenizer_path, found.n_train, found.mix.weight)
    own = found.own.repartitionById(found.n_blocks, "block")
    scored = found.dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, SCHEMA)
    base = F.col("base_logs") - F.col("n_tokens") * F.lit(float(np.log10(found.n_train + found.distinct + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(found.n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "attention_score"
    )
