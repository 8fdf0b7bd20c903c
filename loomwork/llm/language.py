"""Language identification: a bidirectional gated recurrent network over bytes.

The bytes of a text are read in stretches of STRETCH, from both ends of each. At every
byte the two states give probabilities of the languages: the byte's label. A document's
probabilities are the mean over all its bytes, so every byte of a text has its say.

The network is fitted in numpy by backpropagation through time, on the driver, to a
bounded sample (FIT_DOCS documents in all, as many for each language, those with the
smallest hashes; WINDOWS stretches of each): the documented bound. Nothing else depends
on the sample; scoring is one pass without a shuffle, its memory bounded by GROUP
stretches whatever a text's length.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a null
language is not learnt; without any usable label every text is ``und``; equal
probabilities go to the language first in order; very long texts are read whole;
repeated rows each count and each return; an empty table gives an empty table; only
text decides, and columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import best_of, lean
from .textvec import slices

STRETCH, GROUP, HIDDEN = 96, 2048, 16
FIT_DOCS, WINDOWS, FIT_STRETCH, STEPS, BATCH, RATE = 4000, 8, 64, 120, 256, 0.03
UND = "und"


@dataclass
class Cell:
    """A gated recurrent unit: tables of its inputs by byte, and what the state adds to reset gate, update gate and candidate."""

    tables: list[np.ndarray]  # 3 of (256, HIDDEN)
    states: list[np.ndarray]  # 3 of (HIDDEN, HIDDEN)

    @classmethod
    def new(cls, rng) -> Cell:
        tables = [(rng.normal(0, 0.3, (256, HIDDEN)) + (0.5 if i < 2 else 0)).astype(np.float32) for i in range(3)]
        return cls(tables, [rng.normal(0, 0.25, (HIDDEN, HIDDEN)).astype(np.float32) for _ in range(3)])

    def step(self, x: np.ndarray, h: np.ndarray):
        """The next state, and what its derivative needs. Gates are linear between 0 and 1."""
        r = self.tables[0].take(x, 0)
        r += h @ self.states[0]
        np.clip(r, 0, 1, out=r)
        z = self.tables[1].take(x, 0)
        z += h @ self.states[1]
        np.clip(z, 0, 1, out=z)
        q = h @ self.states[2]
        n = r * q
        n += self.tables[2].take(x, 0)
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return after, (r, z, q, n)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Network:
    """Two cells, forwards and backwards, under one softmax."""

    forward: Cell
    backward: Cell
    out: np.ndarray  # (2 * HIDDEN, languages)
    bias: np.ndarray
    languages: list[str]

    def label(self, x: np.ndarray, inside: np.ndarray):
        """Probabilities of the languages at each byte, from the last to the first: (place, stretches x languages).

        ``x`` is (places, stretches); ``inside`` says which places hold a byte of the text.
        """
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states = np.empty((*x.shape, HIDDEN), np.float32)
        for t in range(len(x)):
            h, _ = self.forward.step(x[t], h)
            states[t] = h
        h = np.zeros_like(h)
        for t in reversed(range(len(x))):
            h, _ = self.backward.step(x[t], h)
            h *= inside[t][:, None]  # nothing is carried in from behind the end
            yield t, _softmax(states[t] @ self.out[:HIDDEN] + h @ self.out[HIDDEN:] + self.bias)


def _gradients(cell: Cell, x: np.ndarray, order, states: np.ndarray, kept: list, dout: np.ndarray):
    """Backpropagation through time for one direction; dout is the loss's derivative by each place's state."""
    n, width = x.shape[1], HIDDEN
    dh = np.zeros((n, width), np.float32)
    dstates = [np.zeros_like(s) for s in cell.states]
    inputs = np.empty((3, *x.shape, width), np.float32)
    steps = list(order)
    for i in reversed(range(len(steps))):
        t = steps[i]
        before = states[steps[i - 1]] if i else np.zeros((n, width), np.float32)
        r, z, q, c = kept[t]
        dh = dh + dout[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * ((z > 0) & (z < 1))
        dr = dc * q * ((r > 0) & (r < 1))
        dq = dc * r
        inputs[0, t], inputs[1, t], inputs[2, t] = dr, dz, dc
        dh = dh * z
        for k, d in enumerate((dr, dz, dq)):
            dstates[k] += before.T @ d
            dh += d @ cell.states[k].T
    flat = x.ravel()
    by = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[by], prepend=-1))
    dtables = [np.zeros_like(table) for table in cell.tables]
    for k in range(3):
        dtables[k][flat[by][first]] = np.add.reduceat(inputs[k].reshape(-1, width)[by], first, axis=0)
    return dtables + dstates


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on the log loss of every byte's label. ``x`` is (stretches, places), ``y`` a number of ``languages`` for each stretch."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    net = Network(Cell.new(rng), Cell.new(rng), rng.normal(0, 0.1, (2 * HIDDEN, n)).astype(np.float32), np.zeros(n, np.float32), languages)
    if n < 2 or not len(x):
        return net
    weights = [*net.forward.tables, *net.forward.states, *net.backward.tables, *net.backward.states, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), BATCH)
        bx, by = x[rows].T.astype(np.int64), y[rows]
        length = len(bx)
        both = []
        for cell, order in ((net.forward, range(length)), (net.backward, range(length - 1, -1, -1))):
            h, states, kept = np.zeros((BATCH, HIDDEN), np.float32), np.empty((length, BATCH, HIDDEN), np.float32), [None] * length
            for t in order:
                h, kept[t] = cell.step(bx[t], h)
                states[t] = h
            both.append((states, kept))
        hidden = np.concatenate([both[0][0], both[1][0]], axis=2)
        error = _softmax(hidden @ net.out + net.bias)
        error[:, np.arange(BATCH), by] -= 1
        error /= error[..., 0].size
        grads = []
        for i, (cell, order) in enumerate(((net.forward, range(length)), (net.backward, range(length - 1, -1, -1)))):
            grads += _gradients(cell, bx, order, *both[i], error @ net.out[i * HIDDEN : (i + 1) * HIDDEN].T)
        grads += [np.tensordot(hidden, error, ((0, 1), (0, 1))), error.sum((0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / steps) * min(1.0, 1.0 / max(norm, 1e-9))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame) -> DataFrame:
    """doc_id, lang and a few stretches of bytes of at most FIT_DOCS documents outside the held-out fold, as many of each language."""
    usable = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    each = max(1, FIT_DOCS // max(1, usable.select("lang").distinct().count()))
    chosen = best_of(usable.select("doc_id", "lang").distinct(), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], each, "rank").drop("rank")
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang"])  # FIT_DOCS rows of an id and a language, at most

    def run(batches):
        for batch in batches:
            cuts = []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                places = np.linspace(0, max(0, len(data) - FIT_STRETCH), WINDOWS if len(data) > FIT_STRETCH else 1).astype(int)
                cuts.append(b"".join(data[p : p + FIT_STRETCH].ljust(FIT_STRETCH) for p in sorted({*places.tolist()})))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(cuts, pa.binary())], ["doc_id", "lang", "cuts"])

    kind = dict(documents.dtypes)["doc_id"]
    return rows.select("doc_id", "lang", "text").mapInArrow(lean(run), f"doc_id {kind}, lang string, cuts binary").groupBy("doc_id", "lang").agg(F.min("cuts").alias("cuts"))


def train(documents: DataFrame) -> Network:
    """A network fitted to :func:`sample`, the same on every run."""
    rows = sorted(map(tuple, sample(documents).collect()), key=lambda r: (r[1], str(r[0]), bytes(r[2])))  # bounded by FIT_DOCS
    languages = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint8).reshape(-1, FIT_STRETCH)
    y = np.repeat([languages.index(r[1]) for r in rows], [len(r[2]) // FIT_STRETCH for r in rows]).astype(np.int64)
    return fit(x, y, languages)


def _stretches(texts: list[bytes | None]):
    """Groups of stretches of all texts: bytes by place, which are inside, and the text of each stretch."""
    data = b"".join(t or b"" for t in texts)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    counts = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(np.cumsum(sizes) - sizes, counts) + within * STRETCH
    length = np.minimum(STRETCH, sizes[of] - within * STRETCH)
    flat = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(STRETCH, np.uint8)])
    by = np.argsort(-length, kind="stable")
    for at in range(0, len(of), GROUP):
        rows = by[at : at + GROUP]
        places = np.arange(int(length[rows[0]]))
        inside = places[:, None] < length[rows]
        x = np.where(inside, flat[np.minimum(begin[rows] + places[:, None], len(flat) - 1)], 32).astype(np.int64)
        yield x, inside, of[rows], begin[rows], length[rows]


def _pool(net: Network, texts: list[bytes | None]) -> np.ndarray:
    """The mean of each text's labels; zeros for a text without bytes."""
    sums, sizes = np.zeros((len(texts), len(net.languages))), np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    for x, inside, of, _, _ in _stretches(texts):
        total = np.zeros((x.shape[1], len(net.languages)), np.float32)
        for t, p in net.label(x, inside):
            total += p * inside[t][:, None]
        np.add.at(sums, of, total)
    return sums / np.maximum(sizes, 1)[:, None]


def _runs(net: Network, texts: list[bytes | None]) -> list[list[dict]]:
    """Each text's labels as runs of bytes of one language."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    labels = np.zeros(int(sizes.sum()), np.int32)
    for x, inside, _, begin, _ in _stretches(texts):
        for t, p in net.label(x, inside):
            labels[(begin + t)[inside[t]]] = p.argmax(1)[inside[t]]
    out, at = [], 0
    for size in sizes.tolist():
        own = labels[at : at + size]
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), size] if size else []
        out.append([{"start": a, "end": b, "lang": net.languages[own[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        at += size
    return out


def predict(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    kind = dict(documents.dtypes)["doc_id"]
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not net.languages:
        return documents.select("doc_id", held_out().alias("held_out"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        for batch in batches:
            probabilities = np.concatenate([_pool(net, batch.column("text").slice(at, n).to_pylist()) for at, n in slices(batch.column("text"))] or [np.zeros((0, len(net.languages)))])
            best = probabilities.argmax(1) if len(probabilities) else np.zeros(0, int)
            known = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            names = [net.languages[i] if k else UND for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(probabilities[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", held_out().alias("held_out"), F.when(readable, F.col("text").cast("binary")).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def spans(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id and spans: runs of bytes (start, end) that carry one language's label, in order; a null text has none."""
    kind = dict(documents.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column("text")):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_runs(net, part.column("text").to_pylist()), span)], ["doc_id", "spans"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, spans array<struct<start:bigint,end:bigint,lang:string>>")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, by a network that :func:`train` fits."""
    return predict(documents, train(documents))
