"""Quality classifier: random-indexing word vectors, pooled per document, under a small calibrated network.

Words are hashed to BUCKETS rows. Each bucket has a fixed sparse random index
vector; a word's context vector is the sum of the index vectors around it over
the whole corpus, gathered by one pass whose result has a fixed size (BUCKETS x
DIM), however large the corpus. A document is the frequency-damped mean of its
words' vectors, worked out once for every document. A two-layer network is fitted
with numpy to all labelled ones: dealt by hash into parts of about PART_ROWS, each
of which is a task that goes on from the network so far, and the parts' networks
are averaged after each of ROUNDS rounds (one part: one round). Means and scales
of the inputs come from all labelled rows, and the temperature from all those of
a fifth of them that no fit has seen.

Defined cases: null and empty texts are scored as documents without words; null
or conflicting labels of a document count by their smallest value, null ones not
at all; with no labels or one class only the score is the smoothed share of good
labels; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import cut, drop_cut, lean
from .textvec import slices

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 64, 2, 2
#: Rows of the matrix of context vectors in a block, and at most so many words at once in memory.
BLOCK, SLICE = 256, 1 << 16
#: Weight of a word that makes up a share p of the corpus: DAMP / (DAMP + p).
DAMP = 0.003
#: Pseudo-words at the corpus mean (the origin), which hold back documents of a few words.
FEW = 4
PART_ROWS, ROUNDS, HIDDEN, EPOCHS, RATE, DECAY, CALIBRATE = 20_000, 4, 32, 60, 0.01, 1e-4, 0.2
TEMPERATURES = np.exp(np.linspace(-0.7, 2.5, 97))
THRESHOLD = 0.3
SAME = 0  # the bucket of a word that repeats the one before it
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHE = 150_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero entries."""
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


class Numberer:
    """Buckets of the words of texts, with a bounded cache."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' buckets, and the number of words of each text."""
        if len(self.known) > _CACHE:
            self.known.clear()
        known, out, counts = self.known, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = _TOKEN.findall(text) if text else ()
            counts[i] = len(words)
            for word in words:
                b = known.get(word)
                if b is None:
                    known[word] = b = 1 + zlib.crc32(word.encode()) % (BUCKETS - 1)
                out.append(b)
        ids = np.array(out, np.int64)
        if len(ids):
            same = np.concatenate([[False], ids[1:] == ids[:-1]])
            same[np.cumsum(counts)[:-1][np.cumsum(counts)[:-1] < len(ids)]] = False
            ids[same] = SAME
        return ids, counts


def _texts(batches):
    """The texts of batches in stretches of about 2 MB."""
    for batch in batches:
        column = batch.column("text")
        for at, n in slices(column):
            yield column.slice(at, n).to_pylist()


def _contexts(batches):
    """A partition's context vectors and word counts, by blocks of rows."""
    places, signs = index_vectors()
    number, total = Numberer(), np.zeros(BUCKETS * DIM)
    seen = np.zeros(BUCKETS)
    for texts in _texts(batches):
        ids, counts = number(texts)
        doc = np.repeat(np.arange(len(counts)), counts)
        for at in range(0, len(ids), SLICE):
            part, of = ids[at : at + SLICE + WINDOW], doc[at : at + SLICE + WINDOW]
            seen += np.bincount(ids[at : at + SLICE], minlength=BUCKETS)
            for step in range(1, WINDOW + 1):
                n = min(SLICE, len(part) - step)
                if n <= 0:
                    continue
                near = of[:n] == of[step : step + n]
                left, right = part[:n][near], part[step : step + n][near]
                for k in range(NONZERO):
                    keys = np.concatenate([left * DIM + places[right, k], right * DIM + places[left, k]])
                    total += np.bincount(keys, np.concatenate([signs[right, k], signs[left, k]]), BUCKETS * DIM)
    rows = np.concatenate([total.reshape(BUCKETS, DIM), seen[:, None]], axis=1)
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for b in range(BUCKETS // BLOCK):
        piece = rows[b * BLOCK : (b + 1) * BLOCK]
        if piece.any():
            yield _block(b, part, piece)


def _block(b: int, part: int, piece: np.ndarray) -> pa.RecordBatch:
    import zstandard

    data = zstandard.ZstdCompressor(level=3).compress(piece.astype("<i8").T.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part % 32], pa.int32()), pa.array([data], pa.binary())], ["block", "part", "data"])


def _open(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(DIM + 1, BLOCK).T


def _sum_blocks(batches):
    """Sums of a partition's blocks, one block of each number in memory."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            sums[b] = sums.get(b, 0) + _open(data)
    for b, piece in sums.items():
        yield _block(b, 0, piece)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """BUCKETS x DIM word vectors, damped by frequency, from all documents."""
    schema = "block int, part int, data binary"
    blocks = documents.select("text").mapInArrow(lean(_contexts), schema)
    for keys in (("block", "part"), ("block",)):  # in parts first: however many tasks there were, no task sums them all
        blocks = blocks.repartition(64, *keys).mapInArrow(lean(_sum_blocks), schema)
    gathered = np.zeros((BUCKETS, DIM + 1))
    for r in blocks.collect():  # BUCKETS / BLOCK rows of fixed size
        gathered[r.block * BLOCK : (r.block + 1) * BLOCK] = _open(bytes(r.data))
    context, seen = gathered[:, :DIM], gathered[:, DIM]
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    vectors = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9) + own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    share = seen / max(1.0, seen.sum())
    vectors *= (DAMP / (DAMP + share))[:, None]
    return (vectors - share @ vectors).astype(np.float32)


def pool(vectors: np.ndarray, number: Numberer, texts: list[str | None]) -> np.ndarray:
    """A row per text: the shrunk mean of its words' vectors, its norm and the log of its length."""
    ids, counts = number(texts)
    sums = np.zeros((len(texts), DIM), np.float64)
    doc = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(ids), SLICE):
        of = doc[at : at + SLICE]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums[of[first]] += np.add.reduceat(vectors[ids[at : at + SLICE]], first, axis=0)
    mean = sums / (counts + FEW)[:, None]
    return np.concatenate([mean, np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(counts)[:, None]], axis=1)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a logit divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def start(mean: np.ndarray, scale: np.ndarray, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    return Network(mean, scale, rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)


def fit(net: Network, x: np.ndarray, y: np.ndarray, epochs: range, seed: int = 11) -> Network:
    """The network after some of EPOCHS epochs of Adam on the log loss over the rows."""
    rng = np.random.default_rng([seed, epochs.start])
    tx = (x - net.mean) / net.scale
    weights = [net.w1.copy(), net.b1.copy(), net.w2.copy(), np.array([net.b2])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in epochs:
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            hidden = np.tanh(tx[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            grads = [tx[rows].T @ back + DECAY * weights[0], back.sum(0), hidden.T @ error + DECAY * weights[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(net.mean, net.scale, *weights[:3], float(weights[3][0]))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: A document's inputs beside a table's own columns; a name that no column of documents has.
INPUTS = "_loomwork_inputs"


def with_inputs(documents: DataFrame, vectors: np.ndarray) -> DataFrame:
    """The documents with their inputs of the network, as bytes."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        table, number = shared.value, Numberer()
        for batch in batches:
            inputs = [row.tobytes() for texts in _texts([batch]) for row in pool(table, number, texts).astype("<f4")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inputs, pa.binary())], [*batch.schema.names, INPUTS])

    return documents.mapInArrow(lean(run), StructType([*documents.schema.fields, StructField(INPUTS, BinaryType())]))


def _inputs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, DIM + 2).astype(np.float64)


def _over(rows: DataFrame, each) -> list[np.ndarray]:
    """What ``each`` makes of (part, inputs, labels) of every part of the labelled rows: one array of a fixed size each, in order."""

    def run(batches):
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            part, y, order = (batch.column(c).to_numpy() for c in ("part", "y", "place"))
            x = _inputs(batch.column("x"))
            for p in np.unique(part):
                parts.setdefault(int(p), []).append((x[part == p], y[part == p], order[part == p]))
        for p in list(parts):
            x, y, order = (np.concatenate(a) for a in zip(*parts.pop(p), strict=True))
            order = np.lexsort((x[:, 0], order))  # an order that no partitioning changes
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.asarray(each(x[order], y[order]), "<f8").tobytes()], pa.binary())], ["part", "data"])

    got = rows.mapInArrow(lean(run), "part long, data binary").collect()
    return [np.frombuffer(bytes(r.data), "<f8") for r in sorted(got, key=lambda r: r.part)]


def train(inputs: DataFrame, labels: DataFrame, label: str = "quality", part_rows: int = PART_ROWS) -> Network:
    """A network fitted to all labelled documents outside the held-out fold, given the documents' inputs."""
    usable = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("y").cast("double").alias("y"))
    name = F.col("doc_id").cast("string")
    rows = inputs.select("doc_id", F.col(INPUTS).alias("x")).join(chosen, "doc_id").select("x", "y", F.crc32(F.reverse(name).cast("binary")).alias("place"), F.xxhash64(name).alias("h"))
    rows = cut(rows)
    counts = rows.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    size = DIM + 2
    if not counts.n or counts.good in (0, counts.n):
        net, share = start(np.zeros(size), np.ones(size)), ((counts.good or 0) + 1) / (counts.n + 2)
        net.w2[:], net.b2 = 0, float(np.log(share / (1 - share)))
        drop_cut(rows)
        return net
    n_parts = -(-counts.n // part_rows)
    unseen = F.pmod(F.shiftright("h", 20), F.lit(100)) < int(100 * CALIBRATE)
    dealt = cut(rows.withColumn("part", F.pmod(F.col("h"), F.lit(n_parts))).withColumn("unseen", unseen).repartition(n_parts, "part").drop("h"))
    drop_cut(rows)

    def moments(x, y):
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    n, sums, squares = np.split(sum(_over(dealt, moments)), [1, 1 + size])
    mean = sums / n
    net = start(mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 1e-6)
    seen, rounds = dealt.where("NOT unseen"), ROUNDS if n_parts > 1 else 1
    for r in range(rounds):
        epochs = range(r * EPOCHS // rounds, (r + 1) * EPOCHS // rounds)

        def step(x, y, net=net, epochs=epochs):
            new = fit(net, x, y, epochs)
            return np.concatenate([[len(y)], len(y) * np.concatenate([new.w1.ravel(), new.b1, new.w2, [new.b2]])])

        total = sum(_over(seen, step) or _over(dealt, step))  # a handful of rows may all be unseen ones
        w1, b1, w2, b2 = np.split(total[1:] / total[0], np.cumsum([size * HIDDEN, HIDDEN, HIDDEN]))
        net = Network(net.mean, net.scale, w1.reshape(size, HIDDEN), b1, w2, float(b2[0]))

    def losses(x, y, net=net):
        z = net.logits(x)
        return np.array([np.logaddexp(0, -np.where(y > 0, z, -z) / t).sum() for t in TEMPERATURES])

    if len(found := _over(dealt.where("unseen"), losses)):
        net.temperature = float(TEMPERATURES[int(np.argmin(sum(found)))])
    drop_cut(dealt)
    return net


#: The score beside a table's own columns, before the decision.
SCORE = "_loomwork_score"


def score(inputs: DataFrame, net: Network) -> DataFrame:
    """The rows with their score in place of their inputs."""
    names = [c for c in inputs.columns if c != INPUTS]

    def run(batches):
        for batch in batches:
            scores = pa.array(net(_inputs(batch.column(INPUTS))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), scores], [*names, SCORE])

    return inputs.mapInArrow(lean(run), StructType([*(f for f in inputs.schema.fields if f.name != INPUTS), StructField(SCORE, DoubleType())]))


def scored(documents: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents, doc_id among them, with their scores."""
    inputs = cut(with_inputs(documents, word_vectors(documents)).select(*columns, INPUTS))
    return score(inputs, train(inputs, labels))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(documents.select("doc_id", "text"), labels, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    return scored(documents, labels, documents.columns).where(F.col(SCORE) >= threshold).drop(SCORE)
