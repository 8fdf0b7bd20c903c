"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of words, weighted by TF-IDF over hashed
words. Document frequencies cover all documents. A distributed randomised SVD
(power iterations of A'(A x) over partitions) of every passage of every document
and of the benchmark gives the latent space; nothing is fitted to a sample. It
reads the documents as numbers of hashed words, two bytes each, written once.
Every passage of every document is then compared with the benchmark by cosine,
and candidates are verified: the longest common subsequence of words, weighted by
rarity, must cover enough of the item, or somewhat less of it together with its
answer (the item's last words), as in a paraphrase.

A passage's cosine falls with all that stands beside an item, so it alone would
lose short items of frequent words. Stretches of twice an item's words in which
the words of the item weigh enough for a leak are therefore candidates whatever
their cosine, by an exact index of the items' words.

The benchmark is the query set. It is taken in blocks of BLOCK_ITEMS, each
against all rows; what is sent to executors (block, basis, weights) has a bounded
size. Defined cases: null and empty texts match nothing; items without words are
not looked for; repeated rows each give their pairs once; empty tables give an
empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, lean, release
from .textvec import slices, words

#: Hashed vocabulary, latent dimensions, words of a passage and their step.
BUCKETS, DIM, LENGTH, STEP = 1 << 15, 128, 32, 16
#: Power iterations. Bytes of word numbers, at least, for each task of an iteration, which sends one sum of BUCKETS x DIM.
POWER, FIT_BYTES = 2, 1 << 25
BLOCK_ITEMS = 256
#: Text at once in memory, about.
TEXT_BYTES = 1 << 20
#: Share of the basis (in squares) that the words with the smallest parts may hold to be left out.
SPARE = 0.05
#: Least cosine of a candidate, as a share of the cosine that the item has with itself in the latent space, and at
#: least; covered share of an item that is a leak, alone or with so much of its answer.
COSINE, LOWEST, COVERED, PARAPHRASED, ANSWERED = 0.35, 0.08, 0.6, 0.45, 0.8
ANSWER_WORDS = 8
#: Share of an item's weight, in its most frequent words, that the index leaves out and takes as held.
UNLISTED = 0.25
PAIRS = "item_id {item}, cosine double, covered double, answered double"


def _blocks_of(name: str, array: np.ndarray, n: int) -> pa.RecordBatch:
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([press(np.ascontiguousarray(piece)) for piece in np.split(array, n)], pa.binary())], ["block", "data"])


def _add(dtype: str):
    def run(batches):
        import zstandard

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)
        press = zstandard.ZstdCompressor(level=1).compress
        for b, array in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([press(array.astype(dtype).tobytes())], pa.binary())], ["block", "data"])

    return run


def _gather(rows: DataFrame, n: int, dtype: str, shape: tuple[int, ...], many: bool = False) -> np.ndarray:
    """The sum of arrays of one fixed shape over all partitions; of many partitions, added in salted parts first."""
    import zstandard

    if many:
        rows = rows.withColumn("part", F.spark_partition_id() % 16).repartition(n, "block", "part").select("block", "data").mapInArrow(lean(_add(dtype)), "block int, data binary")
    got = rows.repartition(n, "block").mapInArrow(lean(_add(dtype)), "block int, data binary").collect()  # n rows of a fixed size
    total = np.zeros(shape, dtype).reshape(n, -1)
    for r in got:
        total[r.block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.data)), dtype)
    return total.reshape(shape)


def packed(documents: DataFrame) -> DataFrame:
    """Numbers of the hashed words of all texts, some TEXT_BYTES of text in a row, with the number of words of each text."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for at, n in slices(column, TEXT_BYTES):
                h, counts = words(column.slice(at, n))
                data = (counts.astype("<i8").tobytes(), (h % np.uint64(BUCKETS)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["counts", "words"])

    return documents.select("text").mapInArrow(lean(run), "counts binary, words binary")


def _unpacked(batches):
    for batch in batches:
        for counts, data in zip(batch.column("counts"), batch.column("words"), strict=True):
            yield np.frombuffer(counts.as_buffer(), "<i8"), np.frombuffer(data.as_buffer(), "<u2")


def frequencies(streams: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """In how many documents each hashed word occurs, and the numbers of documents, words and passages."""

    def count(batches):
        total = np.zeros(BUCKETS + 64, np.int64)
        for counts, bucket in _unpacked(batches):
            pairs = np.sort(np.repeat(np.arange(len(counts)), counts) * BUCKETS + bucket)
            total[:BUCKETS] += np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % BUCKETS, minlength=BUCKETS)
            total[BUCKETS : BUCKETS + 3] += len(counts), len(bucket), _passages_in(counts).sum()
        yield _blocks_of("df", total, 8)

    total = _gather(streams.mapInArrow(lean(count), "block int, data binary"), 8, "<i8", (BUCKETS + 64,), many=True)
    return total[:BUCKETS], *(int(x) for x in total[BUCKETS : BUCKETS + 3])


def _passages_in(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.maximum(0, -(-(counts - LENGTH) // STEP)), 0)


def passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of the passages of texts laid end to end; the last one of a text ends with it."""
    ends = np.cumsum(counts)
    n = _passages_in(counts)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(k * STEP, np.maximum(counts[text] - LENGTH, 0))
    return text, (ends - counts)[text] + first, np.minimum(counts[text], LENGTH)


def _expand(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all passages, and where each passage begins among them."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0), ends - length


def _project(bucket: np.ndarray, weight: np.ndarray, first: np.ndarray, length: np.ndarray, basis: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """TF-IDF passages times ``basis``; only words that are ``held`` have a part in it."""
    out = np.zeros((len(first), basis.shape[1]), np.float32)
    for at in range(0, len(first), 1024):
        n = length[at : at + 1024]
        which, _ = _expand(first[at : at + 1024], n)
        of = np.repeat(np.arange(at, at + len(n)), n)
        if held is not None:
            own = held[bucket[which]]
            which, of = which[own], of[own]
        if len(which):
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[begin]] = np.add.reduceat(basis[bucket[which]] * weight[which, None], begin, axis=0)
    return out


def _norms(bucket: np.ndarray, weight: np.ndarray, first: np.ndarray, length: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Norms of TF-IDF passages, and of their parts in words that are ``held``; a word's repeats in a passage add up before they are squared."""
    which, _ = _expand(first, length)
    key = np.repeat(np.arange(len(first)), length) * BUCKETS + bucket[which]
    order = np.argsort(key)
    key, w = key[order], weight[which][order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(w, begin) if len(begin) else np.zeros(0, np.float32)
    passage, square = key[begin] // BUCKETS, sums.astype(np.float64) ** 2
    whole = np.sqrt(np.bincount(passage, square, len(first)))
    return whole, whole if held is None else np.sqrt(np.bincount(passage, square * held[key[begin] % BUCKETS], len(first)))


def _start(dim: int) -> np.ndarray:
    """The random matrix that the iterations start from."""
    rng, out = np.random.default_rng(3), np.empty((BUCKETS, dim), np.float32)
    for rows in np.split(out, 16):  # drawn in double precision, a part at a time
        rows[:] = rng.normal(size=rows.shape)
    out /= np.float32(BUCKETS**0.5)
    return out


def grid_of(bucket: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The passages of texts as pairs of blocks of STEP words: the blocks, filled up by BUCKETS and with an empty one at
    the end; whether a block ends its text; for each passage its two blocks, its text and its first word.

    A last passage that begins between blocks has two blocks of its own, behind those of the texts.
    """
    ends = np.cumsum(counts)
    uneven = (counts > LENGTH) & (counts % STEP > 0)
    tails = np.flatnonzero(uneven)
    begin = np.concatenate([ends - counts, ends[tails] - LENGTH])
    n = np.concatenate([counts, np.full(len(tails), LENGTH, counts.dtype)])
    flat = np.concatenate([bucket, bucket[(begin[len(counts) :, None] + np.arange(LENGTH)).ravel()]])
    own = -(-n // STEP)
    until = np.cumsum(own)
    grid = np.full((int(until[-1] if len(until) else 0) + 1) * STEP, BUCKETS, np.uint16)
    grid[np.arange(len(flat)) + np.repeat((until - own) * STEP - (np.cumsum(n) - n), n)] = flat
    grid = grid.reshape(-1, STEP)
    of = np.repeat(np.arange(len(n)), own)
    last = np.zeros(len(grid), bool)
    last[until[own > 0] - 1] = True
    last[-1] = True
    first = np.flatnonzero(~last[:-1] | (own[of] == 1))
    text = of[first]
    k = first - (until - own)[text]
    even = np.concatenate([~uneven, np.ones(len(tails), bool)])
    kept = even[text] | (k < own[text] - 2)
    first, text, k = first[kept], text[kept], k[kept]
    second = np.where(own[text] == 1, len(grid) - 1, first + 1)
    return grid, last, first, second, np.concatenate([np.arange(len(counts)), tails])[text], begin[text] + k * STEP


def _stretches(grid: np.ndarray, last: np.ndarray, first: np.ndarray, second: np.ndarray, most: int = 1 << 14):
    """The passages in stretches of neighbours, with the blocks of each and an empty one at their end."""
    for at in range(0, len(first), most):
        f, s = first[at : at + most], second[at : at + most]
        stop = int(max(f[-1], s[s < len(grid) - 1].max(initial=0))) + 1
        blocks = np.concatenate([grid[f[0] : stop], grid[-1:]])
        yield at, blocks, np.concatenate([last[f[0] : stop], last[-1:]]), f - f[0], np.where(s < len(grid) - 1, s - f[0], len(blocks) - 1)


def _sums(rows: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each row of ``grid`` the sum of the rows that it numbers."""
    out, buffer = np.empty((len(grid), rows.shape[1]), np.float32), np.empty((256, rows.shape[1]), np.float32)
    for at in range(0, len(grid), 256):
        which = grid[at : at + 256].astype(np.intp, copy=False)
        total, part = out[at : at + 256], buffer[: len(which)]
        np.take(rows, which[:, 0], axis=0, out=total, mode="clip")
        for j in range(1, grid.shape[1]):
            np.take(rows, which[:, j], axis=0, out=part, mode="clip")
            total += part
    return out


def _by_word(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of blocks in order, and the block of each."""
    flat = grid.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[: np.searchsorted(flat[order], BUCKETS)]
    return flat[order].astype(np.int64), order // grid.shape[1]


def _norms_of(grid: np.ndarray, last: np.ndarray, first: np.ndarray, second: np.ndarray, square: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_norms`, for passages as pairs of blocks: squares of words, and twice those of pairs of one word."""
    word, block = _by_word(grid)
    weights = [square[word].astype(np.float64)]
    if held is not None:
        weights.append(weights[0] * held[word])
    inside, across = [np.bincount(block, w, len(grid)) for w in weights], [np.zeros(len(grid)) for _ in weights]
    at = np.flatnonzero((word[1:] == word[:-1]) & (block[1:] - block[:-1] <= 1))
    for lag in range(1, 2 * STEP):
        at = at[: np.searchsorted(at, len(word) - lag)]
        step = block[at + lag] - block[at]
        near = (word[at + lag] == word[at]) & ((step == 0) | ((step == 1) & ~last[block[at]]))
        at, step = at[near], step[near]
        if not len(at):
            break
        for k, w in enumerate(weights):
            inside[k] += np.bincount(block[at], 2 * w[at] * (step == 0), len(grid))
            across[k] += np.bincount(block[at], 2 * w[at] * (step == 1), len(grid))
    got = [np.sqrt(a[first] + a[second] + b[first]) for a, b in zip(inside, across, strict=True)]
    return got[0], got[-1]


def _scatter(grid: np.ndarray, parts: np.ndarray, total: np.ndarray, width: int = 8) -> None:
    """Adds to each word's row of ``total`` the ``parts`` of the blocks that it stands in, for each time it does."""
    word, block = _by_word(grid)
    parts = np.concatenate([parts, np.zeros((1, parts.shape[1]), np.float32)])
    while len(word):
        begin = np.flatnonzero(np.diff(word, prepend=-1) > 0)
        n = np.diff(np.append(begin, len(word)))
        once = begin[n == 1]
        total[word[once]] += parts[block[once]]
        more = np.repeat(n > 1, n)
        word, block, n = word[more], block[more], n[n > 1]
        begin, rows = np.cumsum(n) - n, -(-n // width)
        until = np.cumsum(rows)
        meet = np.full((int(until[-1]) if len(until) else 0) * width, len(parts) - 1, np.int64)
        meet[np.arange(len(word)) + np.repeat((until - rows) * width - begin, n)] = block
        word = np.repeat(word[begin], rows)
        parts = np.concatenate([_sums(parts, meet.reshape(-1, width)), parts[-1:]])
        block = np.arange(len(word))


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of a basis times their words' IDF, and a row of zeros for what fills up blocks."""
    out = np.zeros((len(x) + 1, x.shape[1]), np.float32)
    np.multiply(x, idf[:, None], out=out[:-1], dtype=np.float32)
    return out


def _images(bucket: np.ndarray, counts: np.ndarray, idf: np.ndarray, x: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` A'(A x) of the texts' passages, as TF-IDF rows of norm one; ``x`` and ``total`` lack the words' own IDF."""
    square = np.append(idf * idf, np.float32(0))
    grid, last, first, second, *_ = grid_of(bucket, counts)
    for _, blocks, ends, f, s in _stretches(grid, last, first, second):
        scale = 1 / np.maximum(_norms_of(blocks, ends, f, s, square)[0], 1e-9)
        own = _sums(x, blocks)
        y = own[f]
        y += own[s]
        y *= (scale * scale)[:, None].astype(np.float32)
        parts = np.zeros_like(own)
        parts[f] += y  # every block is the first of one passage and the second of one at most
        parts[s] += y
        _scatter(blocks, parts, total)


def latent_basis(streams: DataFrame, items: list[np.ndarray], weight: float, idf: np.ndarray, tasks: int, dim: int = DIM, power: int = POWER) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages of all documents and, ``weight`` times, of the items, by randomised power iteration."""
    spark = streams.sparkSession

    def step(shared):
        def run(batches):
            idf, x = shared.value
            x, total = _weighted(_start(dim) if x is None else x, idf), np.zeros((BUCKETS, dim), np.float32)
            for counts, bucket in _unpacked(batches):
                _images(bucket, counts, idf, x, total)
            del x  # not held while the sums are packed
            yield _blocks_of("z", total, 16)

        return run

    x = None  # every task can make the first matrix; later ones are sent in half precision, and dropped after use
    for _ in range(power):
        shared = spark.sparkContext.broadcast((idf, x))
        z = _gather(streams.coalesce(tasks).mapInArrow(lean(step(shared)), "block int, data binary"), 16, "<f4", (BUCKETS, dim), many=True)
        shared.destroy()
        own = np.zeros((BUCKETS, dim), np.float32)
        _images((np.concatenate(items) % np.uint64(BUCKETS)).astype(np.int64), np.array([len(h) for h in items]), idf, _weighted(_start(dim) if x is None else x, idf), own)
        own *= np.float32(weight * weight)
        z += own
        z *= idf[:, None]
        del own
        basis, values, _ = np.linalg.svd(z, full_matrices=False)
        del z
        x = basis.astype(np.float16)
        release()
    basis = basis * (values > 1e-6 * max(1e-30, values.max()))
    # Words with next to no part in the space leave it: it is as sparse as the passages that span it.
    square = np.sort((basis * basis).sum(axis=1))
    least = square[np.searchsorted(np.cumsum(square), SPARE * square.sum())]
    return basis * ((basis * basis).sum(axis=1) >= least)[:, None]


def covered(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Shares of the item's weight in its heaviest common subsequence with the region, and of its last words in that of theirs.

    A subsequence weighs no more than the words that both have: where these are
    too few for a leak, their share is returned and nothing is aligned.
    """
    common = (item[:, None] == region[None, :]).any(axis=1)
    bound = float(weight[common].sum() / max(weight.sum(), 1e-9))
    if bound < PARAPHRASED:
        return bound, 0.0

    def share(words_: np.ndarray, w: np.ndarray) -> float:
        best = np.zeros(len(region) + 1)
        for word, x in zip(words_, w, strict=True):
            hit = np.concatenate([[0.0], np.where(region == word, best[:-1] + x, 0.0)])
            best = np.maximum.accumulate(np.maximum(best, hit))
        return float(best[-1] / max(w.sum(), 1e-9))

    return share(item, weight), share(item[-ANSWER_WORDS:], weight[-ANSWER_WORDS:])


def leaking(whole: float, answer: float) -> bool:
    return whole >= COVERED or (whole >= PARAPHRASED and answer >= ANSWERED)


def word_index(items: list[tuple[object, np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted words of the items; where the entries of each begin; the items and weights of entries; least weight and blocks of STEP words by item."""
    word, of, weight = [], [], []
    least, blocks = np.zeros(len(items)), np.zeros(len(items), np.int64)
    for i, (_, h) in enumerate(items):
        distinct, times = np.unique(h, return_counts=True)
        rarity = idf[(distinct % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)
        order = np.argsort(-rarity, kind="stable")
        w = (rarity * times)[order]
        listed = min(len(w), 1 + int(np.searchsorted(np.cumsum(w), (1 - UNLISTED) * w.sum())))
        word.append(distinct[order][:listed])
        of.append(np.full(listed, i))
        weight.append(w[:listed])
        least[i] = (PARAPHRASED - 1e-4) * w.sum() - w[listed:].sum()
        # Any 2 * len(h) words lie in so many blocks.
        blocks[i] = -(-(2 * len(h) + STEP - 1) // STEP)
    flat, item, weights = np.concatenate(word), np.concatenate(of), np.concatenate(weight)
    order = np.argsort(flat, kind="stable")
    known, begin = np.unique(flat[order], return_index=True)
    return known, np.append(begin, len(flat)), item[order], weights[order], least, blocks


class Held:
    """Where in texts the listed words of items stand: their weights by item and block of STEP words, summed up in order."""

    def __init__(self, h: np.ndarray, bucket: np.ndarray, counts: np.ndarray, index: tuple[np.ndarray, ...]) -> None:
        known, begin, item, weight, self.least, self.blocks = index
        likely = np.zeros(BUCKETS, bool)
        likely[(known % np.uint64(BUCKETS)).astype(np.int64)] = True
        at = np.flatnonzero(likely[bucket])
        where = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        at, where = at[known[where] == h[at]], where[known[where] == h[at]]
        self.starts = np.cumsum(counts) - counts
        self.own = -(-counts // STEP)
        self.ends = np.cumsum(self.own)
        text = np.searchsorted(np.cumsum(counts), at, "right")
        key = np.unique(((self.ends - self.own)[text] + (at - self.starts[text]) // STEP) * len(known) + where)
        block, where = np.divmod(key, len(known))
        times = begin[where + 1] - begin[where]
        last = np.cumsum(times)
        entry = np.repeat(begin[where] - (last - times), times) + np.arange(times.sum())
        self.n = int(self.ends[-1]) if len(counts) else 0
        self.key, place = np.unique(item[entry] * self.n + np.repeat(block, times), return_inverse=True)
        self.total = np.concatenate([[0.0], np.cumsum(np.bincount(place, weight[entry]))])

    def may_leak(self, text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the listed words of items within words ``low`` to ``high`` of a text can reach the least weight."""
        base = item * self.n + (self.ends - self.own)[text]
        first, until = base + (low - self.starts[text]) // STEP, base - (-(high - self.starts[text]) // STEP)
        return self.total[np.searchsorted(self.key, until)] - self.total[np.searchsorted(self.key, first)] >= self.least[item] - 1e-9


def holding(held: Held) -> dict[tuple[int, int], list[int]]:
    """By text and item, the first words of all windows in which listed words of the item reach its least weight."""
    if not len(held.key):
        return {}
    starts, own, ends, n, key, total, least, blocks = held.starts, held.own, held.ends, held.n, held.key, held.total, held.least, held.blocks
    item, block = np.divmod(key, n)
    text = np.searchsorted(ends, block, "right")
    # The blocks of a window end with its text; a word found in two of them counts twice, so nothing is passed over.
    until = np.searchsorted(key, item * n + np.minimum(block + blocks[item], ends[text]), "left")
    enough = total[until] - total[:-1] >= least[item]
    out: dict[tuple[int, int], list[int]] = {}
    for t, i, b in zip(text[enough].tolist(), item[enough].tolist(), block[enough].tolist(), strict=True):
        out.setdefault((t, i), []).append(int(starts[t]) + (b - int(ends[t] - own[t])) * STEP)
    return out


def covering(own: np.ndarray, h: np.ndarray, weight: np.ndarray, firsts: list[int], size: int, end: int) -> tuple[int, float, float] | None:
    """First word and shares of the first leaking window among those that begin at ``firsts``."""
    runs: list[list[int]] = []
    for first in firsts:
        if runs and first <= min(runs[-1][-1] + size, runs[-1][0] + (1 << 16)):
            runs[-1].append(first)
        else:
            runs.append([first])
    for run in runs:
        # A window's words bound what is covered in it, as in covered().
        ends = np.minimum(end, np.array(run) + size) - run[0]
        met = np.concatenate([np.zeros((len(own), 1), np.int32), np.cumsum(own[:, None] == h[run[0] : run[0] + int(ends[-1])], axis=1, dtype=np.int32)], axis=1)
        bound = weight.astype(np.float64) @ (met[:, ends] > met[:, np.array(run) - run[0]])
        for first in np.array(run)[bound >= (PARAPHRASED - 1e-4) * weight.sum()].tolist():
            whole, answer = covered(own, h[first : min(end, first + size)], weight)
            if leaking(whole, answer):
                return first, whole, answer
    return None


def search(documents: DataFrame, items: list[tuple[object, np.ndarray]], idf: np.ndarray, basis: np.ndarray, item_kind: str, threshold: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, covered, answered: the pairs that leak, for one block of items."""
    spark = documents.sparkSession
    counts = np.array([len(h) for _, h in items])
    flat = np.concatenate([h for _, h in items])
    bucket = (flat % np.uint64(BUCKETS)).astype(np.int64)
    text, first, length = passages(counts)
    latent = _project(bucket, idf[bucket], first, length, basis)
    own = np.linalg.norm(latent, axis=1)
    latent /= np.maximum(own[:, None], 1e-9)
    # What the space keeps of an item bounds every cosine with it: each item has its own threshold.
    least = np.maximum(LOWEST, threshold * own / np.maximum(_norms(bucket, idf[bucket], first, length)[0], 1e-9))
    held = (basis != 0).any(axis=1)
    rows = np.flatnonzero(held)
    shared = spark.sparkContext.broadcast((items, idf, rows, basis[rows].astype(np.float16), latent, text, least, word_index(items, idf)))

    def run(batches):
        items, idf, rows, halves, latent, of_item, least, index = shared.value
        held, basis, square = np.zeros(BUCKETS, bool), np.zeros((BUCKETS + 1, halves.shape[1]), np.float32), np.append(idf * idf, np.float32(0))
        bound = least.astype(np.float32)
        held[rows], basis[rows] = True, halves * idf[rows, None]
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            found: list[tuple] = []
            for at, n in slices(column, TEXT_BYTES):
                h, counts = words(column.slice(at, n))
                bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
                grid, last, first, second, text, where = grid_of(bucket, counts)
                near: dict[tuple[int, int], list[tuple[float, int]]] = {}
                for a, blocks, last_of, f, s in _stretches(grid, last, first, second):
                    # A cosine is at most the share of a passage's norm that lies in words of the space.
                    norm, inside = _norms_of(blocks, last_of, f, s, square, held)
                    likely = np.flatnonzero((inside >= least.min() * norm) & (norm > 0))
                    used = np.zeros(len(blocks), bool)
                    used[f[likely]] = used[s[likely]] = True
                    place, own = np.cumsum(used) - 1, _sums(basis, blocks[used])
                    for c in range(0, len(likely), 2048):
                        some = likely[c : c + 2048]
                        passage = (own[place[f[some]]] + own[place[s[some]]]) / norm[some, None].astype(np.float32)
                        cosine = passage @ latent.T
                        for p, q in zip(*np.divmod(np.flatnonzero(cosine >= bound), len(bound)), strict=True):
                            at_ = a + some[p]
                            near.setdefault((int(text[at_]), int(of_item[q])), []).append((float(cosine[p, q]), int(where[at_])))
                starts = np.cumsum(counts) - counts
                leaked: set[tuple[int, int]] = set()
                held_words = Held(h, bucket, counts, index)
                stretches = []
                for (t, i), passages_ in near.items():
                    more = 2 * len(items[i][1])
                    stretches += [(t, i, max(starts[t], low - more), min(starts[t] + counts[t], high + LENGTH + more), c) for c, (low, high) in _regions(passages_)]
                if stretches:
                    may = held_words.may_leak(*np.array([x[:4] for x in stretches], np.int64).T)
                    for t, i, low, high, c in (stretches[k] for k in np.flatnonzero(may)):
                        if (t, i) not in leaked:
                            own = items[i][1]
                            whole, answer = covered(own, h[low:high], idf[(own % np.uint64(BUCKETS)).astype(np.int64)])
                            if leaking(whole, answer):
                                found.append((at + t, i, c, whole, answer))
                                leaked.add((t, i))
                for (t, i), firsts in holding(held_words).items():
                    if (t, i) in leaked:
                        continue
                    name, own = items[i]
                    size, end = int(index[-1][i]) * STEP, int(starts[t] + counts[t])
                    if hit := covering(own, h, idf[(own % np.uint64(BUCKETS)).astype(np.int64)], firsts, size, end):
                        low, high = hit[0], min(end, hit[0] + size)
                        _, begin, n_words = passages(np.array([high - low]))
                        y = _project(bucket, np.ones(len(bucket), np.float32), low + begin, n_words, basis, held) @ latent[of_item == i].T
                        c = float((y / np.maximum(_norms(bucket, idf[bucket], low + begin, n_words)[0], 1e-9)[:, None]).max())
                        found.append((at + t, i, c, hit[1], hit[2]))
            best: dict[tuple[int, int], tuple] = {}
            for row in found:
                best[row[:2]] = max(best.get(row[:2], row), row, key=lambda r: r[3])
            hits = list(best.values())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in hits], pa.int64())), pa.array([items[r[1]][0] for r in hits]), *[pa.array([round(r[k], 6) for r in hits], pa.float64()) for k in (2, 3, 4)]], ["doc_id", "item_id", "cosine", "covered", "answered"]).cast(pa.schema([("doc_id", ids.type), ("item_id", pa.int64() if item_kind == "bigint" else pa.string()), ("cosine", pa.float64()), ("covered", pa.float64()), ("answered", pa.float64())]))

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, " + PAIRS.format(item=item_kind))


def _regions(near: list[tuple[float, int]]):
    """Stretches of neighbouring passages, the best cosine of each first."""
    out: list[list] = []
    for c, at in sorted(near, key=lambda x: x[1]):
        if out and at - out[-1][1][1] <= LENGTH:
            out[-1] = [max(out[-1][0], c), (out[-1][1][0], at)]
        else:
            out.append([c, (at, at)])
    return sorted(out, key=lambda r: -r[0])


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, covered, answered for each document that holds a benchmark item."""
    item_kind = "bigint" if dict(benchmark.dtypes)["item_id"] in ("bigint", "int") else "string"
    empty = documents.sparkSession.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, " + PAIRS.format(item=item_kind))
    block, out, corpus = [], None, None
    rows = benchmark.where("item_id IS NOT NULL AND length(text) > 0").select(F.col("item_id").cast(item_kind).alias("item_id"), "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        h, _ = words(pa.array([r.text]))
        if len(h):
            block.append((r.item_id, h))
        if len(block) == BLOCK_ITEMS:
            corpus = corpus or _corpus(documents)
            out, block = _block(documents, block, corpus, item_kind, threshold, out), []
    if block:
        corpus = corpus or _corpus(documents)
        out = _block(documents, block, corpus, item_kind, threshold, out)
    if corpus:
        drop_cut(corpus[0])
    return empty if out is None else out


def _corpus(documents: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, int, int, int]]:
    streams = cut(packed(documents))
    return streams, frequencies(streams)


def _block(documents: DataFrame, block: list[tuple], corpus: tuple, item_kind: str, threshold: float, before: DataFrame | None) -> DataFrame:
    streams, (seen, n, n_words, n_passages) = corpus
    idf = np.log((n + 1) / (seen + 0.5)).clip(0.01).astype(np.float32)
    # The benchmark's passages weigh as much as the corpus four times over: the space is theirs first.
    weight = 2.0 * (max(1, n_passages) / int(_passages_in(np.array([len(h) for _, h in block])).sum())) ** 0.5
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, 2 * n_words // FIT_BYTES)
    basis = latent_basis(streams, [h for _, h in block], weight, idf, tasks)
    found = search(documents, block, idf, basis, item_kind, threshold)
    return found if before is None else before.unionByName(found)


#: What leaking texts are known by beside a table's own columns; a name that no column of documents has.
LEAK = "_loomwork_leaking_text"


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; rows meet by their texts, whatever their ids."""
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    bad = leaks(documents.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(LEAK)).distinct()
    return documents.join(bad, key == F.col(LEAK), "left_anti").select(documents.columns)
