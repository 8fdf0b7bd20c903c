"""Jaccard join of documents on word shingles, exact, as a metric-space join.

1. Equal shingle sets are one node (a 128-bit digest); nothing else is done per copy.
2. Coarse regions, without losing a link: nodes of one or two neighbouring size
   classes deal their shingles by hash into more parts than two linked sets can
   differ in, with some to spare, so a linked pair agrees in several parts.
   Chains over equal parts give the regions: unrelated texts are all at distance 1
   from every pivot, so that pivots alone could not tell them apart. Parts (or pairs
   of parts, for short texts) of one or of hot shingles are left out where the parts
   to spare allow it. Hot shingles come from counters of a fixed number.
3. Every region, whatever its size, is joined in the Jaccard metric by pivots.
   About half the root of its nodes are pivots, the nodes with the least hashes.
   Nodes are compared with the pivots in as many tasks as the region asks for; a
   node belongs to the Voronoi cell of its nearest pivot (of equally near ones,
   the one its hash picks) and is copied to each cell whose pivot is no more than
   two radii farther away than its own: by the triangle inequality every partner
   of a cell's own nodes is then in the cell. A node with no pivot nearer than
   1 - 2 radii would go to every cell; in regions where that is more than its rarest
   shingles, of which it shares one with each partner, it goes to a cell for each of
   these, and so do nodes that are near enough to link with such a node. A pair with a
   far node is met there, in the cell of the least shingle it shares, any other pair by
   windows.
4. Cells are joined again in tasks of their own, split by the same rule in memory
   as long as that saves comparisons; a cell with very many nodes is dealt to several
   tasks, each of a part of its own nodes and a part of all. Each link is met from
   either end, once.
5. Links meet in a distributed components computation, their numbers in a sum.

Defined cases: null and empty texts have no shingles and stay alone; a document
with fewer words than a shingle has its whole sequence as one; very long texts are
sets like any other, read in slices of bounded bytes (one text at least); repeated
rows are equal sets and link with each other; ties between pivots fall by hash;
rows without an id link like others but lend no id to a component; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, lean, release, small_batches
from .graph import components
from .textvec import slices

#: Bytes of input for each route of the part shuffle.
ROUTE_BYTES, LEAST, PARTITIONS = 2 << 20, 16, 1 << 15
#: Linked nodes of several routes that a task of chains holds before it passes them on.
CHAINED = 1 << 17
#: Size classes with at most so many parts chain over pairs of parts, drawn within GROUPS groups of them.
PAIRED, GROUPS = 32, 3
#: Nodes of a cell, and of its own nodes, that are dealt to one task; shingles of either, and of the nodes that a task compares with pivots.
CELL_NODES, OWN_NODES, TASK_SHINGLES = 1024, 1 << 14, 1_000_000
#: Shingles of all copies that a task of comparisons writes, and of those that it writes at once.
COPIED_SHINGLES, WRITTEN_SHINGLES = 4_000_000, 1 << 18
#: Rows in a batch that workers get, and where rows hold a route's parts of many texts: a few MB at a time.
BATCH_ROWS, ROUTE_ROWS = 1000, 64
#: A region goes by rare shingles where it has more than so many pivots for each of them that a node has.
RARE = 1.0
#: Comparisons at a time, and own nodes below which a cell is not split again.
BLOCK, LEAF = 1 << 20, 32
#: Counters of shingle frequency over all documents (2 to this many), kept and sent in blocks; a shingle is hot whose counter is so many times the mean.
COUNTER_BITS, COUNTER_BLOCKS, HOT = 21, 32, 4
#: Parts that a large region's rows meet its numbers in; a name that no column of documents has.
SALTS, KEY = 16, "_loomwork_text_key"
_ALL = (1 << 64) - 1
_PARTS: dict[tuple[int, int], tuple[int, int]] = {}
_CACHE, _FLUSH = 150_000, 1 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[2]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle hashes of texts: ASCII letters lower-cased, words split at ASCII white space."""

    def __init__(self, words: int) -> None:
        self.k, self.known = words, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order, repeats included, and the number for each text."""
        import xxhash

        if len(self.known) > _CACHE:
            self.known.clear()
        known, digest, out, counts = self.known, xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.encode().lower().split() if text else ()
            counts[i] = len(words)
            for w in words:
                h = known.get(w)
                if h is None:
                    known[w] = h = digest(w)
                out.append(h)
        hashes, k = np.array(out, np.uint64), self.k
        n = len(hashes) - k + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            rolled += hashes[j : j + len(rolled)] * _ODD[j % 8]
        ends = np.cumsum(counts)
        starts, made = ends - counts, np.maximum(counts - k + 1, 0)
        keep = np.zeros(max(n, 0) + 1, np.int64)
        np.add.at(keep, starts[made > 0], 1)
        np.add.at(keep, (starts + made)[made > 0], -1)
        shingles = _mix(rolled[np.cumsum(keep[:-1]) > 0])
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            at, whole = np.cumsum(made)[short] - made[short], []
            for i in short:
                part = hashes[starts[i] : ends[i]]
                whole.append((part * _ODD[: len(part)]).sum(dtype=np.uint64) ^ np.uint64(len(part)))
            shingles = np.insert(shingles, at, _mix(np.array(whole, np.uint64)))
            made[short] = 1
        return shingles, made

    def sets(self, texts: list[str | None]):
        """The sorted distinct shingles of each text."""
        shingles, made = self(texts)
        ends = np.cumsum(made)
        for end, n in zip(ends.tolist(), made.tolist(), strict=True):
            yield np.unique(shingles[end - n : end])


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rarest(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, by hash: linked sets share so much that of so many each they share one."""
    keep = len(shingles) - (percent * len(shingles) + 99) // 100 + 1
    return np.sort(shingles[np.lexsort((shingles, levels[_counter(shingles)]))[:keep]])


def digest_of(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _texts(batch, most: int = 4 << 20):
    """Slices of a batch or table with few enough bytes of text to handle at once."""
    for chunk in batch.to_batches() if isinstance(batch, pa.Table) else (batch,):
        for at, n in slices(chunk.column("text"), most):
            part = chunk.slice(at, n)
            yield part, part.column("text").to_pylist()


def size_class(n: int, percent: int) -> int:
    """Sets that link are in one class or in neighbouring ones: class c ends where sizes are (100 / percent) ** (c + 1)."""
    c = int(math.log(n) / math.log(100 / percent) + 1e-9)
    return c


def parts_of(c: int, percent: int) -> tuple[int, int]:
    """Parts for pairs of classes c and c + 1 (or c alone), and the empty parts that are one too many."""
    if (c, percent) in _PARTS:
        return _PARTS[c, percent]
    top = math.ceil((100 / percent) ** (c + 1)) + 1
    differ = (100 - percent) * (top + top * 100 // percent + 1) // (100 + percent)
    parts = differ + 4
    for _ in range(8):
        empty = parts * math.exp(-((100 / percent) ** c) / parts)
        parts = differ + 4 + math.ceil(empty + 3 * math.sqrt(empty))
    _PARTS[c, percent] = parts, parts - differ
    return _PARTS[c, percent]


def signatures(shingles: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """Hashes of the set's parts that hold shingles, for its own class and the one below.

    Linked sets agree in at least ``limit`` parts, and a part's content decides what
    it is to both. Many parts: those with fewer than two cold shingles are weak; a
    set with fewer weak parts than ``limit`` agrees with each partner in a strong
    one. Few parts: of more than GROUPS agreeing parts two are in one group, so
    sets chain over pairs of cold parts. A set that has too many weak parts for
    that adds what is weaker: its single cold parts, then hot ones and its class.
    Everyone sends the strong hashes, so such a set still meets all others.
    """
    c, out = size_class(len(shingles), percent), []
    mixed, cold = _mix(shingles), ~hot[_counter(shingles)]
    for k in (c, c - 1):
        if k < 0:
            continue
        parts, limit = parts_of(k, percent)
        at = ((shingles >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, mixed)
        n_cold = np.bincount(at[cold], minlength=parts)
        salt = np.uint64(int(_ODD[4]) * (2 * k + 1) & _ALL)
        single = _mix(sums * _ODD[5] + np.arange(parts, dtype=np.uint64) * _ODD[6] + salt)
        full = np.flatnonzero(n_cold)
        if parts <= PAIRED:
            enough = parts - len(full) < limit - GROUPS
            for g in range(GROUPS):
                own = full[full % GROUPS == g]
                x, y = np.triu_indices(len(own), 1)
                out.append(_mix(single[own[x]] * _ODD[1] + single[own[y]]))
        else:
            strong = np.flatnonzero(n_cold > 1)
            enough = parts - len(strong) < limit
            out.append(single[strong])
        if enough:
            continue
        out.append(single[full])
        if parts - len(full) >= limit:  # so many empty or hot parts that these alone might agree: such sets meet by their class too
            out.append(single[np.flatnonzero(np.bincount(at, minlength=parts))])
            out.append(_mix(np.array([int(salt) ^ 0xE], np.uint64)))
    return np.unique(np.concatenate(out))


def _pair(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


class Forest:
    """Union-find over numbered nodes; the least number is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _routes(documents: DataFrame) -> int:
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = ROUTE_BYTES * documents.rdd.getNumPartitions() if size >= 1 << 50 else size
    return max(LEAST, size // ROUTE_BYTES + 1)


def _tasks(documents: DataFrame) -> int:
    return min(PARTITIONS, max(LEAST, _routes(documents.select("text")) // 4))


def node_table(documents: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, key (a hash of the text), n_shingles and node (the digest of the set, null without shingles), written once; and a byte for each counter: its size (4 log2, 0: one document at most), and 128 if it is hot.

    One pass over the texts gives both: a partition's counters follow its rows.
    """
    kind = dict(documents.dtypes)["doc_id"]
    names = ["doc_id", "key", "n_shingles", "node", "block", "data"]

    def each(batches):
        import zstandard

        shingler, total = Shingler(words), np.zeros(1 << COUNTER_BITS, np.int32)
        seen = None
        for batch in batches:
            for part, texts in _texts(batch):
                n, node, sets = [], [], []
                for s in shingler.sets(texts):
                    n.append(len(s))
                    node.append(digest_of(s) if len(s) else None)
                    sets.append(s)
                np.add.at(total, _counter(np.concatenate(sets)), 1)
                seen = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([seen, part.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if seen is not None:
            press = zstandard.ZstdCompressor(level=1).compress
            for b, counts in enumerate(np.split(total, COUNTER_BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, seen.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([b], pa.int32()), pa.array([press(counts.astype("<i8").tobytes())], pa.binary())], names)

    def add(batches):
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
        press = zstandard.ZstdCompressor(level=1).compress
        for b, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([press(counts.tobytes())], pa.binary())], ["block", "data"])

    def mark(batches):
        for batch in add(batches):
            import zstandard

            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("data")[0].as_py()), "<i8")
            level = np.minimum(np.ceil(4 * np.log2(np.maximum(counts, 1))), 127).astype(np.uint8)
            marked = level | ((counts > HOT * counts.mean() + 8).astype(np.uint8) << np.uint8(7))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([marked.tobytes()], pa.binary())], ["block", "data"])

    written = cut(documents.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(lean(each), f"doc_id {kind}, key bigint, n_shingles bigint, node binary, block int, data binary"))
    packed = "block int, data binary"
    counters = written.where("block IS NOT NULL").select("block", "data", F.pmod(F.xxhash64("data"), F.lit(16)).alias("part"))
    # In parts first: however many tasks there were, no task adds them all.
    counters = counters.repartition(COUNTER_BLOCKS, "block", "part").select("block", "data").mapInArrow(lean(add), packed)
    marks = np.zeros(1 << COUNTER_BITS, np.uint8)
    size = len(marks) // COUNTER_BLOCKS
    for r in counters.repartition(COUNTER_BLOCKS, "block").mapInArrow(lean(mark), packed).collect():  # COUNTER_BLOCKS rows of bytes
        marks[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(r.data), np.uint8)
    return written.where("block IS NULL").select("doc_id", "key", "n_shingles", "node"), marks


def candidates(documents: DataFrame, marks: np.ndarray, words: int, percent: int) -> DataFrame:
    """Links a, b of nodes that agree in a part and are near in size: chains, not pairs."""
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(marks >> np.uint8(7)))  # a bit for each counter
    routes = _routes(documents.select("text"))

    def spread(batches):
        shingler, common = Shingler(words), np.unpackbits(shared.value).astype(bool)
        nodes: dict[bytes, int] = {}
        sizes: list[int] = []
        found_parts: list[np.ndarray] = []
        held = 0

        def flush():
            h = np.concatenate(found_parts)
            of = np.repeat(np.arange(len(found_parts), dtype=np.uint32), [len(r) for r in found_parts])
            route = (h % np.uint64(routes)).astype(np.int64)
            order = np.lexsort((h, route))
            h, of, route = h[order], of[order], route[order]
            names, n = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 16), np.array(sizes, "<u4")
            begin = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            for low, high in zip(begin.tolist(), np.append(begin[1:], len(route)).tolist(), strict=True):
                own = slice(low, high)
                which, short = np.unique(of[own], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([route[low]], pa.int64()), pa.array([h[own].astype("<u8").tobytes()], pa.binary()), pa.array([short.astype("<u4").tobytes()], pa.binary()), pa.array([names[which].tobytes()], pa.binary()), pa.array([n[which].tobytes()], pa.binary())], ["route", "h", "of", "nodes", "sizes"])

        for batch in batches:
            for _, texts in _texts(batch):
                for s in shingler.sets(texts):
                    if len(s) and (d := digest_of(s)) not in nodes:
                        nodes[d] = len(sizes)
                        sizes.append(len(s))
                        found_parts.append(signatures(s, percent, common))
                        held += len(found_parts[-1])
                if held > _FLUSH:
                    yield from flush()
                    nodes, sizes, found_parts, held = {}, [], [], 0
        if found_parts:
            yield from flush()

    def meet(batches):
        names: dict[bytes, int] = {}  # linked nodes of all routes so far
        forest = Forest(0)

        def settle(rows: list[dict]) -> None:
            """Chains of one route into the partition's forest."""
            digests = np.frombuffer(b"".join(r["nodes"] for r in rows), "<u8").reshape(-1, 2)
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            digests = digests[order]
            new = np.append(True, (digests[1:] != digests[:-1]).any(axis=1))
            local = np.empty(len(order), np.int64)
            local[order] = np.cumsum(new) - 1
            own = digests[new]
            size = np.zeros(len(own), np.int64)
            size[local] = np.frombuffer(b"".join(r["sizes"] for r in rows), "<u4")
            h = np.frombuffer(b"".join(r["h"] for r in rows), "<u8")
            until = np.cumsum([len(r["nodes"]) // 16 for r in rows])
            of = np.concatenate([local[end - len(r["nodes"]) // 16 : end][np.frombuffer(r["of"], "<u4")] for r, end in zip(rows, until.tolist(), strict=True)])
            order = np.argsort(h)
            h, of = h[order], of[order]
            same = h[1:] == h[:-1]
            more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            h, of = h[more], of[more]
            order = np.lexsort((of, size[of], h))
            h, of = h[order], of[order]
            a, b = of[:-1], of[1:]
            near = (h[1:] == h[:-1]) & (a != b) & (100 * size[a] >= percent * size[b])
            for pair in np.unique(a[near] * len(own) + b[near]).tolist():
                x, y = (names.setdefault(own[i].tobytes(), len(names)) for i in divmod(pair, len(own)))
                forest.up += range(len(forest.up), len(names))
                forest.join(x, y)

        def emit():
            digests = list(names)
            for at in range(0, len(digests), 10_000):
                part = range(at, min(len(digests), at + 10_000))
                yield _pair([digests[x] for x in part], [digests[forest.root(x)] for x in part])
            names.clear()
            forest.up.clear()

        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["route"] != row["route"]:
                    settle(held)
                    held = []
                    if len(names) > CHAINED:
                        yield from emit()
                held.append(row)
        if held:
            settle(held)
        yield from emit()

    packed = documents.select("text").mapInArrow(lean(spread), "route bigint, h binary, of binary, nodes binary, sizes binary")
    # A partition takes several routes in turn and links each of its nodes once, whichever of them it meets others in.
    dealt = packed.repartition(_tasks(documents), "route").sortWithinPartitions("route")
    return dealt.mapInArrow(lean(meet), "a binary, b binary").where("a <> b")


def _linked(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``.

    Shingles that many pairs share are counted by products of 0/1 matrices, all
    others along their postings.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(a) or not len(b):
        return out
    known, of_a = np.unique(np.concatenate(a), return_inverse=True)
    row = np.repeat(np.arange(len(a)), [len(s) for s in a])
    flat, column = np.concatenate(b), np.repeat(np.arange(len(b)), [len(s) for s in b])
    of_b = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    met = known[of_b] == flat
    of_b, column = of_b[met], column[met]
    n_a, n_b = np.bincount(of_a, minlength=len(known)), np.bincount(of_b, minlength=len(known))
    dense = n_a * n_b * 64 > len(a) * len(b)
    width = max(1, BLOCK // max(len(a), len(b)))
    number, total = np.cumsum(dense) - 1, int(dense.sum())
    for at in range(0, total, width):
        x, y = (np.zeros((n, min(width, total - at)), np.float32) for n in out.shape)
        for m, rows, shingle in ((x, row, of_a), (y, column, of_b)):
            own = dense[shingle] & (number[shingle] >= at) & (number[shingle] < at + width)
            m[rows[own], number[shingle[own]] - at] = 1
        out += (x @ y.T).astype(np.int64)
    own = ~dense[of_a] & (n_b[of_a] > 0)
    row, of_a = row[own], of_a[own]
    order = np.argsort(of_b, kind="stable")
    column, first = column[order], np.cumsum(n_b) - n_b
    times = n_b[of_a]
    ends = np.cumsum(times)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        n = times[at:stop]
        place = np.repeat(first[of_a[at:stop]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        low = int(row[at])
        counted = np.bincount((np.repeat(row[at:stop], n) - low) * len(b) + column[place])
        out[low : low + -(-len(counted) // len(b))].reshape(-1)[: len(counted)] += counted
        at = stop
    return out


def voronoi(distance: np.ndarray, radius: float, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of distances to pivots: the cell each belongs to, and all cells that it is copied to (its own among them).

    If x is of cell i and links with y, then d(y, i) <= d(x, i) + r <= d(x, j) + r <= d(y, j) + 2 r for each pivot j.
    """
    least, k = distance.min(axis=1, keepdims=True), distance.shape[1]
    turn = (np.arange(k)[None, :] + pick[:, None]) % k
    return np.where(distance <= least, turn, k).argmin(axis=1), distance <= least + 2 * radius + 1e-9


def pivots_of(n: int) -> int:
    """Pivots of a region of n nodes."""
    return math.ceil(math.sqrt(n) / 2)


def _distance(inter: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1 - inter / (n[:, None] + m[None, :] - inter)


def join_cell(sets: list[np.ndarray], own: np.ndarray, others: np.ndarray, percent: int):
    """(x, all y that link with it) for x of ``own`` and y of ``others`` (numbers of sets), by pivots within the cell.

    The same step in memory that regions take across tasks: pivots of the own
    nodes, cells, windows; where it would not halve the comparisons, they are made.
    """
    radius, size = 1 - percent / 100, np.array([len(s) for s in sets], np.int64)
    take = lambda which: [sets[i] for i in which.tolist()]
    todo = [(own, others)]
    while todo:
        q, t = todo.pop()
        if len(q) > LEAF and len(t) > LEAF:
            pivots = q[:: -(-len(q) // pivots_of(len(q)))]
            apart = [_distance(overlaps(take(rows), take(pivots)), size[rows], size[pivots]) for rows in (q, t)]
            cell, _ = voronoi(apart[0], radius, q)
            _, within = voronoi(apart[1], radius, t)
            parts = [(q[cell == j], t[within[:, j]]) for j in range(len(pivots))]
            if 2 * sum(len(x) * len(y) for x, y in parts) <= len(q) * len(t):
                todo += [(x, y) for x, y in parts if len(x) and len(y)]
                continue
        step = max(1, BLOCK // max(1, len(t)))
        for at in range(0, len(q), step):
            rows = q[at : at + step]
            linked = _linked(overlaps(take(rows), take(t)), size[rows][:, None], size[t][None, :], percent) & (rows[:, None] != t[None, :])
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                yield int(rows[i]), t[linked[i]]


class _Rows:
    """The rows of a group with their sets: one for each node, texts of other rows under a repeated id left out."""

    def __init__(self, table: pa.Table, words: int) -> None:
        shingler, places = Shingler(words), {}
        self.sets, kept, at = [], [], 0
        self.queries = set()
        flags = table.column("own").to_pylist()
        for part, texts in _texts(table.combine_chunks()):
            for node, s in zip(part.column("node").to_pylist(), shingler.sets(texts), strict=True):
                if digest_of(s) == node:
                    if node not in places:
                        places[node] = len(kept)
                        kept.append(at)
                        self.sets.append(s)
                    if flags[at]:
                        self.queries.add(places[node])
                at += 1
        self.table = table.take(pa.array(kept, pa.int64()))
        self.nodes = self.table.column("node").to_pylist()


#: ``shingles``: the node's set, 8 bytes each. Of cells of rare shingles: the shingle, all of the node, and whether it is far from every pivot.
_CELLS = "cell binary, node binary, n bigint, copies bigint, shingles binary, own boolean, a binary, b binary, rare binary, prefix binary, far boolean"
_KINDS = {"cell": pa.binary(), "node": pa.binary(), "n": pa.int64(), "copies": pa.int64(), "shingles": pa.binary(), "own": pa.bool_(), "a": pa.binary(), "b": pa.binary(), "rare": pa.binary(), "prefix": pa.binary(), "far": pa.bool_()}
_MET = "node binary, met bigint, root binary"


def _cell_rows(length: int, **columns) -> pa.RecordBatch:
    return pa.record_batch({c: columns[c].cast(kind) if c in columns else pa.nulls(length, kind) for c, kind in _KINDS.items()})


def _written(size: np.ndarray):
    """Stretches of rows whose sizes are WRITTEN_SHINGLES in all, about."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WRITTEN_SHINGLES, "right")))
        yield slice(at, stop)
        at = stop


def _compare(words: int, percent: int, every: bool, levels):
    """A part of a region against its pivots: a row for each node and cell it goes to, and the links with pivots."""
    radius = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = _Rows(table.sort_by([("node", "ascending"), ("own", "ascending")]), words)
        flags = {node for node, own in zip(table.column("node").to_pylist(), table.column("own").to_pylist(), strict=True) if not own}
        size = np.array([len(s) for s in rows.sets], np.int64)
        pivots = np.array([i for i, node in enumerate(rows.nodes) if node in flags], np.int64)
        mine = np.array(sorted(rows.queries), np.int64)
        region = table.column("region")[0].as_py()
        names = [rows.nodes[i] for i in pivots.tolist()]
        cells = pa.array([hashlib.md5(region + name).digest() for name in names], pa.binary())
        by_rare = table.column("rare")[0].as_py()
        about = rows.table.select(["node", "n", "copies"]).combine_chunks()
        del table, rows.table  # no text is needed any more

        def taken(which: np.ndarray) -> dict:
            some = about.take(pa.array(which, pa.int64()))
            return {**{c: some.column(c).combine_chunks() for c in some.column_names}, "shingles": pa.array([rows.sets[i].astype("<u8").tobytes() for i in which.tolist()], pa.binary())}

        step = max(1, BLOCK // max(1, len(pivots)))
        for at in range(0, len(mine), step):
            these = mine[at : at + step]
            inter = overlaps([rows.sets[i] for i in these], [rows.sets[i] for i in pivots])
            d = _distance(inter, size[these], size[pivots])
            pick = np.array([int.from_bytes(rows.nodes[i][:6], "little") for i in these], np.int64)
            home, within = voronoi(d, radius, pick)
            tied = d <= radius + 1e-12
            if not every:  # a node that links with a pivot meets all that do so there
                within &= ~tied
                within[np.arange(len(these)), home] = True
            if by_rare:
                least = d.min(axis=1)
                far = least >= 1 - 2 * radius - 2e-9
                within &= ~far[:, None]
                met = np.flatnonzero(least >= 1 - 3 * radius - 1e-8)
                firsts = [rarest(rows.sets[i], levels.value, percent) for i in these[met].tolist()]
                # A shingle of one document alone is shared with nobody.
                shared = [p[levels.value[_counter(p)] > 0] for p in firsts]
                x = np.repeat(met, [len(p) for p in shared])
                of = np.repeat(np.arange(len(met)), [len(p) for p in shared])
                keys = np.concatenate([np.zeros(0, np.uint64), *shared]).astype("<u8")
                for part in _written(size[these[x]]):
                    rare = [k.tobytes() for k in keys[part]]
                    prefix = pa.array([firsts[i].astype("<u8").tobytes() for i in of[part].tolist()], pa.binary())
                    names_ = pa.array([hashlib.md5(region + b"rare" + k).digest() for k in rare], pa.binary())
                    yield _cell_rows(len(rare), cell=names_, **taken(these[x[part]]), own=pa.array(np.ones(len(rare), bool)), rare=pa.array(rare, pa.binary()), prefix=prefix, far=pa.array(far[x[part]]))
            x, j = np.nonzero(within)
            for part in _written(size[these[x]]):
                yield _cell_rows(part.stop - part.start, cell=cells.take(pa.array(j[part])), **taken(these[x[part]]), own=pa.array(home[x[part]] == j[part]))
            if not every:
                x, j = np.nonzero(_linked(inter, size[these][:, None], size[pivots][None, :], percent) & (these[:, None] != pivots[None, :]))
                yield _cell_rows(len(x), a=pa.array([rows.nodes[i] for i in these[x].tolist()], pa.binary()), b=pa.array([names[i] for i in j.tolist()], pa.binary()))
        if len(mine) > CELL_NODES:
            release()

    return run


def _join_cell(percent: int):
    """A task of a cell: for each own node the copies of the nodes that it links with, and the least node its links connect it with here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        nodes = table.column("node").to_pylist()
        sets, prefix = ([np.frombuffer(s or b"", "<u8") for s in table.column(c).to_pylist()] for c in ("shingles", "prefix"))
        copies, own, there, far = (np.array(table.column(c).to_pylist()) for c in ("copies", "own", "there", "far"))
        rare = table.column("rare")[0].as_py()
        met, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for x, ys in join_cell(sets, np.flatnonzero(own), np.flatnonzero(there), percent):
            if rare is not None:  # of all cells that the two meet in, the one of the least shingle has the link
                least = np.frombuffer(rare, "<u8")[0]
                ys = np.array([y for y in ys.tolist() if (far[x] or far[y]) and np.intersect1d(prefix[x], prefix[y], True)[0] == least], np.int64)
                if not len(ys):
                    continue
            met[x] = copies[ys].sum()
            known = np.append(label[ys], label[x])
            if (known != known[0]).any():
                label[np.isin(label, known)] = known.min()
        linked = np.flatnonzero((met > 0) | (label != np.arange(len(label))))
        return pa.table({"node": pa.array([nodes[i] for i in linked], pa.binary()), "met": pa.array(met[linked]), "root": pa.array([nodes[label[i]] for i in linked], pa.binary())})

    return run


def _members(documents: DataFrame, nodes: DataFrame, marks: np.ndarray, words: int, percent: int) -> DataFrame:
    """region, node, n (shingles), copies and text: the nodes that candidates chain together; all links lie within regions."""
    with small_batches(documents.sparkSession, ROUTE_ROWS):
        roots = components(candidates(documents, marks, words, percent))
    regions = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    first = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    members = first.join(regions.withColumnRenamed("root", "region"), "node")
    # One text for each node of a region; the digest tells it from others with the same id.
    named = members.where("doc_id IS NOT NULL").join(documents.select("doc_id", "text"), "doc_id")

    def digests(batches):
        shingler = Shingler(words)
        for batch in batches:
            for part, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) if len(s) else None for s in shingler.sets(texts)], pa.binary()), part.column("text")], ["node", "text"])

    # Nodes of rows without ids are found by their digests.
    nameless = documents.where("doc_id IS NULL AND text IS NOT NULL").select("text").mapInArrow(lean(digests), "node binary, text string")
    nameless = members.where("doc_id IS NULL").join(nameless.dropDuplicates(["node"]), "node")
    columns = ["region", "node", "n", "copies", "text"]
    return cut(named.select(columns).unionByName(nameless.select(columns)))


def dealt_cells(cells: DataFrame) -> DataFrame:
    """Rows of cells by task: a task has a part of the cell's own nodes (``own``) and a part of all its nodes (``there``).

    Both parts are bounded, in nodes and in shingles, however many the cell has;
    each own node meets each other node in one task.
    """
    mine = F.col("own").cast("long")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"), F.sum(mine).alias("own_nodes"), F.sum(mine * F.col("n")).alias("own_shingles"))
    chunks, owns = (F.greatest(F.lit(1), F.ceil(F.greatest(F.col(n) / most, F.col(m) / TASK_SHINGLES))).cast("int") for n, m, most in (("nodes", "shingles", CELL_NODES), ("own_nodes", "own_shingles", OWN_NODES)))
    wide = counts.select("cell", chunks.alias("chunks"), owns.alias("owns")).where("chunks > 1 OR owns > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = cells.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")).join(wide, ["cell", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("chunks", "owns")})
    spread = spread.withColumns({"home": F.pmod(F.xxhash64("node", F.lit(9)), F.col("chunks")).cast("int"), "own_home": F.pmod(F.xxhash64("node", F.lit(11)), F.col("owns")).cast("int")})
    there = F.transform(F.sequence(F.lit(0), F.col("owns") - 1), lambda a: a * F.col("chunks") + F.col("home"))
    here = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda t: F.col("own_home") * F.col("chunks") + t)
    spread = spread.withColumn("task", F.explode(F.when(F.col("own"), F.array_union(here, there)).otherwise(there)))
    own = F.col("own") & (F.floor(F.col("task") / F.col("chunks")) == F.col("own_home"))
    return spread.select("cell", "task", "node", "copies", "shingles", own.alias("own"), "rare", "prefix", "far", (F.col("task") % F.col("chunks") == F.col("home")).alias("there"))


def met_links(documents: DataFrame, nodes: DataFrame, marks: np.ndarray, words: int, percent: int, every: bool = True) -> DataFrame:
    """node, met, root: for nodes with links, how many rows link with them, and nodes that they are connected with.

    ``every``: all links are counted. Otherwise nodes that link with the same
    pivot are not compared further: what is connected stays connected, but the
    numbers are too low.
    """
    members, tasks = _members(documents, nodes, marks, words, percent), _tasks(documents)
    levels = documents.sparkSession.sparkContext.broadcast(marks & np.uint8(127))  # a byte for each counter
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    wanted = F.ceil(F.sqrt("nodes") / 2).cast("int").alias("pivots")
    each = F.col("shingles") * (100 - percent) / 100 / F.col("nodes") + 1
    size = size.select("region", "nodes", "shingles", wanted, each.alias("each")).withColumn("rare", F.col("pivots") * RARE > F.col("each"))
    # What a task of comparisons reads and what it writes are bounded: shingles of a part, and of all their copies, which it writes a few at a time.
    copied = F.col("shingles") * F.when(F.col("rare"), F.least("each", "pivots")).otherwise(F.col("pivots"))
    size = size.select("region", "pivots", "rare", F.greatest(F.lit(1), F.ceil(F.greatest(F.col("nodes") / (16 * F.col("pivots")), copied / COPIED_SHINGLES, F.col("shingles") / TASK_SHINGLES))).cast("int").alias("parts"))
    # Most regions have one pivot and one part, which need no row to say so; a large one is met in salted parts.
    salted = size.where("pivots > 1 OR parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")).join(salted, ["region", "salt"], "left")
    sized = sized.select("region", "node", "n", "copies", "text", F.coalesce("pivots", F.lit(1)).alias("pivots"), F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("rare", F.lit(False)).alias("rare"))
    # Pivots: in each of so many slots the member with the smallest hash, combined before the shuffle.
    key = F.struct(F.xxhash64("node").alias("k"), F.col("node").alias("node"))
    chosen = sized.select("region", "node", F.pmod(F.xxhash64("node", F.lit(3)), F.col("pivots")).alias("slot")).groupBy("region", "slot").agg(F.min(key).alias("p")).select("region", F.col("p.node").alias("node"))
    columns = ["region", "part", "node", "n", "copies", "text", "own", "rare"]
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).withColumn("own", F.lit(True))
    pivots = sized.join(chosen, ["region", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.lit(False))
    met = dealt.select(columns).unionByName(pivots.select(columns)).repartition(tasks, "region", "part")
    compared = cut(met.groupBy("region", "part").applyInArrow(_compare(words, percent, every, levels), _CELLS))
    cells = compared.where("cell IS NOT NULL")
    found = dealt_cells(cells).repartition(tasks, "cell", "task").groupBy("cell", "task").applyInArrow(_join_cell(percent), _MET)
    ties = compared.where("cell IS NULL").select(F.col("a").alias("node"), F.lit(0).cast("long").alias("met"), F.col("b").alias("root"))
    out = cut(found.unionByName(ties))
    drop_cut(members)
    drop_cut(compared)
    return out


def _classes(documents: DataFrame, words: int, percent: int, every: bool) -> DataFrame:
    """doc_id, key, n_shingles, component_id, n_links, first (the row's id and text are the component's first): one row per document."""
    with small_batches(documents.sparkSession, BATCH_ROWS):
        nodes, marks = node_table(documents, words)
        met = met_links(documents, nodes, marks, words, percent, every)
        roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("node").agg(F.sum("met").alias("met"))
    # Rows without an id come last; of rows with one id, the text with the least key is first.
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    least = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("low"), F.count(F.lit(1)).alias("copies"))
    rooted = least.join(roots, "node", "left").join(counts, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    final = rooted.groupBy("root").agg(F.min("low").alias("low"))
    of_node = rooted.drop("low").join(final, "root").select("node", "low", "n_links")
    first = F.col("low").isNull() | (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("key") == F.col("low.key")))
    return nodes.join(of_node, "node", "left").select("doc_id", "key", "n_shingles", F.coalesce("low.doc_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), first.alias("first"))


def component_table(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows that link with it, equal sets among them): one row per document."""
    return _classes(documents, words, percent, every=True).drop("key", "first")


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that with the smallest id, or the smallest text hash where ids are equal or missing.

    Rows are told apart by id and text; of rows that agree in both and have shingles one stays.
    """
    classes = _classes(documents, words, percent, every=False)
    pair = [F.col("doc_id").alias(KEY + "_id"), F.col("key").alias(KEY + "_of")]
    same = F.col("doc_id").eqNullSafe(F.col(KEY + "_id")) & (F.col(KEY) == F.col(KEY + "_of"))
    kept = documents.withColumn(KEY, F.xxhash64("text")).join(classes.where("NOT first").select(pair).distinct(), same, "left_anti")
    twice = cut(classes.where("first AND n_links > 0").groupBy("doc_id", "key").count().where("count > 1").select(pair))
    if not twice.isEmpty():
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", KEY]))
    return kept.select(documents.columns)
