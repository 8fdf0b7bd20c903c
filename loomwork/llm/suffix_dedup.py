"""Removal of byte strings that occur earlier in the corpus, by sorting suffixes of shards.

Every string of LENGTH bytes has a minimizer: the least hash among its strings of
K bytes, the first of equals. Stretches of positions with one minimizer are
segments, routed by the minimizer's hash, so equal strings meet in one shard. Per
shard the suffixes of all segments are ordered by induced sorting over disk-backed
queues (``induced_sort``); neighbours whose LENGTH bytes are the same, byte by byte,
form a group, and all but its first position are repeats. Their runs return to the documents.

Only what can repeat is sorted: hashes of minimizers and digests of documents
meet first (a few bytes for each segment). A document equal to an earlier one is
removed whole, and segments whose minimizer occurs once stay where they are.
Equal segments of one chunk travel once. Both keep a hot passage from filling a
shard: at most one copy for each chunk arrives. Different segments of one
minimizer are not split: a shard must fit the memory of its task.

Order is by document id, then by place in the written chunks for repeated ids
(null ids first), then by offset. Digests of 128 bits tell equal documents; nothing
else rests on hashes. Defined cases: a text of any length is one document of one
chunk, so the longest text must fit a task; equal rows are copies of the first; null and empty texts have no
bytes; texts under LENGTH bytes lose nothing; an empty table gives an empty table;
other columns are ignored; ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .induced_sort import equal_stretches, suffix_order

LENGTH, K = 100, 32
CHUNK_BYTES, CHUNK_ROWS, INPUT_PER_ROUTE, ROUTES, PARTITIONS = 4 << 20, 1 << 16, 1 << 20, (16, 1 << 22), 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_NONE = np.iinfo(np.int64).min


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _open(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_ODD, _INVERSE):
        steps = np.full(n, b, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def rolling(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` symbols."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[width:] - total[:-width]) * down[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, windows and minimizer hash of each segment of documents laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    h = rolling(data, K)
    wide = LENGTH - K + 1
    # Hash above, place below: the least is the first of the least hashes. A chunk has under 2**24 bytes unless one text has more.
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    whole = np.arange(len(at)) + LENGTH <= ends[doc]  # windows within a document
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]]) & whole
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]])
    count = np.add.reduceat(whole.astype(np.int64), first) if len(first) else none
    del last
    return doc[first], first, count, h[at[first]]


def _routes(documents: DataFrame) -> int:
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = INPUT_PER_ROUTE * documents.rdd.getNumPartitions() if size >= 1 << 50 else size
    return min(ROUTES[1], max(ROUTES[0], size // INPUT_PER_ROUTE + 1))


def pack(documents: DataFrame) -> DataFrame:
    """Chunks of documents, written once so that numbers given to chunks and documents hold: chunk, ids, lengths, data."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        no, ids, texts, size, id_type = TaskContext.get().partitionId() << 24, [], [], 0, pa.int64()

        def row():
            lengths = np.array([len(t) for t in texts], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([lengths.tobytes()], pa.binary()), pa.array([_press(b"".join(texts))], pa.binary())], ["chunk", "ids", "lengths", "data"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (t or "").encode()
                ids.append(i)
                texts.append(data)
                size += len(data)
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield row()
                    no, ids, texts, size = no + 1, [], [], 0
        if ids:
            yield row()

    return cut(documents.select("doc_id", "text").mapInArrow(lean(run), f"chunk bigint, ids array<{kind}>, lengths binary, data binary"))


class Chunk:
    """An opened chunk: documents end to end, their segments, digests and order."""

    def __init__(self, row: dict) -> None:
        import xxhash

        self.no, self.ids = row["chunk"], row["ids"]
        self.lengths, self.data = np.frombuffer(row["lengths"], "<i8"), _open(row["data"], np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.order = np.array([_NONE if i is None else i for i in self.ids], np.int64)
        self.long = np.flatnonzero(self.lengths >= LENGTH)
        view = self.data.tobytes()
        self.digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[s : s + n]) for s, n in zip(self.starts[self.long].tolist(), self.lengths[self.long].tolist(), strict=True)), "<u8").reshape(-1, 2)

    def cut(self) -> None:
        self.doc, self.first, self.count, self.hash = segments(self.data, self.lengths)


def _announce(routes: int):
    """For each chunk and route: the distinct minimizers, and the digests of documents with their order."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                c.cut()
                distinct, times = np.unique(c.hash, return_counts=True)
                route, to = (distinct % np.uint64(routes)).astype(np.int64), (c.digest[:, 0] % np.uint64(routes)).astype(np.int64)
                by, doc_by = np.argsort(route, kind="stable"), np.argsort(to, kind="stable")
                present = np.union1d(route, to)
                edges = [np.searchsorted(x, present, side) for x in (route[by], to[doc_by]) for side in ("left", "right")]
                for r, low, high, doc_low, doc_high in zip(present.tolist(), *(e.tolist() for e in edges), strict=True):
                    own, docs = by[low:high], doc_by[doc_low:doc_high]
                    arrays = [distinct[own].tobytes(), (times[own] > 1).tobytes(), c.digest[docs].tobytes(), c.order[c.long[docs]].tobytes(), c.long[docs].astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c.no], pa.int64()), pa.array([r], pa.int32()), *[pa.array([a], pa.binary()) for a in arrays]], ["chunk", "route", "hashes", "twice", "digests", "orders", "docs"])

    return run


def _answer(batches):
    """For each chunk: which minimizers occur elsewhere too, and which documents equal an earlier one."""
    rows = []
    for batch in batches:
        rows += batch.to_pylist()
    if not rows:
        return
    h = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    distinct, inverse, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    more = np.split(times[inverse] > 1, np.cumsum([len(x) for x in h])[:-1])
    digest = np.concatenate([np.frombuffer(r["digests"], "<u8").reshape(-1, 2) for r in rows])
    order, doc = (np.concatenate([np.frombuffer(r[k], "<i8") for r in rows]) for k in ("orders", "docs"))
    sizes = [len(r["orders"]) // 8 for r in rows]
    chunk = np.repeat([r["chunk"] for r in rows], sizes)
    by = np.lexsort((doc, chunk, order, digest[:, 1], digest[:, 0]))
    copy = np.zeros(len(by), bool)
    if len(by):
        copy[by[1:]] = (digest[by[1:]] == digest[by[:-1]]).all(axis=1)
    copies = np.split(copy, np.cumsum(sizes)[:-1])
    docs = np.split(doc, np.cumsum(sizes)[:-1])
    for r, bits, hashes, c, d in zip(rows, more, h, copies, docs, strict=True):
        twice = np.frombuffer(r["twice"], bool)
        yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([_press(hashes[bits | twice].tobytes())], pa.binary()), pa.array([d[c].astype("<i8").tobytes()], pa.binary())], ["chunk", "hashes", "copies"])


def _ship(routes: int):
    """Segments that can repeat, one row for each chunk and shard; repeats within the chunk are told at once (route -1)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                copies = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<i8") for x in row["copies"] or ()]])
                wanted = np.concatenate([np.zeros(0, np.uint64), *[_open(x, np.uint64) for x in row["hashes"] or ()]])
                if not len(wanted):
                    runs = _runs(copies, np.zeros(len(copies), np.int64), c.lengths[copies])
                    yield _segment_row(c.no, -1, runs, b"", b"")
                    continue
                c.cut()
                is_copy = np.zeros(len(c.lengths), bool)
                is_copy[copies] = True
                pick = np.flatnonzero(np.isin(c.hash, wanted) & ~is_copy[c.doc])
                # Segments by the order of their documents: of equal ones the first travels.
                pick = pick[np.lexsort((c.first[pick], c.doc[pick], c.order[c.doc[pick]]))]
                view, seen, keep, again = c.data.tobytes(), set(), [], []
                for i, s, n in zip(pick.tolist(), c.first[pick].tolist(), (c.count[pick] + LENGTH - 1).tolist(), strict=True):
                    piece = view[s : s + n]
                    if piece in seen:
                        again.append(i)
                    else:
                        seen.add(piece)
                        keep.append(i)
                keep, again = np.array(keep, np.int64), np.array(again, np.int64)
                begin = c.first - c.starts[c.doc]
                runs = _runs(np.concatenate([copies, c.doc[again]]), np.concatenate([np.zeros(len(copies), np.int64), begin[again]]), np.concatenate([c.lengths[copies], begin[again] + c.count[again] + LENGTH - 1]))
                yield _segment_row(c.no, -1, runs, b"", b"")
                shard = (c.hash[keep] % np.uint64(routes)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                begins = np.flatnonzero(np.append(True, np.diff(shard[by]) != 0)) if len(by) else by
                for own in np.split(keep[by], begins[1:]) if len(by) else ():
                    r = c.hash[own[0]] % np.uint64(routes)
                    text = b"".join(view[s : s + n] for s, n in zip(c.first[own].tolist(), (c.count[own] + LENGTH - 1).tolist(), strict=True))
                    meta = np.stack([c.doc[own], begin[own], c.count[own], c.order[c.doc[own]]]).astype("<i8")
                    yield _segment_row(c.no, int(r), b"", _press(meta.tobytes()), _press(text))

    return run


def _segment_row(chunk: int, route: int, runs: bytes, meta: bytes, text: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([route], pa.int32()), pa.array([runs], pa.binary()), pa.array([meta], pa.binary()), pa.array([text], pa.binary())], ["chunk", "route", "runs", "meta", "text"])


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([doc, start, end]).astype("<i8").tobytes()


def _sort_shard(rows: list[dict], budget: int):
    """Repeats among the segments of a shard, as a row of runs for each chunk."""
    meta = [_open(r["meta"], "<i8").reshape(4, -1) for r in rows]
    doc, begin, count, order = np.concatenate(meta, axis=1)
    chunk = np.repeat([r["chunk"] for r in rows], [m.shape[1] for m in meta])
    text = np.concatenate([_open(r["text"], np.uint8) for r in rows])
    size = count + LENGTH - 1
    at = np.cumsum(size) - size
    by = np.lexsort((begin, doc, chunk, order))  # place in the shard is now the order of the corpus
    doc, begin, count, chunk, size, at = doc[by], begin[by], count[by], chunk[by], size[by], at[by]
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    t = np.zeros(int(ends[-1]), np.uint16)
    to = np.arange(len(t) - len(size)) + np.repeat(np.arange(len(size)), size)
    t[to] = text[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype(np.uint16) + 1
    del text, to
    is_window = np.zeros(len(t) + 1, np.int8)
    is_window[starts] = 1
    is_window[starts + count] = -1
    is_window = np.cumsum(is_window[:-1], dtype=np.int8) > 0
    suffixes = suffix_order(t, LENGTH, budget)
    suffixes = suffixes[is_window[suffixes]].astype(np.int64)
    letters = (t - np.uint16(1)).astype(np.uint8)  # windows hold no ends of segments
    same = equal_stretches(letters, suffixes[:-1], suffixes[1:], np.full(len(suffixes) - 1, LENGTH))
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    first = np.minimum.reduceat(suffixes, new)
    repeat = np.zeros(len(t) + 1, bool)
    repeat[suffixes[suffixes != np.repeat(first, np.diff(np.append(new, len(suffixes))))]] = True
    edge = np.diff(repeat.astype(np.int8), prepend=0)
    low, high = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    seg = np.searchsorted(starts, low, "right") - 1
    start = begin[seg] + low - starts[seg]
    end = start + (high - low) + LENGTH - 1
    for c in np.unique(chunk[seg]):
        own = chunk[seg] == c
        yield _segment_row(int(c), -1, _runs(doc[seg][own], start[own], end[own]), b"", b"")


def _sort(budget: int):
    """Shards of a partition in turn; what is known already passes through."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for i, route in enumerate(batch.column("route").to_pylist()):
                if route < 0:
                    yield batch.slice(i, 1)
                    continue
                if held and held[0]["route"] != route:
                    yield from _sort_shard(held, budget)
                    held = []
                held += batch.slice(i, 1).to_pylist()
        if held:
            yield from _sort_shard(held, budget)

    return run


def _finish(keep_text: bool):
    """Documents of a chunk without the runs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                found = [np.frombuffer(x, "<i8").reshape(3, -1) for x in row["runs"] or ()]
                doc, start, end = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
                covered = np.zeros(len(c.data) + 1, np.int64)
                np.add.at(covered, c.starts[doc] + start, 1)
                np.add.at(covered, c.starts[doc] + end, -1)
                gone = np.cumsum(covered[:-1]) > 0
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for s, n in zip(c.starts.tolist(), c.lengths.tolist(), strict=True):
                    own = gone[s : s + n]
                    kept = c.data[s : s + n][~own].tobytes()
                    out["n_bytes"].append(n)
                    out["n_removed"].append(int(own.sum()))
                    out["n_spans"].append(int(np.count_nonzero(own[1:] & ~own[:-1]) + bool(n and own[0])))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept)
                kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
                names = [k for k in kinds if keep_text or k != "kept"]
                ids = batch.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(c.ids, ids), *[pa.array(out[k], kinds[k]) for k in names]], ["doc_id", *names])

    return run


def dedup(documents: DataFrame, keep_text: bool = True, budget: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, the kept bytes."""
    kind = dict(documents.dtypes)["doc_id"]
    routes = _routes(documents.select("doc_id", "text"))
    partitions = min(PARTITIONS, max(16, routes // 4))
    chunks = pack(documents)
    told = chunks.mapInArrow(lean(_announce(routes)), "chunk bigint, route int, hashes binary, twice binary, digests binary, orders binary, docs binary")
    answers = told.repartition(partitions, "route").mapInArrow(lean(_answer), "chunk bigint, hashes binary, copies binary")
    answers = answers.groupBy("chunk").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("copies").alias("copies"))
    shipped = chunks.join(answers, "chunk", "left").mapInArrow(lean(_ship(routes)), "chunk bigint, route int, runs binary, meta binary, text binary")
    dealt = shipped.withColumn("to", F.when(F.col("route") < 0, F.pmod(F.col("chunk"), F.lit(routes))).otherwise(F.col("route"))).repartition(partitions, "to").drop("to").sortWithinPartitions("route")
    runs = dealt.mapInArrow(lean(_sort(budget)), "chunk bigint, route int, runs binary, meta binary, text binary").groupBy("chunk").agg(F.collect_list("runs").alias("runs"))
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return chunks.join(runs, "chunk", "left").mapInArrow(lean(_finish(keep_text)), schema)
