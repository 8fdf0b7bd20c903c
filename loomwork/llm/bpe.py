"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Each chunk of documents splits its texts into pre-tokens. Its distinct words go,
   by hash, into buckets; where each word stands is kept as a packed stream of
   word numbers per chunk, rather than a row per pre-token, so that positions
   cost about 1.5 bytes each.
2. The bucket shuffle brings equal words of all chunks together. Each distinct
   word is encoded once, and its ids go back to the chunks that hold it.
3. The chunk shuffle joins ids and positions; documents are reassembled in order,
   and decoded by looking each id up in the table of token bytes.

A frequent word is one entry of each chunk, so no word makes a hot task. The
vocabulary (about 50,000 entries) is the only thing sent to every executor.

Defined cases: null and empty texts have no ids; a very long text is a chunk of its
own; null ids and repeated rows are carried through; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, lean

#: Bytes of text and rows in a chunk, and bytes of input for each bucket of words.
CHUNK_BYTES, CHUNK_ROWS, BUCKET_BYTES, BUCKETS = 16 << 20, 1 << 18, 8 << 20, (32, 1 << 14)


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _pack(array: np.ndarray) -> bytes:
    """Integers as zstd over byte planes, the low bytes first."""
    import zstandard

    array = array.astype("<u4")
    planes = [((array >> (8 * i)) & 255).astype(np.uint8).tobytes() for i in range(4)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(data: bytes, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, n).astype(np.uint32)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for each i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def buckets_for(documents: DataFrame) -> int:
    """Buckets in proportion to the input that the optimizer sees; by partitions where it can't tell, as for local rows."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = BUCKET_BYTES * documents.rdd.getNumPartitions()
    return min(BUCKETS[1], max(BUCKETS[0], size // BUCKET_BYTES + 1))


def _split(pattern: str, buckets: int):
    """Step 1 over a partition: rows of words by bucket, and a row of positions for each chunk."""

    def chunk_rows(no: int, ids: pa.Array, texts: list[str], find):
        import zstandard

        number: dict[str, int] = {}
        streams = [[number.setdefault(w, len(number)) for w in find(t)] if t else [] for t in texts]
        counts = [len(s) for s in streams]
        codes = np.fromiter((c for s in streams for c in s), np.int64, sum(counts))
        del streams
        words = [w.encode() for w in number]
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        words = [words[i] for i in order]
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        compress = zstandard.ZstdCompressor(level=3).compress
        yield {"chunk": no, "bucket": -1, "route": zlib.crc32(b"%d" % no) % buckets, "n": len(codes), "data": _pack(rank[codes] if len(codes) else codes), "more": _pack(of), "counts": counts, "doc_ids": ids}
        by = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(buckets + 1))
        for b in np.unique(of):
            own = [words[i] for i in by[cuts[b] : cuts[b + 1]]]
            yield {"chunk": no, "bucket": int(b), "route": int(b), "n": len(own), "data": compress(b"".join(own)), "more": _pack(np.fromiter(map(len, own), np.int64, len(own))), "counts": None, "doc_ids": None}

    def run(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        no, ids, texts, size = (TaskContext.get().partitionId() << 24), [], [], 0
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            column = batch.column("text")
            for i in range(batch.num_rows):
                text = column[i].as_py()
                ids.append(batch.column("doc_id")[i].as_py())
                texts.append(text)
                size += len(text or "")
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield _as_batch(chunk_rows(no, ids, texts, find), kind)
                    no, ids, texts, size = no + 1, [], [], 0
        if texts:
            yield _as_batch(chunk_rows(no, ids, texts, find), kind)

    return run


def _as_batch(rows, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("route", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("more", pa.binary()), ("counts", pa.list_(pa.int64())), ("doc_ids", pa.list_(kind))]))


def _encode(ranks, pattern: str):
    """Step 2 over a partition of buckets: each distinct word is encoded once; positions pass through."""

    def run(batches):
        import tiktoken
        import zstandard

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                r = {k: row.column(k)[0] for k in ("bucket", "n", "data", "more")}
                if r["bucket"].as_py() < 0:
                    yield row
                    continue
                text, lengths = decompress(r["data"].as_py()), _unpack(r["more"].as_py(), r["n"].as_py())
                found, at = [], 0
                for length in lengths.tolist():
                    word = text[at : at + length]
                    at += length
                    ids = known.get(word)
                    if ids is None:
                        known[word] = ids = np.array(encode(word), "<u4").tobytes()
                    found.append(ids)
                flat = np.frombuffer(b"".join(found), "<u4")
                columns = dict(zip(row.schema.names, row.columns, strict=True))
                columns["data"] = pa.array([_pack(flat)], pa.binary())
                columns["more"] = pa.array([_pack(np.fromiter((len(x) // 4 for x in found), np.int64, len(found)))], pa.binary())
                columns["route"] = pa.array([len(flat)], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), row.schema.names)

    return run


def _assemble(ranks, names: list[str], keep_ids: bool):
    """Step 3 for a chunk: ids by position, then bytes by id."""

    def run(table: pa.Table) -> pa.Table:
        token_bytes = [b""] * (max(ranks.value.values()) + 1)
        for token, rank in ranks.value.items():
            token_bytes[rank] = token
        sizes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        every, where = np.frombuffer(b"".join(token_bytes), np.uint8), np.cumsum(sizes) - sizes
        rows = sorted(range(table.num_rows), key=lambda i: table.column("bucket")[i].as_py())
        at = lambda name, i: table.column(name)[i].as_py()
        head, parts = rows[0], rows[1:]
        counts, doc_ids = np.array(at("counts", head), np.int64), table.column("doc_ids")[head].values
        codes = _unpack(at("data", head), at("n", head)).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *[_unpack(at("data", i), at("route", i)) for i in parts]])
        lengths = np.concatenate([np.zeros(0, np.int64), *[_unpack(at("more", i), at("n", i)).astype(np.int64) for i in parts]])
        starts = np.cumsum(lengths) - lengths
        # Words stand by bucket here and by rank in the positions: a stable sort of the buckets leads from one to the other.
        bucket_of = _unpack(at("more", head), len(lengths))
        place = np.empty(len(lengths), np.int64)
        place[np.argsort(bucket_of, kind="stable")] = np.arange(len(lengths))
        ends = np.cumsum(counts)
        out: dict[str, list] = {n: [] for n in names}
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            words = place[codes[end - count : end]]
            ids = _spread(flat, starts[words], lengths[words]).astype("<u4")
            text = _spread(every, where[ids], sizes[ids]).tobytes()
            data = ids.tobytes()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(data).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            if keep_ids:
                out["ids"].append(ids.astype(np.int32))
                out["decoded"].append(text.decode("utf-8", "replace"))
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
        return pa.Table.from_arrays([doc_ids, *[pa.array(out[n], kinds[n]) for n in names]], ["doc_id", *names])

    return run


def encode(documents: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, where asked for, ids and the decoded text."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    kind = dict(documents.dtypes)["doc_id"]
    buckets = buckets_for(documents.select("doc_id", "text"))
    packed = f"chunk bigint, bucket int, route bigint, n bigint, data binary, more binary, counts array<bigint>, doc_ids array<{kind}>"
    words = documents.select("doc_id", "text").mapInArrow(lean(_split(pattern, buckets)), packed)
    encoded = words.repartition(buckets, "route").mapInArrow(lean(_encode(ranks, pattern)), packed)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return encoded.groupBy("chunk").applyInArrow(_assemble(ranks, names, keep_ids), schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text from doc_id and ids, each id looked up in the table of token bytes (null ids: null text)."""
    ranks = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(vocabulary).items()})
    kind = dict(encoded.dtypes)["doc_id"]

    def each(batch: pa.RecordBatch):
        texts = [None if ids is None else b"".join(map(ranks.value.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), each, f"doc_id {kind}, text string")
