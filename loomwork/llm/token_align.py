"""Alignment of two tokenizers by a sweep over token ends.

1. Each text is encoded by both. Its tokens become events: for each side blocks of token
   ids with the byte offset where the block begins, so the ends are the running sums of
   the tokens' lengths.
2. The events of both sides are dealt by document, sorted by offset within partitions and
   swept once. An end that both sides share closes a group. Every distinct end closes one
   overlap of a token of A with one of B, so links are counted without comparing pairs.
   The state is what stands after the last shared end: an open group.
3. A chunk of swept documents keeps its links as numbers of its distinct id pairs. The
   pairs alone are summed over the corpus, and their counts return to the chunks.

What crosses a shuffle is two bytes a token, and a row for each distinct pair of a chunk.
A frequent pair is a row of each chunk, no hot task; a long text is a stream of blocks.

Defined cases: a null or empty text, and one whose tokens of either side do not spell a
space and the text (as one with U+2581), has no tokens and no group; very long texts are
swept block by block; repeated rows each count and each return, as do null ids; an empty
table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pack, _unpack
from .common import cut, lean
from .textvec import slices

#: Bytes of text encoded together, tokens in a block of events, and tokens swept together.
TEXT_BYTES, BLOCK, GROUP_TOKENS = 1 << 20, 1 << 14, 1 << 19
#: Words kept encoded in a worker, and the length of those worth keeping.
KEPT_WORDS, KEPT_LENGTH = 1 << 19, 64
#: A space that follows anything but white space: no token of either side crosses it.
WORD_CUT = r"(?<=[^\s\u180e])(?= )"
#: Characters outside old blocks, of which versions of Unicode may know different classes.
UNSETTLED = "[^\\x00-\u052f\u2000-\u206f\u20a0-\u20ba\u3000-\u30ff\u4e00-\u9fcc\uac00-\ud7a3]"
#: Fixed value: how a byte-level tokenizer of this kind cuts a text before it merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EVENTS = "key bigint, side int, start bigint, final boolean, ids binary, doc_id {kind}"
_SWEPT = "chunk bigint, doc_ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, a array<int>, b array<int>, n array<bigint>, sizes array<bigint>, links binary, times binary"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """One tokenizer: ids of words and the bytes of ids."""

    def __init__(self, words, tokens: list[bytes]):
        self.words, self.tokens = words, tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))


def _byte_level(data: bytes) -> _Side:
    """A byte-level vocabulary. Where its merges are its tokens in order, ranks say as much, and words of settled characters go by ranks."""
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    said = json.loads(data)
    model, byte = said["model"], _byte_alphabet()
    every = {**model["vocab"], **{t["content"]: t["id"] for t in said.get("added_tokens", ())}}
    tokens = [b""] * (max(every.values()) + 1)
    for token, i in every.items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    ready: list[Tokenizer] = []  # built when a word needs it

    def slow(words: list[str]) -> list[list[int]]:
        if not ready:
            ready.append(Tokenizer.from_str(data.decode()))
            ready[0].encode_special_tokens = True  # their strings in a text are plain text
        return [e.ids for e in ready[0].encode_batch_fast(words, add_special_tokens=False)]

    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(model["vocab"]) != 256 + len(merged):
        return _Side(slow, tokens)
    fast = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks={tokens[i]: i for i in model["vocab"].values()}, special_tokens={}).encode_ordinary
    unsettled = re.compile(UNSETTLED).search

    def words_of(words: list[str]) -> list[list[int]]:
        rare = [w for w in words if unsettled(w)]
        known_rare = dict(zip(rare, slow(rare), strict=True)) if rare else {}
        return [known_rare[w] if w in known_rare else fast(w) for w in words]

    return _Side(words_of, tokens)


def _pieces(data: bytes) -> _Side:
    from sentencepiece import SentencePieceProcessor

    known = SentencePieceProcessor(model_proto=data)
    names = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if known.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    if any("▁" in p.lstrip("▁") for i, p in enumerate(names) if not known.is_control(i)):
        raise ValueError("pieces cross spaces: words cannot be encoded apart")
    space = known.piece_to_id("▁")
    # Words begin with a space, which the tokenizer adds by itself.
    return _Side(lambda words: [ids or [space] for ids in known.encode([w[1:] for w in words], num_threads=1)], tokens)


def _encode(a_file, b_file):
    """Step 1 over a partition."""

    def run(batches):
        import re
        from array import array

        from pyspark import TaskContext

        sides = _byte_level(a_file.value), _pieces(b_file.value)
        split, cut_at = re.compile(WORD_CUT).split, re.compile(WORD_CUT).search
        known: dict[str, tuple] = {}
        key = TaskContext.get().partitionId() << 33

        def learn(words: list[str]) -> None:
            """Both sides' ids of words not seen yet; None where they do not spell the word."""
            for word, *ids in zip(words, *(s.words(words) for s in sides), strict=True):
                plain = word.encode()
                spelt = all(b"".join(map(s.tokens.__getitem__, i)) == plain for s, i in zip(sides, ids, strict=True))
                known[word] = tuple(array("H", i).tobytes() for i in ids) if spelt else None

        def encoded(words: list[list[str]]) -> list[tuple[bytes, bytes] | None]:
            """The ids of both sides of texts cut into words; None where a text is not spelt."""
            new = list({w for ws in words for w in ws if w not in known})
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = list({w for ws in words for w in ws})
            learn(new)
            parts = [[known[w] for w in ws] for ws in words]
            for w in [w for w in new if len(w) > KEPT_LENGTH]:
                del known[w]
            return [None if None in p else (b"".join([x[0] for x in p]), b"".join([x[1] for x in p])) for p in parts]

        def long_text(text: str) -> tuple[bytes, bytes] | None:
            """A text that is too long to be cut into words at once, in pieces that end between words."""
            out, at = [], 0
            while at < len(text):
                stop = cut_at(text, at + TEXT_BYTES)
                stop = stop.start() if stop else len(text)
                piece = encoded([split(text[at:stop])])[0]
                if piece is None:
                    return None
                out.append(piece)
                at = stop
            return b"".join([p[0] for p in out]), b"".join([p[1] for p in out])

        def events(texts: list[str | None], ids: pa.Array):
            nonlocal key
            if len(texts) == 1 and len(texts[0] or "") > 2 * TEXT_BYTES:
                found = [long_text(" " + texts[0])]
            else:
                found = encoded([split(" " + t) if t else [] for t in texts])
            out: dict[str, list] = {c: [] for c in ("key", "side", "start", "final", "ids", "row")}
            for row, both in enumerate(found):
                for side in (0, 1):
                    tokens = both[side] if both else b""
                    if len(tokens) <= 2 * BLOCK:
                        starts = [0]
                    else:
                        starts = [0, *np.cumsum(sides[side].sizes[np.frombuffer(tokens, np.uint16)])[BLOCK - 1 :: BLOCK].tolist()][: -(-len(tokens) // (2 * BLOCK))]
                    for i, start in enumerate(starts):
                        out["key"].append(key)
                        out["side"].append(side)
                        out["start"].append(start)
                        out["final"].append(i + 1 == len(starts))
                        out["ids"].append(tokens[2 * BLOCK * i : 2 * BLOCK * (i + 1)])
                        out["row"].append(row)
                key += 1
            kinds = {"key": pa.int64(), "side": pa.int32(), "start": pa.int64(), "final": pa.bool_(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([*[pa.array(out[c], kinds[c]) for c in kinds], ids.take(pa.array(out["row"], pa.int64()))], [*kinds, "doc_id"])

        for batch in batches:
            for at, n in slices(batch.column("text"), TEXT_BYTES):
                yield from events(batch.column("text").slice(at, n).to_pylist(), batch.column("doc_id").slice(at, n))

    return run


def _swept_tokens(a: np.ndarray, b: np.ndarray, sizes: list[np.ndarray]):
    """Whole groups at once: their shared ends, every end with its overlap, and the tokens in the order of the groups' text.

    Tokens of many documents may stand one after another: where a document ends, both sides end.
    """
    ea, eb = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    same_a = eb[np.minimum(np.searchsorted(eb, ea), len(eb) - 1)] == ea
    same_b = ea[np.minimum(np.searchsorted(ea, eb), len(ea) - 1)] == eb
    shared = ea[same_a]
    every = np.sort(np.concatenate([ea, eb[~same_b]]), kind="stable")
    pairs = a[np.searchsorted(ea, every)] << 16 | b[np.searchsorted(eb, every)]
    # The groups as text: tokens in the order group, side, place, each with what follows it.
    ga, gb = np.searchsorted(shared, ea), np.searchsorted(shared, eb)
    order = np.empty(len(a) + len(b), np.int64)
    before_b = np.concatenate([[0], np.cumsum(np.bincount(gb, minlength=len(shared)))])
    through_a = np.cumsum(np.bincount(ga, minlength=len(shared)))
    order[np.arange(len(a)) + before_b[ga]] = a * 2 + same_a
    order[np.arange(len(b)) + through_a[gb]] = 2 * len(sizes[0]) + b * 2 + same_b
    return shared, every, pairs, order


class _Open:
    """The state of the sweep of a text in blocks: the tokens after the last shared end, by side, and the sums so far."""

    def __init__(self):
        self.tail = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.final = [False, False]
        self.tokens, self.groups, self.links = [0, 0], 0, 0
        self.hash = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self) -> None:
        """Pairs so far as distinct ones with their numbers: bounded by the two vocabularies."""
        codes, times = np.concatenate([p[0] for p in self.pairs]), np.concatenate([p[1] for p in self.pairs])
        distinct, number = np.unique(codes, return_inverse=True)
        self.pairs = [(distinct, np.bincount(number, times).astype(np.int64))]

    def step(self, sizes: list[np.ndarray], names: list[bytes]) -> None:
        """Close every group that the tokens at hand complete; what comes after the last shared end waits."""
        ends = [np.cumsum(s[t]) for s, t in zip(sizes, self.tail, strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)
        if not len(shared):
            return
        stop = [int(np.searchsorted(e, shared[-1], "right")) for e in ends]
        a, b = (t[:n] for t, n in zip(self.tail, stop, strict=True))
        shared, every, pairs, order = _swept_tokens(a, b, sizes)
        self.pairs.append(np.unique(pairs, return_counts=True))
        if len(self.pairs) > 64:
            self.merge()
        self.hash.update((b";" if self.groups else b"") + b"".join(map(names.__getitem__, order.tolist()))[:-1])
        self.tokens = [t + n for t, n in zip(self.tokens, stop, strict=True)]
        self.groups, self.links = self.groups + len(shared), self.links + len(every)
        self.tail = [t[n:] for t, n in zip(self.tail, stop, strict=True)]


def _sweep(sizes: list[np.ndarray]):
    """Step 2 over a partition of events, sorted by document, offset and side.

    Documents of one block a side are swept many at a time, longer ones block by block.
    """

    def run(batches):
        from pyspark import TaskContext

        # What a token says in a group: its id, and a comma, or what ends its side of the group.
        names = [f"{i}{e}".encode() for s, ends in zip(sizes, ((",", "|"), (",", ";")), strict=True) for i in range(len(s)) for e in ends]
        no, kind = TaskContext.get().partitionId() << 33, None

        def chunk(doc_ids, columns, codes, number, times, per_doc) -> pa.RecordBatch:
            """A row of swept documents: their columns, distinct pairs, and each document's share of them."""
            nonlocal no
            no += 1
            row = {"chunk": no, "doc_ids": pa.array(doc_ids, kind), **columns, "a": codes >> 16, "b": codes & 0xFFFF, "n": np.bincount(number, times, len(codes)).astype(np.int64), "sizes": per_doc, "links": _pack(number), "times": _pack(times)}
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(kind)), *[(c, longs) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.list_(pa.string())), ("a", ints), ("b", ints), ("n", longs), ("sizes", longs), ("links", pa.binary()), ("times", pa.binary())]))

        def many(docs: list[tuple]) -> pa.RecordBatch:
            """Whole documents (doc_id and the ids of both sides) in one sweep."""
            counts = [np.fromiter((len(d[k]) // 2 for d in docs), np.int64, len(docs)) for k in (1, 2)]
            a, b = (np.frombuffer(b"".join(d[k] for d in docs), "<u2").astype(np.int64) for k in (1, 2))
            columns = {"n_a": counts[0], "n_b": counts[1], "n_groups": np.zeros(len(docs), np.int64), "n_links": np.zeros(len(docs), np.int64), "groups_sha256": [""] * len(docs)}
            none = np.zeros(0, np.int64)
            if not len(a):
                return chunk([d[0] for d in docs], columns, none, none, none, columns["n_links"])
            shared, every, pairs, order = _swept_tokens(a, b, sizes)
            last = np.cumsum(counts[0]) - 1
            ends = np.where(last >= 0, np.cumsum(sizes[0][a])[last], 0)  # an empty document ends where the one before it does
            of = np.searchsorted(ends, every)
            columns["n_groups"], columns["n_links"] = np.bincount(np.searchsorted(ends, shared), minlength=len(docs)), np.bincount(of, minlength=len(docs))
            own, times = np.unique(of << 32 | pairs, return_counts=True)
            codes, number = np.unique(own & 0xFFFFFFFF, return_inverse=True)
            at = 0
            for i, n in enumerate((counts[0] + counts[1]).tolist()):
                if n:
                    columns["groups_sha256"][i] = hashlib.sha256(b"".join(map(names.__getitem__, order[at : at + n].tolist()))[:-1]).hexdigest()
                at += n
            return chunk([d[0] for d in docs], columns, codes, number, times, np.bincount(own >> 32, minlength=len(docs)))

        def one(doc_id, now: _Open) -> pa.RecordBatch:
            now.merge()
            codes, times = now.pairs[0]
            return chunk([doc_id], {"n_a": [now.tokens[0]], "n_b": [now.tokens[1]], "n_groups": [now.groups], "n_links": [now.links], "groups_sha256": [now.hash.hexdigest()]}, codes, np.arange(len(codes)), times, [len(codes)])

        now, now_key, first = None, None, b""
        docs, waiting = [], 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for key, side, final, ids, doc_id in zip(*[batch.column(c).to_pylist() for c in ("key", "side", "final", "ids", "doc_id")], strict=True):
                if key != now_key:
                    now, now_key, first = None, key, ids
                    if not final:
                        now = _Open()
                elif now is None and not final:  # the other side was a single block
                    now = _Open()
                    now.tail[0], now.final[0] = np.frombuffer(first, "<u2").astype(np.int64), True
                elif now is None:
                    docs.append((doc_id, first, ids))
                    waiting += len(first) + len(ids)
                    if waiting >= 2 * GROUP_TOKENS:
                        yield many(docs)
                        docs, waiting = [], 0
                if now is not None:
                    now.tail[side] = np.concatenate([now.tail[side], np.frombuffer(ids, "<u2").astype(np.int64)])
                    now.final[side] = now.final[side] or final
                    if len(ids) == 2 * BLOCK or all(now.final):
                        now.step(sizes, names)
                    if all(now.final):
                        yield one(doc_id, now)
        if docs:
            yield many(docs)

    return run


def _sums(kind: str):
    """Step 3 in a chunk: each document's sums over its links, from the counts of the chunk's pairs."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

    def run(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        at = lambda c: chunk.column(c).combine_chunks()[0].values
        sizes = at("sizes").to_numpy().astype(np.int64)
        total = int(sizes.sum())
        links, times = (_unpack(chunk.column(c)[0].as_py(), total).astype(np.int64) for c in ("links", "times"))
        count, best = np.zeros(len(at("a")), np.int64), np.zeros(len(at("a")), np.int64)
        local = counted.column("local").to_numpy()
        count[local], best[local] = counted.column("count").to_numpy(), counted.column("best").to_numpy().astype(np.int64)
        running = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(sizes)])])
        sums = {"n_best": pa.array(running(best[links] * times)), "count_sum": pa.array(running(count[links] * times))}
        return pa.Table.from_arrays([at("doc_ids"), *[sums[c] if c in sums else at(c) for c in names]], ["doc_id", *names])

    return run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[:-1]) + ", groups_sha256 string"


def _swept(documents: DataFrame, a_file: str, b_file: str) -> DataFrame:
    spark = documents.sparkSession
    shared, sizes = [], []
    for name, side in ((a_file, _byte_level), (b_file, _pieces)):
        with open(name, "rb") as f:
            data = f.read()
        shared.append(spark.sparkContext.broadcast(data))
        sizes.append(side(data).sizes)
    if max(map(len, sizes)) > 1 << 16:
        raise ValueError("ids must be below 65,536")
    kind = dict(documents.dtypes)["doc_id"]
    events = documents.select("doc_id", "text").mapInArrow(lean(_encode(*shared)), _EVENTS.format(kind=kind))
    dealt = events.repartition("key").sortWithinPartitions("key", "start", "side")
    return cut(dealt.mapInArrow(lean(_sweep(sizes)), _SWEPT.format(kind=kind)))


def pair_counts(swept: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold a pair of ids, and whether that is the most of its B id."""
    counts = swept.select(F.explode(F.arrays_zip("a", "b", "n")).alias("z")).groupBy(F.col("z.a").alias("a"), F.col("z.b").alias("b")).agg(F.sum("z.n").alias("count"))
    counts = cut(counts)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(documents: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document.

    ``a_file`` is a byte-level vocabulary, ``b_file`` a model of pieces; both are read on the
    driver and sent as they are (a few MB). Ids must be below 65,536.
    """
    swept = _swept(documents, a_file, b_file)
    pairs = swept.select(F.col("chunk").alias("at"), F.posexplode(F.arrays_zip("a", "b")).alias("local", "z")).select("at", "local", F.col("z.a").alias("a"), F.col("z.b").alias("b"))
    counted = pairs.join(pair_counts(swept), ["a", "b"]).select("at", "local", "count", "best")
    run, schema = _sums(dict(documents.dtypes)["doc_id"])
    return swept.groupBy("chunk").cogroup(counted.groupBy("at")).applyInArrow(run, schema)
