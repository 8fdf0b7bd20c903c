"""Collocations by vertical positional inverted lists.

1. Texts are read in chunks of one language. A chunk's words become lists: for each
   distinct word the sorted positions where it stands. A piece's end takes a position of
   its own, so nothing is adjacent across it. The lists are a table, a row for each chunk.
2. The length of a word's lists, summed over chunks, is its exact frequency. Words found
   often enough get consecutive ids; other words end no phrase (a phrase is never more
   frequent than its parts).
3. A frequent phrase of k words is extended by merge-joining the positions where it
   begins with the positions where the frequent phrase of its words 2 to k + 1 begins,
   one further on. The new lists are written as before, and their lengths summed.
4. Cuts, scores, the test against longer phrases and the ranks are joins and
   aggregates of frequent phrases, which are few beside the text.

What crosses a shuffle is a row for each distinct phrase of a chunk, never one for each
occurrence, so no frequent word makes a hot task. Counts are longs; a score is formed in
decimals of 38 digits, exact for frequencies below 10 ** 16, beyond which it raises.

Defined cases: null and empty texts have no words; a null language is ``und``; a very
long text is read in blocks that end where a piece ends; repeated rows all count; equal
scores are ordered by frequency and then by the phrase's bytes; an empty table gives an
empty table; columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinals
from .bpe import _pack, _unpack
from .common import best_of, cut, drop_cut, lean

#: Where pieces end, and what stands for that among the words: a separator is never a word.
SEPARATORS, END = b".,;:!?\n\x0b\x0c\r", b"."
#: Bytes of text of one language in a chunk, of all languages waiting in a task, and bytes of a word's id.
CHUNK_BYTES, WAITING_BYTES, ID = 4 << 20, 16 << 20, 5
_LISTS = "chunk bigint, lang string, n bigint, words array<binary>, counts array<bigint>, starts binary"
_PHRASES = "chunk bigint, hi array<bigint>, lo array<bigint>, counts array<bigint>, starts binary"


def _pack_lists(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted positions of lists one after another, each as steps from the one before."""
    steps = np.diff(starts, prepend=0)
    first = np.cumsum(counts) - counts
    steps[first] = starts[first]
    return _pack(steps)


def _unpack_lists(data: bytes, counts: np.ndarray) -> np.ndarray:
    steps = _unpack(data, int(counts.sum())).astype(np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - steps[first], counts)


def _blocks(text: bytes):
    """A text in blocks of about a chunk, each cut where a piece ends (``text`` has END for every separator)."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        stop = text.find(END, at + CHUNK_BYTES)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


def _word_lists(batches):
    """Step 1 over a partition."""
    from pyspark import TaskContext

    fold = bytes(END[0] if b in SEPARATORS else b for b in range(256))
    numbers = count(TaskContext.get().partitionId() << 33)
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = defaultdict(int)

    def lists(lang: str) -> pa.RecordBatch | None:
        parts = waiting.pop(lang)
        size.pop(lang)
        tokens = END.join(parts).replace(END, b" . ").split()
        of: dict[bytes, int] = defaultdict(count().__next__)
        of[END]
        codes = np.fromiter(map(of.__getitem__, tokens), np.int64, len(tokens))
        del tokens, parts
        at = np.flatnonzero(codes)
        if not len(at):
            return None
        counts = np.bincount(codes)[1:]
        starts = at[np.argsort(codes[at], kind="stable")]
        row = {"chunk": next(numbers), "lang": lang, "n": len(at), "words": list(of)[1:], "counts": counts, "starts": _pack_lists(starts, counts)}
        return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("starts", pa.binary())]))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for block in _blocks(text.lower().translate(fold)):
                waiting.setdefault(lang, []).append(block)
                size[lang] += len(block) + 1
                if size[lang] >= CHUNK_BYTES and (row := lists(lang)):
                    yield row
            while sum(size.values()) >= WAITING_BYTES:  # many languages, none with a chunk of its own
                if row := lists(max(size, key=size.get)):
                    yield row
    for lang in list(waiting):
        if row := lists(lang):
            yield row


def _longer(group: pa.Table, live: pa.Table):
    """Step 3 in a chunk: the lists of phrases one word longer, as two numbers each, their lengths and positions.

    The numbers are the id of all words but the last, and that of the last. A word's id is
    its number among the frequent words, a pair's is made of its words' (below 2 ** 31
    each), that of a longer phrase is its number among the frequent ones. ``live`` has the
    frequent phrases of the lists by their number in the chunk (local), with their ids
    where the lists don't tell them.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not group.num_rows or not live.num_rows:
        return none
    array = lambda name: group.column(name).combine_chunks()[0].values.to_numpy()
    counts = array("counts")
    starts = _unpack_lists(group.column("starts")[0].as_py(), counts)
    local = live.column("local").to_numpy()
    frequent = np.zeros(len(counts), bool)
    frequent[local] = True
    if "id" in live.column_names:
        ids = np.zeros(len(counts), np.int64)
        ids[local] = live.column("id").to_numpy()
    else:
        ids = array("hi")
    last = array("lo") if "lo" in group.column_names else ids
    phrase = np.repeat(np.arange(len(counts)), counts)
    kept = frequent[phrase]
    starts, phrase = starts[kept], phrase[kept]
    by = np.argsort(starts, kind="stable")  # the lists merged: each position begins one phrase of k words at most
    starts, phrase = starts[by], phrase[by]
    met = np.flatnonzero(np.diff(starts) == 1)
    if not len(met):
        return none
    pairs, number, counts = np.unique(phrase[met] << 32 | phrase[met + 1], return_inverse=True, return_counts=True)
    hi, lo = ids[pairs >> 32], last[pairs & 0xFFFFFFFF]
    if "lo" not in group.column_names:
        hi = hi << 32 | lo  # a pair's own id
    return hi, lo, counts, starts[met][np.argsort(number, kind="stable")]


def _extend(group: pa.Table, live: pa.Table) -> pa.Table:
    """The new lists as the chunk's row."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("chunk", pa.int64()), ("hi", longs), ("lo", longs), ("counts", longs), ("starts", pa.binary())])
    hi, lo, counts, starts = _longer(group, live)
    return pa.Table.from_pylist([{"chunk": group.column("chunk")[0].as_py(), "hi": hi, "lo": lo, "counts": counts, "starts": _pack_lists(starts, counts)}] if len(hi) else [], out)


def _lengths(group: pa.Table, live: pa.Table) -> pa.Table:
    """Only the lengths of the new lists, where nothing longer is asked for."""
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in _longer(group, live)[:3]], ["hi", "lo", "n"])


def _rows(lists: DataFrame, *names: str) -> DataFrame:
    """A row for each chunk and phrase: its number in the chunk, what ``names`` say of it and the length of its list."""
    each = lists.select("chunk", *[c for c in ("lang",) if c in lists.columns], F.posexplode(F.arrays_zip(*names, "counts")).alias("local", "z"))
    return each.select("*", *[F.col(f"z.{n}").alias(n) for n in names], F.col("z.counts").alias("n")).drop("z")


def _part(key: str, first: int, words: int | None = None):
    """Words of a key, from number ``first`` (from 0), ``words`` of them or all."""
    return F.expr(f"substring({key}, {first * ID + 1}" + (f", {words * ID})" if words else ")"))


def phrases(documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of 2 to ``longest`` words found ``least`` times or more.

    a, l and r are the frequencies of the phrase and of the two parts at its worst cut, n
    the language's words; a phrase goes where one longer holds it in ``cover`` per cent
    of its occurrences or more. ``top`` phrases of each language, or all of them.
    """
    source = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    lists = cut(source.mapInArrow(lean(_word_lists), _LISTS))
    totals = cut(lists.groupBy("lang").agg(F.sum("n").alias("total")))
    rows = _rows(lists, "words").withColumnRenamed("words", "word")
    words = rows.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = cut(with_ordinals(words, ["lang", "word"], "id", first=0).select("lang", "word", "f", F.when(F.col("id") < 1 << 31, F.col("id")).otherwise(F.raise_error(F.lit("too many frequent words")).cast("long")).alias("id"), F.unhex(F.lpad(F.hex("id"), 2 * ID, "0")).alias("key")))
    live = rows.join(words, ["lang", "word"]).select(F.col("chunk").alias("at"), "local", "id")
    found = {1: words.select("key", "f", "id")}
    for k in range(2, longest + 1):
        met = lists.drop("lang", "n").groupBy("chunk").cogroup(live.groupBy("at"))
        code = ["hi"] if k == 2 else ["hi", "lo"]  # a pair's number says both of its words
        if k == longest:
            sums = cut(met.applyInArrow(_lengths, "hi bigint, lo bigint, n bigint").groupBy(*code, *["lo"] * (k == 2)).agg(F.sum("n").alias("f")).where(F.col("f") >= least))
            found[k] = _keyed(sums, found, k)
            break
        before, lists = lists, cut(met.applyInArrow(_extend, _PHRASES))
        drop_cut(before)
        # A phrase has a row for each chunk at most: frequencies stand beside the rows without a join back.
        summed = _rows(lists, *code).withColumn("f", F.sum("n").over(Window.partitionBy(*code)))
        live = cut(summed.where(F.col("f") >= least).select(F.col("chunk").alias("at"), "local", *code, "f"))
        sums = live.groupBy(*code).agg(F.max("f").alias("f"))
        if k == 2:
            found[k] = cut(_keyed(sums.withColumn("lo", F.col("hi").bitwiseAND(0xFFFFFFFF)), found, k).withColumnRenamed("hi", "id"))
            live = live.select("at", "local")
        else:
            found[k] = cut(_keyed(with_ordinals(sums, code, "id", first=0), found, k))
            live = live.join(found[k].select(*code, "id"), code).select("at", "local", "id")
    drop_cut(lists)
    return _ranked(found, words, totals, longest, cover, top)


def _keyed(sums: DataFrame, found: dict[int, DataFrame], k: int) -> DataFrame:
    """Frequent phrases with ``key``, the ids of their words joined, from the key of all words but the last and that of the last."""
    front = F.shiftright("hi", 32) if k == 2 else F.col("hi")
    first, last = found[k - 1].select(F.col("id").alias("_front"), F.col("key").alias("_a")), found[1].select(F.col("id").alias("_last"), F.col("key").alias("_b"))
    met = sums.withColumn("_of", front).join(first, F.col("_of") == F.col("_front")).join(last, F.col("lo") == F.col("_last"))
    return met.withColumn("key", F.concat("_a", "_b")).drop("_of", "_front", "_last", "_a", "_b")


def _ranked(found: dict[int, DataFrame], words: DataFrame, totals: DataFrame, longest: int, cover: int, top: int | None) -> DataFrame:
    """Step 4."""
    kept = None
    for k in range(2, longest + 1):
        scored = None
        for c in range(1, k):  # each cut: its score and where it stands
            left, right = found[c].select(F.col("key").alias("lk"), F.col("f").alias("l")), found[k - c].select(F.col("key").alias("rk"), F.col("f").alias("r"))
            base = found[k].select("key", "f") if scored is None else scored
            met = base.join(left, _part("key", 0, c) == F.col("lk")).join(right, _part("key", c) == F.col("rk")).drop("lk", "rk")
            here = F.struct(F.expr("(CAST(f AS DECIMAL(19,0)) * CAST(f AS DECIMAL(19,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))").alias("score"), F.lit(c).alias("k"), F.col("l").alias("l"), F.col("r").alias("r"))
            scored = met.withColumn("worst", here if scored is None else F.least("worst", here)).select("key", "f", "worst")
        longer = None
        for m in range(k + 1, longest + 1):
            inside = found[m].select(F.explode(F.array(*[_part("key", i, k) for i in range(m - k + 1)])).alias("key"), F.col("f").alias("held"))
            longer = inside if longer is None else longer.unionByName(inside)
        if longer is not None:
            scored = scored.join(longer.groupBy("key").agg(F.max("held").alias("held")), "key", "left").where(~F.coalesce(100 * F.col("held") >= cover * F.col("f"), F.lit(False))).drop("held")
        for i in range(k):
            w = words.select(F.col("key").alias("wk"), F.col("word").alias(f"w{i}"), *[F.col("lang")] * (i == 0))
            scored = scored.join(w, _part("key", i, 1) == F.col("wk")).drop("wk")
        scored = scored.select("lang", F.concat_ws(" ", *[F.col(f"w{i}").cast("string") for i in range(k)]).alias("phrase"), F.col("f").alias("a"), F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), F.col("worst.score").alias("score"))
        kept = scored if kept is None else kept.unionByName(scored)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is None:
        ranked = with_ordinals(kept, list(order), "rank", within=["lang"])
    else:
        ranked = best_of(kept, ["lang"], list(order), top, "rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
