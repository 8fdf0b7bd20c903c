"""Shards of near equal bytes by sampled splitters.

Law ``bytes``: records are ordered by a key that starts with their text's CRC, so
equal texts stand together, and the shards divide that line of bytes evenly.
Splitters find a record's place on it without sorting everything in one task:
quantiles of a key sample, drawn with a chance in proportion to size, bound a
fixed number of ranges for each shard; ranges that come out overfull are cut again
by a sample of their own, all in one job; sizes are summed over ranges and within
each range. Ranges decide who computes a place, never the place itself.

The law's tolerance is WHOLE of a shard's bytes: records of one text stay in one
shard while they hold no more than that, as they move with the middle of their
group. A text that holds more is cut like any other range, as the key goes on with
the document's id.

Only DataFrame functions. What reaches the driver and what is broadcast is a few
numbers for each range, of which there are at most RANGES * (1 + PIECES) for each
shard, however large the input.

Defined cases: null text has size 16 and the CRC of an empty text; repeated rows
are separate records; records that agree in id and text are interchangeable; null
ids hash like any value; a very long text is one record and makes its shard larger
by as much; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ranges for each shard, sampled keys for each range (on average), and the pieces that an overfull range is cut into.
RANGES, SAMPLE, PIECES = 16, 128, 16
#: A range is overfull beyond so many times the mean.
OVERFULL = 2.0
#: Share of a shard's bytes up to which a group of equal texts is not cut.
WHOLE = 0.02
OVERHEAD = 16


def records(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key and tie: what places a record. The key has 32 bits of the text and 31 of the id."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = documents.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    tie = F.xxhash64("doc_id")
    return base.select("*", (F.shiftleft("text_crc32", 31) + tie.bitwiseAND(F.lit((1 << 31) - 1))).alias("key"), tie.alias("tie"))


def _drawn(rows: DataFrame, step: float) -> DataFrame:
    """Rows with ``w``, how often a record is in a sample of one key for each ``step`` bytes: floor(size / step), and one more with the chance of the rest.

    The sample is a function of the record, so a repeated run draws the same one.
    """
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return rows.withColumn("w", F.floor(F.col("size") / F.lit(step) + draw).cast("long")).where("w > 0")


def _quantiles(n: int) -> Column:
    """n - 1 keys that cut the sampled weight into n equal parts; a key counts as often as it was drawn."""
    return F.percentile(F.col("key"), F.array(*[F.lit(i / n) for i in range(1, n)]), F.col("w"))


def _range_of(splitters: list[int]) -> Column:
    """Number of splitters at or below the key, by two steps of about sqrt(n) comparisons each."""
    if not splitters:
        return F.lit(0)
    wide = max(1, math.isqrt(len(splitters)))
    rows = [splitters[i : i + wide] for i in range(0, len(splitters), wide)]
    heads = F.lit([r[0] for r in rows])
    table = F.lit(splitters)
    at = F.size(F.filter(heads, lambda x: x <= F.col("key")))
    inner = F.size(F.filter(F.slice(table, F.greatest(at - 1, F.lit(0)) * wide + 1, F.lit(wide)), lambda x: x <= F.col("key")))
    return F.when(at == 0, 0).otherwise((at - 1) * wide + inner)


def splitters(rows: DataFrame, shards: int, total: int) -> list[int]:
    """Keys that bound ranges of near equal bytes; none lies within a group of equal texts that stays whole."""
    n = RANGES * shards
    step = max(1.0, total / (n * SAMPLE))
    cut_at = lambda keys: {int(k) >> 31 << 31 for k in keys or ()}  # noqa: E731 - between texts
    found = sorted(cut_at(_drawn(rows, step).agg(_quantiles(n).alias("q")).first().q))
    sizes = rows.withColumn("part", _range_of(found)).groupBy("part").agg(F.sum("size").alias("b"), F.max("size").alias("most"))
    over = [(r.part, r.b) for r in sizes.where((F.col("b") > OVERFULL * total / n) & (F.col("b") > 2 * F.col("most"))).collect()]  # at most n / OVERFULL rows
    if not over:
        return found
    inside = rows.withColumn("part", _range_of(found)).where(F.col("part").isin([p for p, _ in over]))
    again, held = _drawn(inside, step).groupBy("part").agg(_quantiles(PIECES).alias("q")).collect(), dict(over)
    for r in again:
        texts = Counter(int(k) >> 31 for k in r.q)
        # A text that spans so many of the range's quantiles holds more than what stays whole, and is cut within.
        cut_within = {t for t, c in texts.items() if (c - 1) / PIECES * held[r.part] > 2 * WHOLE * total / shards}
        found += [int(k) if int(k) >> 31 in cut_within else int(k) >> 31 << 31 for k in r.q]
    return sorted(set(found))


def place(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per record."""
    rows = cut(records(documents))
    total = rows.agg(F.sum("size").alias("b")).first().b or 0
    bounds = splitters(rows, shards, total)
    ranged = rows.withColumn("part", _range_of(bounds))
    order = Window.partitionBy("part").orderBy("key", "tie", "size")
    # Where each range starts on the line of bytes: one row per range, of which there are few.
    starts = ranged.groupBy("part").agg(F.sum("size").alias("b"))
    starts = starts.select("part", (F.sum("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("start"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = Window.partitionBy("part", "text_crc32")
    lined = ranged.withColumn("before", before).withColumn("group_size", F.sum("size").over(group)).withColumn("group_before", F.min("before").over(group))
    lined = lined.join(F.broadcast(starts), "part")  # a row for each range: a fixed number
    own, whole = F.col("before") + F.col("size") / 2, F.col("group_before") + F.col("group_size") / 2
    middle = F.coalesce("start", F.lit(0)) + F.when(F.col("group_size") * shards <= F.lit(WHOLE * total), whole).otherwise(own)
    placed = lined.select("doc_id", "size", "text_crc32", "key", "tie", "part", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int").alias("shard"))
    # Slots: counts of the shard's earlier ranges, then the place within this range.
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    slot = F.row_number().over(Window.partitionBy("part", "shard").orderBy("key", "tie", "size")) - 1
    return placed.withColumn("slot", slot).join(F.broadcast(counts), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("earlier")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
