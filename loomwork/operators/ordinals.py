"""Exact consecutive numbers by one segmented scan: sort by ranges, count the ranges, add offsets.

Rows are sorted into ranges and written once. What is counted then is a row for each
group and range; sums of these counts over the ranges before give each range its
offset, and a row's number is its place in its range plus that offset. No task ever
holds a whole table or a whole group, so one order over everything, or a group with a
third of all rows, costs what any other row costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import settled

_RANGE, _PLACE, _GROUP = "__range__", "__place__", "__group__"


def _offsets(tagged: DataFrame) -> DataFrame:
    """A row for each group and range: where the group begins in the range, and how many of its rows stand in ranges before."""
    counts = tagged.groupBy(_GROUP, _RANGE).agg(F.count(F.lit(1)).alias("rows"), F.min(_PLACE).alias("begin"))
    before = Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(_GROUP).alias("g"), F.col(_RANGE).alias("r"), "begin", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))


def _ranged(df: DataFrame, order: Sequence[Column | str], within: Sequence[str]) -> DataFrame:
    """``df`` sorted into ranges and written once, each row with its group, its range and its place there."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes])
    keyed = df.withColumn(_GROUP, F.struct(*[F.col(f"`{c}`") for c in within]) if within else F.lit(0))
    keys = [F.col(_GROUP), *columns, tie]
    # A number of partitions from the session: ranges are cut at sampled quantiles, so they are even whatever the keys.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranged = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return settled(ranged.withColumn(_RANGE, F.shiftright(place, 33)).withColumn(_PLACE, place.bitwiseAND((1 << 33) - 1)))


def _met(tagged: DataFrame, offsets: DataFrame) -> DataFrame:
    return tagged.alias("t").join(offsets.alias("o"), F.col(f"t.{_GROUP}").eqNullSafe(F.col("o.g")) & (F.col(f"t.{_RANGE}") == F.col("o.r")))


def with_ordinals(df: DataFrame, order: Sequence[Column | str], name: str, within: Sequence[str] = (), first: int = 1) -> DataFrame:
    """``df`` with a column ``name``: first, first + 1, ... in the order given, for each group of ``within`` or over all rows.

    Rows that the order leaves equal are told apart by a hash of all their columns, which
    also spreads a much repeated key over ranges; rows alike in everything take their
    numbers in any way. Nulls stand where the order puts them, and are a group of their
    own in ``within``. The result comes from a written table, so numbers do not change when
    a task is run again. An empty table gives an empty table.
    """
    if name in df.columns:
        raise ValueError(f"{name} is already a column")
    tagged = _ranged(df, order, within)
    found = _met(tagged, _offsets(tagged))
    return found.select(*[F.col(f"t.`{c}`") for c in df.columns], (F.col(f"t.{_PLACE}") - F.col("o.begin") + F.col("o.before") + first).alias(name))


def with_running_max(df: DataFrame, order: Sequence[Column | str], value: Column, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: the greatest ``value`` of all rows up to each, in the order given, for each group or over all rows.

    Nulls count for nothing; before the first value it is null. Each range is scanned by itself
    and takes over the greatest of the ranges before it, of which there is a row for each
    group and range. Ties are told apart as in :func:`with_ordinals`.
    """
    if name in df.columns:
        raise ValueError(f"{name} is already a column")
    tagged = _ranged(df.withColumn(name, value), order, within)
    tops = tagged.groupBy(_GROUP, _RANGE).agg(F.max(name).alias("top"))
    before = Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(F.col(_GROUP).alias("g"), F.col(_RANGE).alias("r"), F.max("top").over(before).alias("carried"))
    local = Window.partitionBy(_RANGE, _GROUP).orderBy(_PLACE)
    return _met(tagged.withColumn(name, F.max(name).over(local)), carried).select(*[F.col(f"t.`{c}`") for c in df.columns], F.greatest(F.col(f"t.{name}"), F.col("o.carried")).alias(name))
