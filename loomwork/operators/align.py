"""Alignment of keyed texts, presence, and reuse of existing translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinals


def align(records: DataFrame, key: str, locale: str, value: str, locales: list[str]) -> DataFrame:
    """One row per key with a column per locale, null where the locale lacks the key.

    A pivot with given values is one aggregation, however many locales there are.
    """
    return records.groupBy(key).pivot(locale, locales).agg(F.first(value, ignorenulls=True))


def presence(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key and presence_status over the full outer join of two key sets."""
    s, t = source.select(key, F.lit(True).alias("_s")), target.select(key, F.lit(True).alias("_t"))
    status = F.when(F.col("_s") & F.col("_t"), "both").when(F.col("_s"), "source-only").otherwise("target-only")
    return s.join(t, key, "full").select(key, status.alias("presence_status"))


def round_trip_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that two versions of a relation do not share; empty means equal."""
    b, a = (df.select(key, F.struct(*columns).alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def reuse_index(records: DataFrame, boundary: Column, text: str, target: str) -> DataFrame:
    """Per source text outside the boundary: how many rows translate it, and how many ways."""
    return records.where(~boundary).groupBy(F.col(text).alias("source_text")).agg(F.count(F.lit(1)).alias("n_shared"), F.count_distinct(target).alias("n_targets"))


def reuse_classes(records: DataFrame, boundary: Column, key: str, text: str, target: str) -> DataFrame:
    """Each boundary row with its reuse class: none, single, consensus or conflict.

    Single and consensus depend on the number of rows that share the text,
    conflict on the number of different translations.
    """
    index = reuse_index(records, boundary, text, target)
    wanted = records.where(boundary).select(key, F.col(text).alias("source_text"))
    cls = F.when(F.col("n_shared").isNull(), "none").when(F.col("n_targets") > 1, "conflict").when(F.col("n_shared") == 1, "single").otherwise("consensus")
    return wanted.join(index, "source_text", "left").select(key, "source_text", cls.alias("reuse_class"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"))


def conflict_groups(classes: DataFrame, key: str) -> DataFrame:
    """Conflicting texts as numbered groups: the largest first, then by text.

    Groups are numbered by a scan over ranges of them, so no task holds them all.
    """
    groups = classes.where("reuse_class = 'conflict'").groupBy("source_text").agg(F.count(F.lit(1)).alias("n_boundary"), F.min(key).alias("first_uid"))
    numbered = with_ordinals(groups, [F.desc("n_boundary"), "source_text"], "_number")
    return numbered.select(F.format_string("CONFLICT-%03d", "_number").alias("group_id"), "source_text", "n_boundary", "first_uid")


def reference_flags(keys: DataFrame, references: DataFrame, key: str, locale: str, locales: list[str]) -> DataFrame:
    """One boolean per locale: whether it has the key."""
    flags = references.groupBy(key).agg(*[F.bool_or(F.col(locale) == x).alias(f"has_{x}") for x in locales])
    return keys.select(key).join(flags, key, "left").select(key, *[F.coalesce(f"has_{x}", F.lit(False)).alias(f"has_{x}") for x in locales])


def neighbors(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Previous and next text within a group; rows without a text of their own or without neighbours go."""
    w = Window.partitionBy(group).orderBy(order)
    out = rows.withColumn("previous_text", F.lag(text, 1, "").over(w)).withColumn("next_text", F.lead(text, 1, "").over(w))
    return out.where((F.col(text) != "") & ((F.col("previous_text") != "") | (F.col("next_text") != "")))
