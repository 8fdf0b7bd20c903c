"""Precedence: winners, audits and layered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinals


def winner(rows: DataFrame, key: str | list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key by ``order``.

    An aggregate of a struct rather than a window: rows combine before the
    shuffle, so a hot key costs one row per task. Order columns must be
    comparable ascending (negate numbers for descending).
    """
    keys = [key] if isinstance(key, str) else key
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns])).alias("w")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"w.{c}") for c in columns])


def audit(rows: DataFrame, key: str, order: list[Column], reasons: list[tuple[Column, str]], last: str) -> DataFrame:
    """Each row's rank within its key, whether it is in effect, and why not."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("layer_rank", F.row_number().over(w) - 1)
    reason = F.when(F.col("layer_rank") == 0, "effective")
    for condition, text in reasons:
        reason = reason.when(condition, text)
    return ranked.withColumn("reason", reason.otherwise(last))


def first_rule(rules: list[tuple[str, str]], text: Column, otherwise: str) -> Column:
    """The name of the first rule whose pattern the text matches."""
    out = F.when(F.lit(False), "")
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def layered_merge(rows: DataFrame, key: str, order: list[Column], value: str, stop: Column) -> DataFrame:
    """The first value that is not null, walking layers in order up to the first one that stops."""
    w = Window.partitionBy(key).orderBy(*order)
    walked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    open_ = F.col("_before") == 0
    return walked.groupBy(key).agg(F.count_if(open_).alias("n_layers"), F.min_by(value, F.when(open_ & F.col(value).isNotNull(), F.col("_n"))).alias("merged_value"))


def union_mappings(rows: DataFrame, key: str, order: list[str], scalars: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """A row for each key: the ``scalars`` of its first mapping, the number of mappings, and a flag ``has<Kind>`` for each of ``kinds``.

    First by ``order``; the scalars come from one mapping, nulls among them. Rows combine before the shuffle.
    """
    head = F.min(F.struct(*order, F.struct(*scalars).alias("_s"))).alias("_first")
    flags = [F.bool_or(F.coalesce(F.col(kind) == k, F.lit(False))).alias(f"has{k[:1].upper()}{k[1:]}") for k in kinds]
    return rows.groupBy(key).agg(head, F.count(F.lit(1)).alias("n_mappings"), *flags).select(key, *[F.col(f"_first._s.{c}").alias(c) for c in scalars], "n_mappings", *[f"has{k[:1].upper()}{k[1:]}" for k in kinds])


def by_role(rows: DataFrame, key: str, role: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mappings made one for each key and role: the first of each with the number of its evidence, and all evidence, numbered within it."""
    rest = [c for c in rows.columns if c not in (key, role, *order)]
    heads = rows.groupBy(key, role).agg(F.min(F.struct(*order, *rest)).alias("_first"), F.count(F.lit(1)).alias("n_evidence")).select(key, role, "_first.*", "n_evidence")
    return heads, with_ordinals(rows, order, "evidence_no", within=[key, role])


def union_evidence(rows: DataFrame, key: str, order: str, sources: str) -> DataFrame:
    """Per key the first id, the number of rows and the distinct sources in order."""
    return rows.groupBy(key).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n_evidence"), F.array_join(F.array_sort(F.collect_set(sources)), " | ").alias("sources"))


def collisions(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Per key the number of distinct values, and whether there is more than one."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values"))
    return out.withColumn("collides", F.col("n_values") > 1)
