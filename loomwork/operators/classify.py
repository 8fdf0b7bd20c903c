"""Ownership by ranked rules, its summary, and human decisions over what is unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of confidences, and of categories at equal confidence (low wins).
CONFIDENCE = {"high": 0, "medium": 1, "low": 2}
PRECEDENCE = {"bark": 10, "quest": 20, "skill_spell": 30, "item": 40, "book_lore": 45, "character_world": 46, "system_message": 47, "tutorial": 48, "ui": 50, "dialogue_general": 60, "other": 100}


def candidates(rows: DataFrame, key: str, rules: list[tuple[Column, str, str, str]]) -> DataFrame:
    """key, category, confidence, rule_id: one row for each rule (condition, category, confidence, id) that a row meets."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(cat).alias("category"), F.lit(conf).alias("confidence"), F.lit(rule).alias("rule_id"))) for c, cat, conf, rule in rules]))
    return rows.select(key, F.inline(hits))


def owners(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row per key of ``rows``: the category of the strongest confidence, then of the least precedence; the others as tags."""
    lookup = lambda values, c: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col(c)]
    ranked = found.select(key, "category", "confidence", F.struct(lookup(CONFIDENCE, "confidence").alias("c"), F.coalesce(lookup(PRECEDENCE, "category"), F.lit(100)).alias("p"), F.col("category").alias("category"), F.col("confidence").alias("confidence")).alias("r"))
    best = ranked.groupBy(key).agg(F.min("r").alias("r"), F.array_sort(F.collect_set("category")).alias("all"))
    tags = F.array_join(F.transform(F.filter("all", lambda x: x != F.col("r.category")), lambda x: F.concat(F.lit("also:"), x)), ";")
    status = F.when(F.col("r").isNull(), "unresolved").otherwise("classified")
    return rows.select(key).join(best, key, "left").select(key, F.col("r.category").alias("primary_category"), F.col("r.confidence").alias("confidence"), F.coalesce(tags, F.lit("")).alias("tags"), status.alias("status"))


def zero_filled(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain; values without rows count 0, values outside it are left out."""
    values = rows.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def overlay_decisions(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Unresolved rows take the category decided for them; classified rows keep theirs.

    ``decisions``: key, action (classify or exclude), category. Decisions for
    unknown or classified rows are errors.
    """
    joined = decisions.join(rows.select(key, "status"), key, "left")
    bad = joined.where(F.col("status").isNull() | (F.col("status") != "unresolved"))
    if not bad.isEmpty():
        raise ValueError("a decision for a row that is unknown or classified")
    d = decisions.select(key, "action", F.col("category").alias("decided"))
    status = F.when(F.col("action") == "exclude", "excluded").when(F.col("action") == "classify", "classified").otherwise(F.col("status"))
    return rows.join(d, key, "left").select(key, F.coalesce("primary_category", F.when(F.col("action") == "classify", F.col("decided"))).alias("primary_category"), status.alias("status"), F.coalesce("action", F.lit("none")).alias("action"))
