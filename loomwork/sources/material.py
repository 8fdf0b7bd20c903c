"""Batch material laid out by batch, and claims looked up in it.

Material is a table with a folder for each batch. A lookup of claims reads the folders of
their batches alone: which these are is known from the claims while the query runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import protected_tokens

MATERIAL = "content_uid string, source_text string, primary_category string, canonical_group_key string, context_group_keys array<string>, batch_id string"


def write(rows: DataFrame, path: str) -> None:
    """Material (the columns of MATERIAL) by batch; a large batch takes several files, so none is one task's work alone."""
    names = [c.split(" ")[0] for c in MATERIAL.split(", ")]
    # Rebalanced rather than dealt by batch: Spark splits what is too large.
    rows.select(*names).hint("rebalance", "batch_id").write.mode("errorifexists").partitionBy("batch_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATERIAL).parquet(path)


def _refuse(found: DataFrame, fault: Column) -> None:
    first = found.select(fault.alias("fault")).where("fault IS NOT NULL").limit(1).collect()
    if first:
        raise ValueError(first[0].fault)


def checked(material: DataFrame, plan: DataFrame) -> DataFrame:
    """``material``, or an error: rows without a uid, a uid twice, a batch that the plan does not know or that has another size or category, a batch without material.

    ``plan``: batch_id, category, record_count. Sizes and categories are an aggregate of a
    row for each batch, uids one of a row for each uid.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    have = material.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("content_uid", F.lit("")) == "").alias("bare"), F.min("primary_category").alias("low"), F.max("primary_category").alias("high"))
    want = plan.select(F.col("batch_id").alias("_batch"), F.col("category").alias("_category"), F.col("record_count").alias("_count"))
    met = have.join(want, F.col("batch_id") == F.col("_batch"), "full")
    _refuse(
        met,
        F.when(F.col("_batch").isNull(), text("batchId not present in batch plan: ", F.coalesce("batch_id", F.lit(""))))
        .when(F.col("batch_id").isNull(), text("batch material not found: ", F.col("_batch")))
        .when(F.col("bare") > 0, text("missing ContentUid in ", F.col("batch_id")))
        .when(F.col("n") != F.col("_count"), text("record count mismatch for ", F.col("batch_id")))
        .when(~(F.col("low").eqNullSafe(F.col("_category")) & F.col("high").eqNullSafe(F.col("_category"))), text("category mismatch for ", F.col("batch_id"))),
    )
    _refuse(material.groupBy("content_uid").agg(F.count(F.lit(1)).alias("n")), F.when(F.col("n") > 1, text("duplicate ContentUid: ", F.col("content_uid"))))
    return material


def requests(claims: DataFrame, material: DataFrame, plan: DataFrame) -> DataFrame:
    """Each claim (content_uid, batch_id, attempt_number, input_hash) with its material and the tokens to keep.

    A claim of a batch that the plan does not know, of a uid that its batch does not hold,
    or holds twice, is an error of the job when its row is reached.
    """
    known = plan.select(F.col("batch_id").alias("_batch")).distinct()
    asked = claims.select("content_uid", "batch_id", "attempt_number", "input_hash")
    rows = material.select("batch_id", "content_uid", F.struct("source_text", "primary_category", "canonical_group_key", "context_group_keys").alias("m"))
    # Only folders of batches that are claimed are read: Spark prunes partitions by the filtered side of the join while it runs.
    own = rows.join(F.broadcast(_few(asked.where("batch_id > ''").select("batch_id").distinct())), "batch_id").groupBy("batch_id", "content_uid").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"))
    met = asked.join(known, F.col("batch_id") == F.col("_batch"), "left").join(own, ["batch_id", "content_uid"], "left")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    fault = (
        F.when(F.col("_batch").isNull(), text("batchId not present in batch plan: ", F.coalesce("batch_id", F.lit(""))))
        .when(F.col("m").isNull(), text("ContentUid ", F.coalesce("content_uid", F.lit("")), " missing from material for ", F.col("batch_id")))
        .when(F.col("n") > 1, text("duplicate ContentUid: ", F.col("content_uid")))
    )
    uid = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("content_uid"))
    source = F.coalesce(F.col("m.source_text"), F.lit(""))
    return met.select(uid.alias("content_uid"), "batch_id", "attempt_number", "input_hash", source.alias("source_text"), F.coalesce("m.primary_category", F.lit("")).alias("primary_category"), F.coalesce("m.canonical_group_key", F.lit("")).alias("canonical_group_key"), F.coalesce("m.context_group_keys", F.array().cast("array<string>")).alias("context_group_keys"), protected_tokens(source).alias("protected_tokens"))


#: Batches claimed at once, at most: their ids are sent to every task.
MOST_BATCHES = 100_000


def _few(batches: DataFrame) -> DataFrame:
    """``batches``, or an error where they are too many to broadcast: a count that stops at the bound."""
    if batches.limit(MOST_BATCHES + 1).count() > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches claimed at once: claim in several rounds")
    return batches


def with_context(material: DataFrame, context: DataFrame) -> DataFrame:
    """Material with ``context`` of its uid (content_uid, context), empty where there is none."""
    side = context.groupBy("content_uid").agg(F.min("context").alias("_context"))
    return material.join(side, "content_uid", "left").withColumn("context", F.coalesce("_context", F.lit(""))).drop("_context")
