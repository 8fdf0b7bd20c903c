"""Durable execution state as folds of attempt histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that may run again.
EXECUTABLE = ("pending", "failed-retryable", "invalidated")


def seed(existing: DataFrame, items: DataFrame, key: str, digest: str) -> DataFrame:
    """Upsert: new items are pending, unchanged ones keep their state, changed ones are invalidated with their attempts reset; others stay."""
    e = existing.select(key, F.col(digest).alias("_old"), "status", "attempt_count")
    n = items.select(key, F.col(digest).alias("_new"))
    both = e.join(n, key, "full")
    changed = F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old") != F.col("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "untouched").when(changed, "invalidate").otherwise("keep")
    return both.select(
        key,
        F.coalesce("_new", "_old").alias(digest),
        F.when(F.col("_old").isNull(), "pending").when(changed, "invalidated").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_old").isNull() | changed, 0).otherwise(F.col("attempt_count")).cast("int").alias("attempt_count"),
        action.alias("action"),
    )


def number_attempts(attempts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return attempts.withColumn("attempt_number", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def status_after(outcome: Column, count: Column, max_attempts: int) -> Column:
    """State after an attempt: retryable failures become final at the limit."""
    return F.when(outcome == "succeeded", "succeeded").when(outcome == "running", "running").when((outcome == "failed-retryable") & (count < max_attempts), "failed-retryable").otherwise("failed-final")


def fold(attempts: DataFrame, key: list[str], order: list[str], outcome: str, max_attempts: int) -> DataFrame:
    """Current state per key from all its attempts: a max of structs, so that histories combine before the shuffle."""
    last = F.max(F.struct(*order, F.col(outcome).alias("_outcome"))).alias("_last")
    out = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("attempt_count"), last, F.count_if(F.col(outcome) == "succeeded").alias("n_succeeded"))
    return out.select(*key, "attempt_count", "n_succeeded", *[F.col(f"_last.{c}").alias(f"last_{c}") for c in order], F.col("_last._outcome").alias("last_outcome"), status_after(F.col("_last._outcome"), F.col("attempt_count"), max_attempts).alias("status"))


def executable(states: DataFrame, now: Column, max_attempts: int, lease: str = "lease_expires_at") -> DataFrame:
    """Rows that may be claimed: a status to run, attempts left, and no lease that still holds."""
    return states.where(F.col("status").isin(*EXECUTABLE) & (F.col("attempt_count") < max_attempts) & (F.col(lease).isNull() | (F.col(lease) <= now)))


def claim(states: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by order, numbered: a top-k, not a sort of the table."""
    return states.orderBy(*order).limit(n).withColumn("claim_order", F.row_number().over(Window.orderBy(*order)))


def recover(states: DataFrame, now: Column, lease: str = "lease_expires_at") -> DataFrame:
    """Running rows whose lease is over become retryable."""
    stale = (F.col("status") == "running") & (F.col(lease) <= now)
    return states.withColumn("recovered", F.coalesce(stale, F.lit(False))).withColumn("status", F.when(F.col("recovered"), "failed-retryable").otherwise(F.col("status")))


def reopen(states: DataFrame, max_attempts: int) -> DataFrame:
    """After a quality retry: output goes, attempts stay; final at the limit."""
    return states.withColumn("status", F.when(F.col("attempt_count") < max_attempts, "failed-retryable").otherwise("failed-final")).withColumn("translated_text", F.lit(None).cast("string"))


def disposition(status: Column, has_output: Column, qa_present: Column, qa_stale: Column, qa_matches: Column, route: Column, accepted: Column) -> Column:
    """DISPOSITION/REASON by ordered rules that fail closed."""
    return (
        F.when(status == "pending", "WAITING_TRANSLATION/EXECUTION_PENDING")
        .when(status == "running", "WAITING_TRANSLATION/EXECUTION_RUNNING")
        .when(status == "invalidated", "WAITING_TRANSLATION/EXECUTION_INVALIDATED")
        .when(status == "failed-retryable", "WAITING_RETRY/EXECUTION_FAILED_RETRYABLE")
        .when(status == "failed-final", "BLOCKED/EXECUTION_FAILED_FINAL")
        .when(status == "skipped", "BLOCKED/EXECUTION_SKIPPED")
        .when(status.isNull() | (status != "succeeded"), "BLOCKED/EXECUTION_STATUS_UNKNOWN")
        .when(~has_output, "BLOCKED/SUCCEEDED_OUTPUT_MISSING")
        .when(~qa_present, "BLOCKED/QA_RESULT_MISSING")
        .when(qa_stale, "BLOCKED/QA_RESULT_STALE")
        .when(~qa_matches, "BLOCKED/QA_OUTPUT_MISMATCH")
        .when(route == "PASS", "MERGE_READY/READY")
        .when(route == "RETRY", "WAITING_RETRY/QA_RETRY")
        .when((route == "REVIEW") & accepted, "MERGE_READY/HUMAN_REVIEW_ACCEPTED")
        .when(route == "REVIEW", "WAITING_REVIEW/QA_REVIEW")
        .when(route == "FAIL", "BLOCKED/QA_FAIL")
        .otherwise("BLOCKED/QA_ROUTE_UNKNOWN")
    )


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last entry of an append-only log for each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
