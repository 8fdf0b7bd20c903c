"""Transitions of execution state in bulk: tables of states and attempts in, the tables after it out.

States: content_uid, batch_id, status, translated_text, input_hash, output_hash,
last_successful_run_id, last_attempt_id, attempt_count, lease_owner,
lease_expires_at, updated_at. Attempts: attempt_id, run_id, content_uid, batch_id,
attempt_number, provider, model, started_at, finished_at, outcome, error_code,
error_message, input_hash, output_hash, prompt_tokens, completion_tokens,
total_tokens. A transition that breaks a rule raises and changes nothing.
``sources.store.transition`` makes what comes out the current tables, unless another
writer was first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import claim as first_rows
from .state import executable

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def _changed(table: DataFrame, key: str, news: DataFrame) -> DataFrame:
    """``table`` with the columns that ``news`` brings for its keys; null in ``news`` is a value."""
    columns = [c for c in news.columns if c != key]
    met = table.join(news.select(key, F.struct(*columns).alias("_new")), key, "left")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
    return met.select(*[pick(c) if c in columns else F.col(c) for c in table.columns])


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _deny(found: DataFrame, tests: dict[str, Column]) -> None:
    """Raise with one example of what breaks a rule."""
    fault = F.coalesce(*[F.when(c, F.concat_ws(" ", F.lit(text), F.col("content_uid"))) for text, c in tests.items()])
    first = found.select(fault.alias("fault")).where("fault IS NOT NULL").limit(1).collect()
    if first:
        raise ValueError(first[0].fault)


def claim(states: DataFrame, attempts: DataFrame, run: dict[str, str], worker: str, n: int, now: Column, lease_until: Column, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows that may run, by batch and uid, go to ``worker``, each with an attempt that runs. ``run``: run_id, provider, model, status."""
    if max_attempts <= 0:
        raise ValueError("max_attempts must be positive")
    if run["status"] != "running":
        raise ValueError(f"run is not active: {run['run_id']}")
    last = attempts.agg(F.coalesce(F.max("attempt_id"), F.lit(0)).alias("m")).first().m  # one number
    taken = first_rows(executable(states, now, max_attempts), ["batch_id", "content_uid"], n).select("content_uid", "batch_id", "input_hash", (F.col("attempt_count") + 1).alias("attempt_count"), (F.lit(last) + F.col("claim_order")).alias("last_attempt_id"))
    news = taken.select("content_uid", "attempt_count", "last_attempt_id", F.lit("running").alias("status"), F.lit(worker).alias("lease_owner"), lease_until.alias("lease_expires_at"), now.alias("updated_at"))
    values = {"attempt_id": F.col("last_attempt_id"), "attempt_number": F.col("attempt_count"), "run_id": F.lit(run["run_id"]), "provider": F.lit(run["provider"]), "model": F.lit(run["model"]), "started_at": now, "outcome": F.lit("running")}
    kept = ("content_uid", "batch_id", "input_hash")
    opened = taken.select(*[(F.col(f.name) if f.name in kept else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in attempts.schema])
    return _changed(states, "content_uid", news), attempts.unionByName(opened)


def complete(states: DataFrame, attempts: DataFrame, results: DataFrame, now: Column, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """Attempts end: successes bring their output, failures can be tried again while attempts are left.

    ``results``: attempt_id, worker_id, succeeded, retryable, translated_text,
    output_hash, error_code, error_message and the three token counts. Only the
    worker that holds the lease may end the current attempt of a running row.
    """
    if max_attempts <= 0:
        raise ValueError("max_attempts must be positive")
    own = attempts.select("attempt_id", "run_id", "content_uid")
    held = states.select("content_uid", "status", "lease_owner", "last_attempt_id", "attempt_count")
    met = results.join(own, "attempt_id", "left").join(held, "content_uid", "left")
    _deny(
        met,
        {
            "unknown attempt": F.col("run_id").isNull(),
            "ContentUid is not running:": F.coalesce(F.col("status"), F.lit("")) != "running",
            "worker does not own lease for": ~F.col("lease_owner").eqNullSafe(F.col("worker_id")),
            "attempt is not current for": ~F.col("last_attempt_id").eqNullSafe(F.col("attempt_id")),
            "negative token usage for": F.least(*[F.coalesce(c, F.lit(0)) for c in USAGE]) < 0,
        },
    )
    retry = F.col("retryable") & (F.col("attempt_count") < max_attempts)
    after = F.when(F.col("succeeded"), "succeeded").when(retry, "failed-retryable").otherwise("failed-final")
    ended = met.select("attempt_id", now.alias("finished_at"), after.alias("outcome"), *[F.when(~F.col("succeeded"), F.col(c)).alias(c) for c in ("error_code", "error_message")], F.when(F.col("succeeded"), F.col("output_hash")).alias("output_hash"), *USAGE)
    free = [_none().alias("lease_owner"), _none("timestamp").alias("lease_expires_at"), now.alias("updated_at")]
    good = met.where("succeeded").select("content_uid", after.alias("status"), "translated_text", "output_hash", F.col("run_id").alias("last_successful_run_id"), *free)
    bad = met.where("NOT succeeded").select("content_uid", after.alias("status"), *free)
    return _changed(_changed(states, "content_uid", good), "content_uid", bad), _changed(attempts, "attempt_id", ended)


def expire(states: DataFrame, attempts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Running rows whose lease is over can be tried again; their attempts are abandoned."""
    late = states.where((F.col("status") == "running") & (F.col("lease_expires_at") <= now)).select("content_uid", F.col("last_attempt_id").alias("attempt_id"))
    free = late.select("content_uid", F.lit("failed-retryable").alias("status"), _none().alias("lease_owner"), _none("timestamp").alias("lease_expires_at"), now.alias("updated_at"))
    running = late.join(attempts.where("outcome = 'running'").select("attempt_id"), "attempt_id", "left_semi")
    ended = running.select("attempt_id", now.alias("finished_at"), F.lit("abandoned").alias("outcome"), F.lit("LEASE_EXPIRED").alias("error_code"), F.lit("Worker lease expired before terminal result").alias("error_message"))
    return _changed(states, "content_uid", free), _changed(attempts, "attempt_id", ended)


def reopen(states: DataFrame, keys: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """Succeeded rows whose output was sent back lose it and can be tried again while attempts are left."""
    met = keys.select("content_uid").join(states.select("content_uid", F.lit(True).alias("_known"), "status", "attempt_count", "translated_text", "output_hash"), "content_uid", "left")
    _deny(
        met,
        {
            "unknown ContentUid:": F.col("_known").isNull(),
            "ContentUid is not succeeded:": F.coalesce(F.col("status"), F.lit("")) != "succeeded",
            "ContentUid has no completed translation output:": F.col("translated_text").isNull() | (F.coalesce(F.col("output_hash"), F.lit("")) == ""),
        },
    )
    after = F.when(F.col("attempt_count") < max_attempts, "failed-retryable").otherwise("failed-final")
    return _changed(states, "content_uid", met.select("content_uid", after.alias("status"), _none().alias("translated_text"), _none().alias("output_hash"), _none().alias("lease_owner"), _none("timestamp").alias("lease_expires_at"), now.alias("updated_at")))


def run_status(states: DataFrame) -> str:
    """What a run that ends now is: incomplete while a row is pending, running or to be tried again, else completed."""
    left = states.where(F.col("status").isin("pending", "running", "failed-retryable")).limit(1)
    return "completed" if left.isEmpty() else "incomplete"
