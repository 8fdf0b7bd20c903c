"""Quality results as tables: what is checked next, what is recorded, and how sent-back outputs are archived and reopened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import transitions


def due(states: DataFrame, results: DataFrame, ruleset: str, n: int | None = None) -> DataFrame:
    """Succeeded rows whose output these rules have not judged yet; the first n by uid where n is given."""
    if n is not None and n <= 0:
        raise ValueError("the number of items must be positive")
    current = results.where(F.col("qa_rule_set_version") == ruleset).select("content_uid", F.col("output_hash").alias("_judged"))
    done = states.select("content_uid", "output_hash").join(current, "content_uid").where("output_hash = _judged").select("content_uid")
    left = states.where("status = 'succeeded'").join(done, "content_uid", "left_anti")
    return left if n is None else left.orderBy("content_uid").limit(n)


def _with_output(states: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with their row's output; rows that are unknown or have none are an error."""
    own = states.select("content_uid", F.lit(True).alias("_known"), "translated_text", F.col("output_hash").alias("_hash"))
    met = keys.join(own, "content_uid", "left")
    transitions._deny(
        met,
        {
            "unknown ContentUid:": F.col("_known").isNull(),
            "ContentUid has no completed translation output:": F.col("translated_text").isNull() | (F.coalesce(F.col("_hash"), F.lit("")) == ""),
        },
    )
    return met.drop("_known")


def record(results: DataFrame, issues: DataFrame, states: DataFrame, judged: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The result and issue tables after ``judged``: its keys' results are replaced, and all their issues.

    ``judged``: content_uid, route, qa_rule_set_version, qa_input_hash, issues (array
    of struct<issue_code, severity, action, message, details>).
    """
    news = _with_output(states, judged)
    rows = news.select("content_uid", "route", "qa_rule_set_version", "qa_input_hash", F.col("_hash").alias("output_hash"), now.alias("checked_at"))
    listed = news.select("content_uid", F.posexplode("issues").alias("ordinal", "i")).select("content_uid", "ordinal", *[F.col(f"i.{c}").alias(c) for c in ("issue_code", "severity", "action", "message")], F.to_json("i.details").alias("details_json"))
    kept = lambda table: table.join(judged.select("content_uid"), "content_uid", "left_anti")
    return kept(results).unionByName(rows), kept(issues).unionByName(listed)


def send_back(states: DataFrame, results: DataFrame, archive: DataFrame, judged: DataFrame, now: Column, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """The state table and the archive after outputs are sent back: each is kept in the archive, then its row is reopened.

    Only recorded results of the current output with route RETRY can be sent back.
    """
    stored = results.select("content_uid", F.lit(True).alias("_stored"), F.col("qa_input_hash").alias("_input"), F.col("output_hash").alias("_output"))
    met = _with_output(states, judged).join(stored, "content_uid", "left")
    transitions._deny(
        met,
        {
            "QA handoff requires a RETRY result:": F.col("route") != "RETRY",
            "QA result is not persisted:": F.col("_stored").isNull(),
            "QA result hash mismatch:": F.col("_input") != F.col("qa_input_hash"),
            "QA result is stale:": F.col("_output") != F.col("_hash"),
        },
    )
    rows = met.select("content_uid", "translated_text", F.col("_hash").alias("output_hash"), "qa_rule_set_version", "qa_input_hash", "route", F.to_json("issues").alias("issues_json"), now.alias("rejected_at"))
    return transitions.reopen(states, judged.select("content_uid"), now, max_attempts), archive.unionByName(rows)
