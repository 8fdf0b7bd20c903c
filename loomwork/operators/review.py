"""Human review: candidates, blind and comparing surfaces, and checks of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidate_id, multiset_minus, protected_tokens, sha256
from .validate import mark_repeats

#: Decisions of a review.
DECISIONS = ("Pending", "Approved", "NeedsRevision", "InsufficientEvidence", "NotApplicable")


def candidates(evidence: DataFrame, sources: DataFrame, prefix: str, key: str = "content_uid", keep_unsourced: bool = True) -> DataFrame:
    """One row per key with its candidate id and evidence ids in order; keys without a source text stay or go."""
    grouped = evidence.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.substring(sha256(F.col("evidence")), 1, 16))), ";").alias("evidence_ids"))
    texts = sources.select(key, F.col("text").alias("source_text"))
    return grouped.join(texts, key, "left" if keep_unsourced else "inner").withColumn("candidate_id", candidate_id(prefix, F.col(key)))


def surfaces(rows: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The first pass without the existing text, and the second with it and its hash."""
    first = rows.drop(target).withColumn("decision", F.lit("")).withColumn("revised_text", F.lit(""))
    second = rows.withColumn("comparison_sha256", sha256(F.col(target))).withColumn("decision", F.lit("")).withColumn("revised_text", F.lit(""))
    return first, second


def check_surface(returned: DataFrame, manifest: DataFrame, key: str = "candidate_id") -> DataFrame:
    """key, code for each fault: foreign, repeated, source changed, unknown decision, revision without text or without its tokens, missing."""
    base = manifest.select(key, F.col("source_text").alias("_source"), F.lit(True).alias("_known"))
    rows = mark_repeats(returned.join(base, key, "left"), key, ["decision", "revised_text"])
    revise = F.col("decision") == "NeedsRevision"
    missing_tokens = F.size(multiset_minus(protected_tokens(F.col("_source")), protected_tokens(F.col("revised_text")))) > 0
    tests = [
        ("FOREIGN", F.col("_known").isNull()),
        ("REPEATED", F.col("is_repeat")),
        ("SOURCE_CHANGED", F.col("_known") & ~F.col("source_text").eqNullSafe(F.col("_source"))),
        ("DECISION_UNKNOWN", ~F.coalesce(F.col("decision"), F.lit("")).isin(*DECISIONS)),
        ("REVISION_EMPTY", revise & (F.trim(F.coalesce("revised_text", F.lit(""))) == "")),
        ("TOKENS_MISSING", revise & (F.trim(F.coalesce("revised_text", F.lit(""))) != "") & missing_tokens),
    ]
    found = rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in tests]))).alias("code"))
    absent = manifest.select(key).join(returned.select(key), key, "left_anti").withColumn("code", F.lit("MISSING"))
    return found.unionByName(absent)


def accepted(log: DataFrame, current: DataFrame) -> DataFrame:
    """content_uid whose output was accepted as it is: for just these rules, this input and this output, before and after.

    Only ACCEPT counts: a revision makes another output, which is judged anew. Other decisions take no acceptance back.
    """
    accepting = log.where("decision = 'ACCEPT' AND base_output_hash = resolved_output_hash").select("content_uid", "qa_rule_set_version", "qa_input_hash", F.col("resolved_output_hash").alias("output_hash"))
    return current.join(accepting, ["content_uid", "qa_rule_set_version", "qa_input_hash", "output_hash"], "left_semi").select("content_uid")
