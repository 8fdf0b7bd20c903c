"""Validation of returned material against its immutable baseline: codes, acceptance, coverage, status and exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKUP, canonical_cell, markup_faults, multiset_minus, protected_tokens
from .sets import require_unique

#: Statuses (in lower case) that mean an empty text is meant, more context is wanted, or someone must decide.
EMPTY = ("intentionally-empty", "empty", "not-applicable", "skip")
CONTEXT = ("needs-more-context", "needs_more_context", "more-context")
ESCALATE = ("escalate", "escalated")
#: Codes with severity and label.
CODES = {
    "VAL001": ("error", "UNKNOWN_CONTENT_UID"),
    "VAL002": ("error", "DUPLICATE_CONTENT_UID"),
    "VAL003": ("error", "SOURCE_TEXT_MODIFIED"),
    "VAL004": ("error", "SOURCE_VERSION_MODIFIED"),
    "VAL005": ("error", "LOCALE_ROLE_MODIFIED"),
    "VAL006": ("error", "PROTECTED_TOKEN_MISSING"),
    "VAL007": ("error", "PROTECTED_TOKEN_ADDED"),
    "VAL008": ("error", "MARKUP_INVALID"),
    "VAL009": ("error", "REQUIRED_TARGET_EMPTY"),
    "VAL010": ("error", "BLIND_FIRST_COVERAGE_INCOMPLETE"),
    "VAL011": ("error", "UNEXPECTED_EDITED_FIELD"),
    "VAL102": ("warning", "STATUS_NEEDS_MORE_CONTEXT"),
    "VAL103": ("warning", "STATUS_ESCALATE"),
}
#: Columns that must come back as they went out, by code.
FIXED = {
    "SourceText": "VAL003",
    "SourceVersion": "VAL004",
    "SourceLocale": "VAL005",
    "TargetLocale": "VAL005",
    "PresenceStatus": "VAL011",
    "TranslationRequired": "VAL011",
    "ExistingTargetText": "VAL011",
    "TargetVersion": "VAL011",
    "ProtectedTokens": "VAL011",
}
#: Exit code and key by the gravest codes found, in this order.
EXITS = [
    (("VAL001", "VAL002"), 33, "IDENTITY_VALIDATION_FAILED"),
    (("VAL003", "VAL004", "VAL005", "VAL011"), 34, "IMMUTABLE_FIELD_VALIDATION_FAILED"),
    (("VAL006", "VAL007", "VAL008"), 35, "PROTECTED_TOKEN_VALIDATION_FAILED"),
    (("VAL009", "VAL010"), 36, "COVERAGE_VALIDATION_FAILED"),
]


def _cell(column: Column, kind: str) -> Column:
    """A cell as text: arrays as compact JSON, which is how a delivery shows them."""
    return canonical_cell(F.to_json(column) if kind.startswith("array") else column)


def check(rows: DataFrame, baseline: DataFrame, mode: str, visible: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``errors`` and ``warnings`` (codes, sorted), ``required`` and ``accepted``.

    ``baseline``: ContentUid and columns of FIXED; ProtectedTokens is an array. A row
    of an unknown uid or one that came before (by ``order``) is tested no further.
    Columns outside ``visible`` must be empty. Null cells are empty texts.
    """
    require_unique(baseline, "ContentUid")
    kinds, returned = dict(baseline.dtypes), dict(rows.dtypes)
    fixed = [c for c in FIXED if c in kinds and c in returned]
    held = F.struct(*[F.col(c) for c in kinds if c != "ContentUid"])
    uid = F.trim(F.coalesce("ContentUid", F.lit("")))
    own = rows.withColumn("_uid", uid)
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_uid").orderBy(*order)))
    met = own.join(baseline.select(F.col("ContentUid").alias("_uid"), held.alias("_b")), "_uid", "left")
    b = F.col("_b")
    known = b.isNotNull() & (F.col("_uid") != "")
    first = known & (F.col("_n") == 1)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in returned else F.lit("")
    candidate, status = text("IndependentTargetText" if mode == "blind-first" else "TranslatedTargetText"), F.lower(text("TranslationStatus"))
    required = F.coalesce(b["TranslationRequired"].cast("boolean"), F.lit(False))
    wanted, got = F.coalesce(b["ProtectedTokens"], F.array().cast("array<string>")), protected_tokens(candidate)
    broken = markup_faults(candidate, MARKUP)
    tag = rf"(?i)<\s*/?\s*{MARKUP}\b[^>]*>"
    enveloped = lambda t: t.rlike(tag) & ~markup_faults(t, MARKUP)
    removed = (b["PresenceStatus"] == "source-only") & enveloped(F.coalesce(b["SourceText"], F.lit(""))) & ~enveloped(candidate)
    foreign = [c for c in returned if c not in visible and c not in FIXED and not c.startswith("__") and c != "ContentUid" and c not in order]
    tests = [
        ("VAL001", ~known),
        ("VAL002", known & ~first),
        *[(code, first & (_cell(F.col(c), returned[c]) != _cell(b[c], kinds[c]))) for c, code in FIXED.items() if c in fixed],
        *[("VAL011", first & (canonical_cell(F.col(c)) != "")) for c in foreign],
        ("VAL006", first & (candidate != "") & (F.size(multiset_minus(wanted, got)) > 0)),
        ("VAL007", first & (candidate != "") & (F.size(multiset_minus(got, wanted)) > 0)),
        ("VAL008", first & (candidate != "") & (broken | removed)),
        ("VAL009", first & (candidate == "") & required & (status != "") & ~status.isin(*EMPTY)),
    ]
    found = lambda some: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in some]))))
    out = met.withColumn("errors", found(tests)).withColumn("warnings", found([("VAL102", first & status.isin(*CONTEXT)), ("VAL103", first & status.isin(*ESCALATE))]))
    takes = (candidate != "") | (status.isin(*EMPTY) & required)
    return out.withColumn("required", first & required & (status != "")).withColumn("accepted", (F.size("errors") == 0) & takes).drop("_uid", "_n", "_b")


def uncovered(checked: DataFrame, baseline: DataFrame) -> DataFrame:
    """ContentUid, code VAL010: rows of a blind delivery that need a text and got no status."""
    needs = baseline.where(F.col("TranslationRequired").cast("boolean")).select("ContentUid")
    return needs.join(checked.where("required").select(F.trim("ContentUid").alias("ContentUid")), "ContentUid", "left_anti").withColumn("code", F.lit("VAL010"))


def summary(checked: DataFrame, baseline: DataFrame, mode: str, strict: bool = False) -> DataFrame:
    """One row: counts of rows, errors and warnings, coverage of a blind delivery, status and exit code with its key."""
    lacking = uncovered(checked, baseline).agg(F.count(F.lit(1)).alias("_lacking")) if mode == "blind-first" else checked.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_lacking"))
    groups = [F.bool_or(F.arrays_overlap("errors", F.array(*[F.lit(c) for c in codes]))).alias(f"_x{i}") for i, (codes, _, _) in enumerate(EXITS)]
    come = F.trim(F.coalesce("ContentUid", F.lit("")))
    sound = ~F.array_contains("errors", "VAL001")
    rows = checked.agg(F.count(F.lit(1)).alias("n_returned"), F.count_if("accepted").alias("n_accepted"), F.count_if(F.size("errors") > 0).alias("n_rejected"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("_errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("n_warnings"), F.count_distinct(F.when(sound, come)).alias("_came"), *groups)
    base = baseline.agg(F.count(F.lit(1)).alias("n_baseline"), F.count_if(F.col("TranslationRequired").cast("boolean")).alias("_needed"))
    one = rows.join(F.broadcast(base), F.lit(True)).join(F.broadcast(lacking), F.lit(True))  # each a single row
    n_errors = F.col("_errors") + F.col("_lacking")
    coverage = F.when(F.lit(mode != "blind-first"), F.lit(None).cast("double")).when(F.col("_needed") == 0, 1.0).otherwise((F.col("_needed") - F.col("_lacking")) / F.col("_needed"))
    status = F.when(n_errors == 0, "pass").when(F.lit(strict) | (F.col("n_accepted") == 0), "fail").otherwise("partial")
    code, key = F.when(n_errors == 0, 0), F.when(n_errors == 0, "")
    for i, (_, number, name) in enumerate(EXITS[:-1]):
        code, key = code.when(F.col(f"_x{i}"), number), key.when(F.col(f"_x{i}"), name)
    return one.select("n_returned", "n_baseline", "n_accepted", "n_rejected", n_errors.alias("n_errors"), "n_warnings", (F.col("n_baseline") - F.col("_came")).alias("n_missing"), coverage.alias("coverage"), status.alias("status"), code.otherwise(EXITS[-1][1]).alias("exit_code"), key.otherwise(EXITS[-1][2]).alias("exit_key"))
