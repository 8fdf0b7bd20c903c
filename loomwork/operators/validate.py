"""Validation of returned rows against an immutable baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_cell


def findings(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """key, code, severity: one row for each rule (code, severity, failing condition) that a row fails."""
    failed = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]))
    return rows.select(key, F.inline(failed))


def mark_repeats(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with whether a row repeats a key that came before."""
    return rows.withColumn("is_repeat", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def against(rows: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Returned rows with the baseline's columns beside theirs as ``base_*`` and ``in_baseline``."""
    b = baseline.select(key, *[F.col(c).alias(f"base_{c}") for c in columns], F.lit(True).alias("in_baseline"))
    return rows.join(b, key, "left").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))


def immutable_diff(rows: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, expected, returned for each immutable cell that changed, compared as canonical text."""
    both = against(rows, baseline, key, columns).where("in_baseline")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), canonical_cell(F.col(f"base_{c}")).alias("expected"), canonical_cell(F.col(c)).alias("returned")) for c in columns])
    return both.select(key, F.inline(F.filter(cells, lambda x: x["expected"] != x["returned"])))


def missing(rows: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Baseline keys that did not come back."""
    return baseline.select(key).join(rows.select(key), key, "left_anti")
