"""Material for translators: projections by mode, evidence flags, leak guard, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, protected_tokens
from .matches import terms_in

#: Columns that every mode shows, and those that a translator fills in.
COMMON = ("ContentUid", "SourceLocale", "SourceText", "TargetLocale", "SourceVersion", "PresenceStatus", "TranslationRequired", "ProtectedTokens")
MODES = ("basic", "context", "blind-first")
TEXT = {"blind-first": "IndependentTargetText"}
EDITABLE = ("TranslationStatus", "TranslatorNotes", "TranslatorName")
#: Names that a blind delivery must not carry.
FORBIDDEN = {"ExistingTargetText", "TargetVersion", "ReferenceTexts", "References", "ComparisonText", "targetText", "referenceText"}


def contract(mode: str, references: list[str] = ()) -> tuple[list[str], list[str]]:
    """All columns of a mode in order, and the editable ones. A blind delivery shows no target and no reference locale."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    editable = [TEXT.get(mode, "TranslatedTargetText"), *EDITABLE]
    if mode == "blind-first":
        return [*COMMON, "Context", "GlossaryReference", *editable], editable
    shown = [*COMMON, "ExistingTargetText", "TargetVersion", *(f"ReferenceText[{x}]" for x in references)]
    return [*shown, *(["Context"] if mode == "context" else []), *editable], editable


def material(records: DataFrame, mode: str, source: str, target: str, references: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Delivered rows and their immutable counterparts.

    ``records``: ContentUid, locales (map from locale to struct<text, version>) and, where there is any, Context (text).
    """
    shown, editable = contract(mode, references)
    src, tgt = F.col("locales")[source], F.col("locales")[target]
    context = F.coalesce(F.col("Context"), F.lit("")) if "Context" in records.columns else F.lit("")
    text = lambda x: F.coalesce(x["text"], F.lit(""))
    presence = F.when(src.isNotNull() & tgt.isNotNull(), "source+target").when(src.isNotNull(), "source-only").otherwise("target-only")
    tokens = protected_tokens(text(src))
    # JSON without blanks, as to_json writes it; an array of no tokens is [].
    values = {
        "ContentUid": F.col("ContentUid"),
        "SourceLocale": F.lit(source),
        "SourceText": text(src),
        "TargetLocale": F.lit(target),
        "SourceVersion": src["version"],
        "PresenceStatus": presence,
        "TranslationRequired": src.isNotNull(),
        "ProtectedTokens": F.to_json(tokens),
        "ExistingTargetText": text(tgt),
        "TargetVersion": tgt["version"],
        "Context": context,
        "GlossaryReference": F.lit("support/glossary"),
        **{f"ReferenceText[{x}]": text(F.col("locales")[x]) for x in references},
        **{x: F.lit("") for x in editable},
    }
    delivered = records.select(*[values[c].alias(c) for c in shown])
    kept = [c for c in (*COMMON, "ExistingTargetText", "TargetVersion") if c != "ProtectedTokens"]
    held = records.select(*[values[c].alias(c) for c in kept], tokens.alias("ProtectedTokens"), F.map_from_arrays(F.array(*[F.lit(x) for x in references]).cast("array<string>"), F.array(*[F.col("locales")[x] for x in references])).alias("References") if references else F.lit(None).cast("map<string,string>").alias("References"), context.alias("Context"))
    return guard(delivered) if mode == "blind-first" else delivered, held


def guard(rows: DataFrame) -> DataFrame:
    """``rows``, or an error where a column, at any depth, would give a translation away."""

    def names(kind) -> set[str]:
        inner = set()
        for field in getattr(kind, "fields", ()):
            inner |= {field.name} | names(field.dataType)
        for part in ("elementType", "keyType", "valueType"):
            if hasattr(kind, part):
                inner |= names(getattr(kind, part))
        return inner

    if leaks := names(rows.schema) & FORBIDDEN:
        raise ValueError(f"a blind delivery with {', '.join(sorted(leaks))}")
    return rows


def scoped(records: DataFrame, scope: DataFrame | None, key: str = "ContentUid", shown: int = 10) -> DataFrame:
    """The records of a scope (its keys in a column of the same name), or all without one; a key of the scope without a record is an error that names the first few."""
    if scope is None:
        return records
    wanted = scope.select(key).distinct()
    missing = wanted.join(records.select(key), key, "left_anti")
    first = missing.orderBy(key).limit(shown + 1).collect()  # a few names for the message
    if first:
        names = ", ".join(str(r[0]) for r in first[:shown])
        raise ValueError(f"scope has keys without a record: {names}{', ...' if len(first) > shown else ''}")
    return records.join(wanted, key, "left_semi")


def evidence_flags(rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Rows with the sorted kinds of their evidence and one summary of its texts."""
    flat = evidence.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("evidence_flags"), F.array_join(F.array_sort(F.collect_set("summary")), " | ").alias("context_summary"))
    return rows.join(flat, key, "left").withColumn("evidence_flags", F.coalesce("evidence_flags", F.lit(""))).withColumn("context_summary", F.coalesce("context_summary", F.lit("")))


def buckets(mapping_type: Column, classification: Column) -> Column:
    """The sidecar file that a mapping goes to: context, bark, quest, ui-skill or multilingual."""
    kind, cls = F.lower(F.coalesce(mapping_type, F.lit(""))), F.lower(F.coalesce(classification, F.lit("")))
    return (
        F.when(kind.contains("multilingual") | cls.contains("exactreuse"), "multilingual")
        .when(kind.contains("bark") | cls.contains("speaker"), "bark")
        .when(kind.contains("quest") | cls.startswith("quest"), "quest")
        .when(kind.contains("ui-skill") | cls.contains("ability") | cls.contains("item") | cls.contains("userinterface") | cls.contains("tutorial"), "ui-skill")
        .otherwise("context")
    )


def prompts(rows: DataFrame, rules: DataFrame, glossary: DataFrame, category: str, text: str) -> DataFrame:
    """Rows with ``prompt``: the category's rules, the glossary entries whose source occurs in the text in order, the tokens to keep, the text.

    ``rules``: category, rules array; ``glossary``: source, target, found by one walk over
    a text for all entries. A category without rules is an error when it is reached.
    """
    r = rules.select(F.col("category").alias("_c"), F.array_join("rules", "\n").alias("_rules"))
    joined = terms_in(text, glossary, rows.join(r, F.col(category) == F.col("_c"), "left"), "_used")
    used = F.transform("_used", lambda t: F.concat(t["source"], F.lit(" = "), t["target"]))
    body = F.concat_ws("\n", F.coalesce("_rules", F.raise_error(F.concat(F.lit("no rules for category "), F.col(category)))), F.array_join(used, "\n"), F.array_join(protected_tokens(F.col(text)), " "), F.col(text))
    return joined.withColumn("prompt", body).withColumn("prompt_hash", fingerprint({"prompt": F.col("prompt")})).drop("_c", "_rules", "_used")
