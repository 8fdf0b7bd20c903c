"""The five review protocols: candidates that may go out, surfaces that came back, and their codes.

A surface is a table of returned rows with ``__row__``, their number in the file; a
manifest has a row for each candidate that went out. Findings are rows: code, record,
row_number, message. Repeats are found by aggregates of row numbers, so a much repeated id
is no hot window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Decisions by protocol, and the columns of a second pass, which a first one must not show.
REVIEW = ("Pending", "Approved", "NeedsRevision", "InsufficientEvidence", "NotApplicable")
USAGE = ("Pending", "AcceptAsIs", "Revise", "NotApplicable", "NeedsContext")
SECOND_PASS = ("OfficialTarget", "ReferenceComparison", "ApprovedAuthority", "FinalDecision", "FinalText")


@dataclass(frozen=True)
class Protocol:
    """``immutable`` columns map to the code of their change; ``needed`` codes to columns of which none may be empty."""

    prefix: str
    immutable: dict[str, str]
    needed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    roles: tuple[str, ...] = ()
    decisions: tuple[str, ...] = REVIEW
    forbidden: tuple[str, ...] = SECOND_PASS
    full: bool = True  # the long form, with authorities and comparisons


def _columns(code: str, *names: str, **others: tuple[str, ...]) -> dict[str, str]:
    """Each column's code: ``code``, or the one whose columns it is among."""
    return {n: next((c for c, of in others.items() if n in of), code) for n in names}


#: Columns and codes of the protocols.
BARK = Protocol("BRK", _columns("BRK011", "CandidateId", "ContentUid", "EnglishText", "SpeakerMode", "SpeakerCount", "Speakers", "SpeakerEvidence", "SharedGroupId", "PakName", "InternalPath", "NodeId", "EntityIdentity", "EvidenceRule", "ContextSummary", "ProtectedTokens"), {"BRK005": ("EvidenceRule", "InternalPath", "SpeakerEvidence")})
QUEST = Protocol("QST", _columns("QST011", "CandidateId", "ContentUid", "EnglishText", "QuestRole", "OccurrenceCount", "Occurrences", "ContextSummary", "ProtectedTokens", QST009=("OccurrenceCount", "Occurrences", "QuestRole")), {"QST009": ("Occurrences",)}, ("QuestTitle", "QuestDescription"))
UI_SKILL = Protocol("UIS", _columns("UIS011", "CandidateId", "ContentUid", "EnglishText", "Workstreams", "Domains", "RelationCount", "Relations", "ContextSummary", "ProtectedTokens", UIS009=("RelationCount", "Relations", "Workstreams", "Domains")), {"UIS005": ("Relations",)})
MULTILINGUAL = Protocol("MUL", _columns("MUL003", "CandidateId", "ContentUid", "EnglishText", "ExactReuseClass", "ReusableTargetOccurrenceCount", "ReusableTargetDistinctCount", "SameUidReferenceLocales", "ProtectedTokens"), forbidden=("ExactReuseCandidates", "ReferenceComparison", "ApprovedAuthority", "FinalDecision", "FinalText"), full=False)
TAIWAN_USAGE = Protocol("TWU", _columns("TWU003", "CandidateId", "ContentUid", "SourceText", "TargetText", "FindingCount", "Findings", "ProtectedTokens"), decisions=USAGE, forbidden=(), full=False)

_FINDING = "code string, record string, row_number bigint, message string"
_SHARED = ("SpeakerCount", "Speakers", "SharedGroupId")


def _cell(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _drift(tokens: Column, text: Column, tags_in_order: bool) -> Column:
    """Whether ``text`` lacks or adds tokens, or its tags are badly written or, where asked, not those of ``tokens`` in order."""
    required = F.coalesce(F.from_json(tokens, "array<string>"), F.array().cast("array<string>"))
    is_tag = lambda t: t.startswith("<LSTag") | (t == "</LSTag>")
    exact, found = (F.filter(required, lambda t: ~is_tag(t)) if tags_in_order else required), T.protected_tokens(text)
    drift = (F.size(T.multiset_minus(exact, found)) > 0) | (F.size(T.multiset_minus(found, exact)) > 0) | T.markup_faults(text, T.MARKUP)
    return drift | (F.to_json(F.filter(required, is_tag)) != F.to_json(T.markup_tokens(text, T.MARKUP))) if tags_in_order else drift


def check(returned: DataFrame, manifest: DataFrame, protocol: Protocol, authorities: tuple[str, ...] = (), comparisons: DataFrame | None = None) -> DataFrame:
    """code, record, row_number, message: everything that is wrong with a returned surface.

    ``comparisons``: CandidateId, label, sha256, present: what a second pass was shown, for
    protocols in full. A row that is not in the manifest is compared no further.
    """
    p, spark = protocol.prefix, returned.sparkSession
    second = "FinalText" in returned.columns
    code = lambda n: f"{p}{n:03d}"
    known = manifest.select(*[_cell(c).alias(f"_{c}") for c in protocol.immutable], *[F.lit(True).alias("_known")])
    firsts = [returned.groupBy(_cell(c).alias(f"{c}_")).agg(F.min("__row__").alias(f"_first_{c}")) for c in (("CandidateId", "ContentUid") if protocol.full else ("CandidateId",))]
    rows = returned.join(known, _cell("CandidateId") == F.col("_CandidateId"), "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    for first in firsts:
        rows = rows.join(first, _cell(first.columns[0][:-1]) == F.col(first.columns[0]), "left")
    inside = F.col("_known")
    tests: list[tuple[Column, str, Column]] = []
    say = lambda when, which, *message: tests.append((when, which, F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])))
    say(F.col("__row__") > F.col("_first_CandidateId"), code(1) if protocol.full else code(2), "duplicate CandidateId")
    if protocol.full:
        say(F.col("__row__") > F.col("_first_ContentUid"), code(2), "duplicate ContentUid")
        say(_cell("ContentUid") == "", code(3), "missing ContentUid")
        say(_cell("EnglishText") == "", code(4), "missing English source")
        for which, columns in protocol.needed.items():
            say(F.least(*[F.length(_cell(c)) for c in columns], F.lit(1 << 30)) == 0, which, "missing evidence")
        if protocol.roles:
            say(~_cell("QuestRole").isin(*protocol.roles), code(5), "invalid QuestRole: ", _cell("QuestRole"))
    say(~inside, code(11) if protocol.full else code(1), "CandidateId is not present in the package manifest")
    for column, which in protocol.immutable.items():
        changed = inside & (_cell(column) != F.col(f"_{column}"))
        if p == "BRK" and column in _SHARED:
            shared = F.col("_SpeakerMode") == "SharedSpeaker"
            say(changed & shared, "BRK009", f"immutable {column} changed")
            changed = changed & ~shared
        say(changed, which, f"immutable {column} changed")
    judged = F.lit(True) if protocol.full else inside
    decided = ["FinalDecision"] if second and not protocol.full else ["ReviewerDecision", *["FinalDecision"] * second]
    for column in decided:
        say(judged & ~_cell(column).isin(*protocol.decisions), code(7) if protocol.full else code(4), f"invalid {column}: ", _cell(column))
    text = "FinalText" if second else "ProposedText" if p == "TWU" else "DraftText"
    drift = inside & (_cell(text) != "") & _drift(F.col("_ProtectedTokens"), _cell(text), protocol.full)
    say(drift, {"MUL": "MUL005", "TWU": "TWU006"}.get(p, code(12)), "protected-token drift")
    if p == "TWU":
        say(inside & (_cell("ReviewerDecision") == "Revise") & (_cell(text) == ""), "TWU005", "Revise decision requires ProposedText")
    if protocol.full:
        say(~_cell("EvidenceSufficient").isin("", "true", "false", "TRUE", "FALSE"), code(8), "EvidenceSufficient must be true, false, or blank")
        if "ApprovedAuthority" in returned.columns:
            say((_cell("ApprovedAuthority") != "") & ~_cell("ApprovedAuthority").isin(*authorities), code(10), "invalid ApprovedAuthority: ", _cell("ApprovedAuthority"))
    if second and protocol.full:
        references = F.from_json(F.when(_cell("ReferenceComparison") == "", "{}").otherwise(_cell("ReferenceComparison")), "map<string,string>")
        say(inside & references.isNull(), code(14), "invalid ReferenceComparison JSON")
        taken = inside & _cell("ApprovedAuthority").isin(*authorities) if authorities else F.lit(False)
        say(taken & (_cell("FinalDecision") == "Pending"), code(10), "ApprovedAuthority cannot be recorded while FinalDecision is Pending")
        if comparisons is not None:
            shown = comparisons.groupBy(F.col("CandidateId").alias("_shown")).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("sha256", "present")))).alias("_evidence"))
            rows = rows.join(shown, _cell("CandidateId") == F.col("_shown"), "left")
            said = lambda label: F.when(label.startswith("OfficialTarget:"), _cell("OfficialTarget")).otherwise(F.coalesce(references[F.substring_index(label, "ReferenceLocale:", -1)], F.lit("")))
            labels = F.coalesce(F.map_keys("_evidence"), F.array().cast("array<string>"))
            changed = F.filter(labels, lambda k: F.sha2(said(k), 256) != F.col("_evidence")[k]["sha256"])
            say(inside & (F.size(changed) > 0), code(14), "comparison evidence changed: ", F.array_join(F.array_sort(changed), ", "))
            say(taken & ~F.coalesce(F.col("_evidence")[_cell("ApprovedAuthority")]["present"], F.lit(False)), code(10), "ApprovedAuthority has no evidence for this candidate: ", _cell("ApprovedAuthority"))
    record = F.when(_cell("CandidateId") != "", _cell("CandidateId")).otherwise(F.concat(F.lit("row "), F.col("__row__").cast("string")))
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(which).alias("code"), m.alias("message"))) for c, which, m in tests]))
    listed = rows.select(record.alias("record"), F.col("__row__").cast("bigint").alias("row_number"), F.inline(found)).select("code", "record", "row_number", "message")
    absent = manifest.select(_cell("CandidateId").alias("record")).join(returned.select(_cell("CandidateId").alias("record")), "record", "left_anti").select(F.lit(code(13) if protocol.full else code(7)).alias("code"), "record", F.lit(None).cast("bigint").alias("row_number"), F.lit("candidate missing from review input").alias("message"))
    out = listed.unionByName(absent)
    leaks = [] if second else sorted(set(returned.columns) & set(protocol.forbidden))
    return out.unionByName(spark.createDataFrame([(code(6), "<header>", None, f"Pass 1 leakage column: {c}") for c in leaks], _FINDING)) if leaks else out


def statuses(returned: DataFrame, findings: DataFrame) -> DataFrame:
    """``returned`` with ``validation_status``: Failed for a row that has a finding, else Passed."""
    bad = findings.where("row_number IS NOT NULL").select(F.col("row_number").alias("_bad")).distinct()
    return returned.join(bad, F.col("__row__") == F.col("_bad"), "left").withColumn("validation_status", F.when(F.col("_bad").isNull(), "Passed").otherwise("Failed")).drop("_bad")


def prepared(candidates: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``candidates`` (candidate_id, content_uid, english_text and more), or an error: a repeated id or uid, no uid, no source, or one of the protocol's own ``tests``."""
    for column, name in (("candidate_id", "CandidateId"), ("content_uid", "ContentUid")):
        twice = candidates.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"duplicate {name}: {twice[0][0]}")
    every = {"missing ContentUid": F.coalesce("content_uid", F.lit("")) == "", "missing English source": F.coalesce("english_text", F.lit("")) == "", **tests}
    fault = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.concat(F.col("candidate_id"), F.lit(f": {m}"))) for m, c in every.items()])
    first = candidates.select(fault.alias("fault")).where("fault IS NOT NULL").limit(1).collect()
    if first:
        raise ValueError(first[0].fault)
    return candidates


def bark_tests() -> dict[str, Column]:
    """What bark candidates must have besides: provenance of their evidence and speakers, and at least two speakers where they are shared."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    e = F.col("evidence")
    return {
        "missing evidence provenance": empty(e["rule"]) | empty(e["internal_path"]) | empty(e["node_id"]) | empty(e["entity_identity"]),
        "incomplete speaker provenance": F.exists(F.col("speakers"), lambda s: empty(s["identity"]) | empty(s["provenance"])),
        "SharedSpeaker membership is incomplete": (F.col("speaker_mode") == "SharedSpeaker") & ((F.col("speaker_count") < 2) | empty(F.col("shared_group_id"))),
    }


# Gates and resolutions ---------------------------------------------------------------------------

#: What keeps a corpus from being finished, in the order of a report.
BLOCKING = ("WAITING_TRANSLATION", "WAITING_RETRY", "WAITING_REVIEW", "BLOCKED")


def merge_ready(view: DataFrame) -> DataFrame:
    """Rows of a completion view that can be merged."""
    return view.where("disposition = 'MERGE_READY'")


def unresolved(view: DataFrame) -> DataFrame:
    """The others."""
    return view.where("disposition IS NULL OR disposition <> 'MERGE_READY'")


def completion_gate(view: DataFrame) -> DataFrame:
    """``view``, or an error that says how many rows of each kind are in the way; an empty view is ready."""
    total, ready, *blocked = view.agg(F.count(F.lit(1)), F.count_if(F.col("disposition") == "MERGE_READY"), *[F.count_if(F.col("disposition") == b) for b in BLOCKING]).first()  # one row
    if any(blocked) or ready != total:
        raise ValueError("finalize blocked by completion gate: " + ", ".join([f"MERGE_READY={ready}", *(f"{b}={n}" for b, n in zip(BLOCKING, blocked, strict=True))]))
    return view


def export(results: DataFrame, states: DataFrame, material: DataFrame, ruleset: str) -> DataFrame:
    """What goes to review: current results with route REVIEW, their output and their source; a row without a succeeded state or without material is an error.

    ``results``: content_uid, route, qa_rule_set_version, qa_input_hash, output_hash, issues.
    """
    from .transitions import _deny

    s = states.where("status = 'succeeded'").select("content_uid", "batch_id", "translated_text", F.col("output_hash").alias("_now"), F.lit(True).alias("_done"))
    m = material.select("content_uid", "batch_id", F.col("source_text"), F.lit(True).alias("_has"))
    due = results.where((F.col("route") == "REVIEW") & (F.col("qa_rule_set_version") == ruleset)).join(s, "content_uid", "left").where(F.col("_done").isNull() | (F.col("output_hash") == F.col("_now")))
    met = due.join(m, ["content_uid", "batch_id"], "left")
    _deny(met, {"execution state not found:": F.col("_done").isNull(), "ContentUid missing from material:": F.col("_has").isNull()})
    blank = [F.lit("").alias(c) for c in ("Decision", "ResolvedText", "Reviewer", "Note")]
    return met.select(F.col("content_uid").alias("ContentUid"), F.coalesce("source_text", F.lit("")).alias("SourceText"), F.coalesce("translated_text", F.lit("")).alias("TranslatedText"), F.coalesce("_now", F.lit("")).alias("OutputHash"), F.col("qa_rule_set_version").alias("QaRuleSetVersion"), F.col("qa_input_hash").alias("QaInputHash"), F.col("issues").alias("Issues"), *blank)


def resolve(states: DataFrame, results: DataFrame, log: DataFrame, decisions: DataFrame, ruleset: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """States and log after ``decisions`` (content_uid, decision, reviewer, note, revised_text): all of them, or an error and nothing.

    ACCEPT keeps the output, REVISE replaces it. A decision holds for the current result of
    these rules, this input and this output; made again for the same, it is refused, as are
    two at once for one row.
    """
    from .transitions import _changed, _deny

    twice = decisions.groupBy("content_uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate review decision for current QA evidence: {twice[0].content_uid}")
    q = results.where(F.col("qa_rule_set_version") == ruleset).select("content_uid", "route", "qa_input_hash", F.col("output_hash").alias("_judged"), F.lit(True).alias("_qa"))
    s = states.select("content_uid", "status", "translated_text", F.col("output_hash").alias("_now"), F.lit(True).alias("_known"))
    met = decisions.join(q, "content_uid", "left").join(s, "content_uid", "left")
    made = log.where(F.col("qa_rule_set_version") == ruleset).select("content_uid", "decision", "qa_input_hash", F.col("base_output_hash").alias("_now"), F.lit(True).alias("_made")).distinct()
    met = met.join(made, ["content_uid", "decision", "qa_input_hash", "_now"], "left")
    accept, revise = F.col("decision") == "ACCEPT", F.col("decision") == "REVISE"
    _deny(
        met,
        {
            "unsupported review decision for": ~F.coalesce(accept | revise, F.lit(False)),
            "reviewer is required for": F.trim(F.coalesce("reviewer", F.lit(""))) == "",
            "REVISE requires revised_text:": revise & F.col("revised_text").isNull(),
            "ACCEPT must not include revised_text:": accept & F.col("revised_text").isNotNull(),
            "QA result not found:": F.col("_qa").isNull(),
            "QA route is not REVIEW for": F.coalesce(F.col("route") != "REVIEW", F.lit(True)),
            "unknown ContentUid:": F.col("_known").isNull(),
            "ContentUid is not succeeded:": F.coalesce(F.col("status") != "succeeded", F.lit(True)),
            "ContentUid has no completed output:": F.col("translated_text").isNull() | (F.coalesce("_now", F.lit("")) == ""),
            "QA result is stale:": ~F.col("_judged").eqNullSafe(F.col("_now")),
            "duplicate review decision for current QA evidence:": F.col("_made").isNotNull(),
        },
    )
    resolved = F.when(accept, F.col("_now")).otherwise(T.sha256("revised_text"))
    last = log.agg(F.coalesce(F.max("resolution_id"), F.lit(0)).alias("m")).first().m  # one number
    from .ordinals import with_ordinals

    rows = met.select("content_uid", "decision", F.lit(ruleset).alias("qa_rule_set_version"), "qa_input_hash", F.col("_now").alias("base_output_hash"), resolved.alias("resolved_output_hash"), F.trim("reviewer").alias("reviewer"), "note", now.alias("resolved_at"))
    numbered = with_ordinals(rows, ["content_uid"], "resolution_id", first=last + 1).withColumn("resolution_id", F.col("resolution_id").cast(log.schema["resolution_id"].dataType))
    revised = met.where(revise).select("content_uid", F.col("revised_text").alias("translated_text"), resolved.alias("output_hash"), now.alias("updated_at"))
    return _changed(states, "content_uid", revised), log.unionByName(numbered)
