"""Review protocols, gates, export and resolutions, by truth tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomwork.operators import protocols as P


def frame(spark, rows):
    names = list(rows[0])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` {'long' if n == '__row__' else 'string'}" for n in names))


def base(p, i, **more):
    row = {c: f"{c}-{i}" for c in p.immutable} | {"CandidateId": f"C{i}", "ContentUid": f"h{i}", "ProtectedTokens": '["{x}","<LSTag>","</LSTag>"]' if p.full else '["{x}"]'}
    if "QuestRole" in row:
        row["QuestRole"] = "QuestTitle"
    if "SpeakerMode" in row:
        row["SpeakerMode"] = "SharedSpeaker" if i % 2 else "SingleSpeaker"
    return row | more


def codes(spark, p, rows, manifest, **more):
    return sorted((r.code, r.record) for r in P.check(frame(spark, rows), frame(spark, manifest), p, **more).collect())


@pytest.mark.parametrize("p", [P.BARK, P.QUEST, P.UI_SKILL], ids=lambda p: p.prefix)
def test_first_pass_in_full(spark, p):
    manifest = [base(p, i) for i in range(8)]
    blank = {"ReviewerDecision": "Pending", "EvidenceSufficient": "", "DraftText": ""}
    rows = [m | blank | {"__row__": i + 2} for i, m in enumerate(manifest[:7])]
    rows[0] |= {"DraftText": "ok {x} <LSTag Tooltip='a'>y</LSTag>", "ReviewerDecision": "Approved", "EvidenceSufficient": "TRUE"}
    rows[1] |= {"DraftText": "no token <LSTag>y</LSTag>"}
    rows[2] |= {"DraftText": "{x} tag gone", "EvidenceSufficient": "yes"}
    rows[3] |= {"ContextSummary": "changed", "ReviewerDecision": "Maybe"}
    rows[4] |= {"ContentUid": "", "EnglishText": None}
    rows.append(rows[5] | {"__row__": 50})
    rows.append(base(p, 99) | blank | {"__row__": 51})
    k = lambda n: f"{p.prefix}{n:03d}"
    want = [(k(12), "C1"), (k(12), "C2"), (k(8), "C2"), (k(11), "C3"), (k(7), "C3"), (k(3), "C4"), (k(4), "C4"), (k(11), "C4"), (k(11), "C4"), (k(1), "C5"), (k(2), "C5"), (k(11), "C99"), (k(13), "C7")]
    assert codes(spark, p, rows, manifest) == sorted(want)
    got = P.statuses(frame(spark, rows), P.check(frame(spark, rows), frame(spark, manifest), p))
    assert {r["__row__"]: r.validation_status for r in got.collect()} == {2: "Passed", 3: "Failed", 4: "Failed", 5: "Failed", 6: "Failed", 7: "Passed", 8: "Passed", 50: "Failed", 51: "Failed"}
    leak = [r | {"OfficialTarget": "t"} for r in rows[:1]]
    assert (k(6), "<header>") in codes(spark, p, leak, manifest)


def test_codes_of_single_protocols(spark):
    blank = {"ReviewerDecision": "Pending", "EvidenceSufficient": "", "DraftText": "", "__row__": 2}
    shared, single = base(P.BARK, 1), base(P.BARK, 2)
    assert codes(spark, P.BARK, [shared | blank | {"Speakers": "other"}, single | blank | {"Speakers": "other", "__row__": 3}], [shared, single]) == [("BRK009", "C1"), ("BRK011", "C2")]
    assert codes(spark, P.BARK, [single | blank | {"EvidenceRule": ""}], [single]) == [("BRK005", "C2"), ("BRK011", "C2")]
    quest = base(P.QUEST, 1)
    assert codes(spark, P.QUEST, [quest | blank | {"QuestRole": "Else"}], [quest]) == [("QST005", "C1"), ("QST009", "C1")]
    assert codes(spark, P.QUEST, [quest | blank | {"Occurrences": None}], [quest]) == [("QST009", "C1"), ("QST009", "C1")]
    skill = base(P.UI_SKILL, 1)
    assert codes(spark, P.UI_SKILL, [skill | blank | {"Relations": ""}], [skill]) == [("UIS005", "C1"), ("UIS009", "C1")]
    usage = [base(P.TAIWAN_USAGE, i) for i in range(5)]
    back = [u | {"ReviewerDecision": "Revise", "ProposedText": "new {x}", "__row__": i + 2} for i, u in enumerate(usage[:4])]
    back[1]["ProposedText"] = ""
    back[2]["ProposedText"] = "lost"
    back[3] |= {"ReviewerDecision": "Approved", "Findings": "other"}
    back.append(back[0] | {"CandidateId": "C9", "__row__": 9})
    back.append(back[0] | {"__row__": 10})
    assert codes(spark, P.TAIWAN_USAGE, back, usage) == [("TWU001", "C9"), ("TWU002", "C0"), ("TWU003", "C3"), ("TWU004", "C3"), ("TWU005", "C1"), ("TWU006", "C2"), ("TWU007", "C4")]


def test_second_pass_compares_what_was_shown(spark):
    p, sha = P.QUEST, lambda t: hashlib.sha256(t.encode()).hexdigest()
    manifest = [base(p, i) for i in range(5)]
    rows = [m | {"ReviewerDecision": "Approved", "FinalDecision": "Approved", "EvidenceSufficient": "", "FinalText": "{x} <LSTag>a</LSTag>", "OfficialTarget": f"t{i}", "ReferenceComparison": f'{{"fr": "r{i}"}}', "ApprovedAuthority": "", "__row__": i + 2} for i, m in enumerate(manifest)]
    rows[1] |= {"OfficialTarget": "edited"}
    rows[2] |= {"ReferenceComparison": "not json", "ApprovedAuthority": "Nobody"}
    rows[3] |= {"ApprovedAuthority": "OfficialTarget:zh", "FinalDecision": "Pending"}
    rows[4] |= {"ApprovedAuthority": "ReferenceLocale:fr", "FinalDecision": "x"}
    shown = [(f"C{i}", label, sha(text), present) for i in range(5) for label, text, present in (("OfficialTarget:zh", f"t{i}", True), ("ReferenceLocale:fr", f"r{i}", i != 4))]
    comparisons = spark.createDataFrame(shown, "CandidateId string, label string, sha256 string, present boolean")
    got = codes(spark, p, rows, manifest, authorities=("OfficialTarget:zh", "ReferenceLocale:fr"), comparisons=comparisons)
    assert got == [("QST007", "C4"), ("QST010", "C2"), ("QST010", "C3"), ("QST010", "C4"), ("QST014", "C1"), ("QST014", "C2"), ("QST014", "C2")]


def test_prepared_candidates(spark):
    kind = "candidate_id string, content_uid string, english_text string, speaker_mode string, speaker_count int, shared_group_id string, evidence struct<rule:string,internal_path:string,node_id:string,entity_identity:string>, speakers array<struct<identity:string,provenance:string>>"
    good = ("C1", "h1", "text", "SharedSpeaker", 2, "g", ("r", "p", "n", "e"), [("i", "v")])
    put = lambda *rows: P.prepared(spark.createDataFrame(list(rows), kind), P.bark_tests())
    assert put(good).count() == 1
    swap = lambda **k: tuple(k.get(str(i), x) for i, x in enumerate(good))
    for rows, fault in (([good, swap(**{"1": "h2"})], "duplicate CandidateId: C1"), ([good, swap(**{"0": "C2"})], "duplicate ContentUid: h1"), ([swap(**{"1": None})], "missing ContentUid"), ([swap(**{"2": ""})], "missing English"), ([swap(**{"6": ("r", "", "n", "e")})], "evidence provenance"), ([swap(**{"7": [("i", None)]})], "speaker provenance"), ([swap(**{"4": 1})], "SharedSpeaker")):
        with pytest.raises(ValueError, match=fault):
            put(*rows)


def test_gate(spark):
    view = lambda *rows: spark.createDataFrame([(r,) for r in rows], "disposition string")
    assert P.completion_gate(view("MERGE_READY", "MERGE_READY")).count() == 2 and P.completion_gate(view()).count() == 0
    for rows in (("MERGE_READY", "BLOCKED"), ("WAITING_REVIEW",), ("MERGE_READY", "Unheard"), ("MERGE_READY", None)):
        with pytest.raises(ValueError, match="completion gate"):
            P.completion_gate(view(*rows))
    assert P.unresolved(view("MERGE_READY", None, "BLOCKED")).count() == 2


STATE = "content_uid string, batch_id string, status string, translated_text string, output_hash string, updated_at timestamp"
RESULT = "content_uid string, route string, qa_rule_set_version string, qa_input_hash string, output_hash string, issues array<string>"
LOG = "resolution_id long, content_uid string, decision string, qa_rule_set_version string, qa_input_hash string, base_output_hash string, resolved_output_hash string, reviewer string, note string, resolved_at timestamp"
DECISION = "content_uid string, decision string, reviewer string, note string, revised_text string"


def test_export_and_resolve(spark):
    states = spark.createDataFrame([("u1", "b1", "succeeded", "t1", "o1", None), ("u2", "b1", "succeeded", "t2", "o2", None), ("u3", "b2", "succeeded", "t3", "new", None), ("u4", "b2", "running", None, None, None)], STATE)
    results = spark.createDataFrame([("u1", "REVIEW", "v2", "i1", "o1", ["A"]), ("u2", "REVIEW", "v2", "i2", "o2", []), ("u3", "REVIEW", "v2", "i3", "old", []), ("u9", "PASS", "v2", "i", "o", [])], RESULT)
    material = spark.createDataFrame([("u1", "b1", "s1"), ("u2", "b1", None), ("u3", "b2", "s3")], "content_uid string, batch_id string, source_text string")
    got = {r.ContentUid: (r.SourceText, r.TranslatedText, r.OutputHash, r.Issues, r.Decision) for r in P.export(results, states, material, "v2").collect()}
    assert got == {"u1": ("s1", "t1", "o1", ["A"], ""), "u2": ("", "t2", "o2", [], "")}  # u3 was judged before its output changed
    with pytest.raises(ValueError, match="missing from material"):
        P.export(results, states, material.where("content_uid <> 'u1'"), "v2").collect()
    with pytest.raises(ValueError, match="state not found"):
        P.export(results, states.where("content_uid <> 'u2'"), material, "v2").collect()
    log, now = spark.createDataFrame([], LOG), F.lit("2024-01-01 00:00:00").cast("timestamp")
    put = lambda *rows, log=log, states=states: P.resolve(states, results, log, spark.createDataFrame(list(rows), DECISION), "v2", now)
    after, written = put(("u1", "ACCEPT", " ann ", "n", None), ("u2", "REVISE", "bob", None, "better"))
    assert {r.content_uid: (r.resolution_id, r.decision, r.base_output_hash, r.resolved_output_hash, r.reviewer) for r in written.collect()} == {"u1": (1, "ACCEPT", "o1", "o1", "ann"), "u2": (2, "REVISE", "o2", hashlib.sha256(b"better").hexdigest(), "bob")}
    assert {r.content_uid: r.translated_text for r in after.collect()} == {"u1": "t1", "u2": "better", "u3": "t3", "u4": None}
    written = written.cache()
    for rows, fault in (
        ([("u1", "ACCEPT", "ann", "", None)], "duplicate review decision"),
        ([("u1", "REVISE", "a", "", "x"), ("u1", "ACCEPT", "a", "", None)], "duplicate review decision"),
        ([("u1", "MAYBE", "a", "", None)], "unsupported"),
        ([("u1", "ACCEPT", " ", "", None)], "reviewer is required"),
        ([("u1", "REVISE", "a", "", None)], "REVISE requires"),
        ([("u1", "ACCEPT", "a", "", "x")], "ACCEPT must not"),
        ([("u7", "ACCEPT", "a", "", None)], "QA result not found"),
        ([("u9", "ACCEPT", "a", "", None)], "not REVIEW"),
        ([("u3", "ACCEPT", "a", "", None)], "stale"),
    ):
        with pytest.raises(ValueError, match=fault):
            put(*rows, log=written)
    assert put(("u1", "REVISE", "ann", "", "other"), log=written)[1].count() == 3  # another decision for the same output may follow
