"""Batch input, providers, returned material, quality states, story occurrences, lineage: edge rows and fail-closed checks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import assemble, batch, graph, merge, providers, qa_state, returns
from loomwork.sources import story

UID = "h0123456{}g0123g0123g0123g0123456789ab"


def test_dialog_groups(spark):
    rows = [("Mods\\X\\Story\\Dialogs\\Camp\\A.lsj",), ("/m/Story/DialogsBinary/Camp/A.lsf",), (" Other/B.txt ",), ("m/story/dialogs/.lsf",)]
    got = [r.g for r in spark.createDataFrame(rows, "p string").select(assemble.dialog_group(F.col("p")).alias("g")).collect()]
    assert got == ["dialog:camp/a", "dialog:camp/a", "dialog:other/b.txt", "dialog:.lsf"]


def parts(spark):
    classified = spark.createDataFrame([("A", "quest", "s", ["P "]), ("B", "quest", "s", []), ("C", "other", "s", None)], "content_uid string, primary_category string, classification_status string, evidence_paths array<string>")
    source = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", None)], "content_uid string, text string")
    groups = lambda rows: spark.createDataFrame(rows, "content_uid string, candidates array<string>, subkeys array<string>")
    return classified, source, groups([("C", ["story:c"], ["x"])]), groups([]), groups([("A", [], ["role"]), ("B", ["quest:b"], ["q"])])


def test_chain_of_sources(spark):
    got = {r.content_uid: (r.candidates, r.subkeys) for r in assemble.inputs(*parts(spark)).collect()}
    # A asked research, which has a subkey but no group; C takes the story's group without its subkeys.
    assert got == {"A": (["path:p"], ["role"]), "B": (["quest:b"], ["q"]), "C": (["story:c"], [])}


@pytest.mark.parametrize("fault", ["repeated", "foreign", "missing"])
def test_inputs_fail_closed(spark, fault):
    classified, source, *groups = parts(spark)
    if fault == "repeated":
        classified = classified.unionByName(classified.limit(1))
    elif fault == "foreign":
        source = source.unionByName(spark.createDataFrame([("Z", "z")], source.schema))
    else:
        source = source.where("content_uid <> 'B'")
    with pytest.raises(ValueError):
        assemble.inputs(classified, source, *groups)


def test_providers_of_no_entries_and_unsafe_paths(spark):
    rows = [("Game.pak", "GUI/A.xaml"), ("Shared.pak", "gui/a.XAML"), ("Game.pak", "GUI/C:/x.xaml"), ("Game.pak", "../x.xaml"), ("Odd.pak", "b.xaml"), ("Game.pak", "x.md")]
    entries = spark.createDataFrame(rows, "package string, internal_path string")
    got = {(r.package, r.internal_path): (r.collision, r.families) for r in providers.discover(entries).collect()}
    assert got == {("Game.pak", "GUI/A.xaml"): (True, ["Engine/Game UI projection", "UI/GUI definitions"]), ("Shared.pak", "gui/a.XAML"): (True, ["UI/GUI definitions"])}
    assert providers.discover(entries.limit(0)).collect() == []
    domains = spark.range(1).select(*[providers.provider_domains(F.lit(p), F.array(F.lit(f)), F.array().cast("array<string>")).alias(p) for p, f in [("HUD/x", "UI/GUI definitions"), ("b", "SpellData"), ("c", "Weapon"), ("d", "none")]]).first()
    assert list(domains) == [["UI.HUD"], ["Ability.Unknown"], ["Item.Unknown"], ["Unknown"]]


def test_returned_rows_and_coverage(spark):
    base = spark.createDataFrame([("1", "a {x}", "source-only", True, ["{x}"]), ("2", "<LSTag>b</LSTag>", "source-only", True, []), ("3", "c", "source+target", False, [])], "ContentUid string, SourceText string, PresenceStatus string, TranslationRequired boolean, ProtectedTokens array<string>")
    rows = [("1", "a {x}", "u {x}", "done", "", 1), ("2", "<LSTag>b</LSTag>", "plain", "", None, 2), (None, "c", "t", "done", "", 3), ("1", "a {x}", "again", "done", "", 4), ("3", "c", None, None, "added", 5)]
    back = spark.createDataFrame(rows, "ContentUid string, SourceText string, IndependentTargetText string, TranslationStatus string, Extra string, __row__ int")
    out = returns.check(back, base, "blind-first", ["ContentUid", "SourceText", "IndependentTargetText", "TranslationStatus"], ["__row__"])
    assert {r["__row__"]: (r.errors, r.accepted) for r in out.collect()} == {1: ([], True), 2: (["VAL008"], False), 3: (["VAL001"], False), 4: (["VAL002"], False), 5: (["VAL011"], False)}
    assert [r.ContentUid for r in returns.uncovered(out, base).collect()] == ["2"]
    s = returns.summary(out, base, "blind-first", strict=True).first()
    assert (s.n_errors, s.coverage, s.status, s.exit_code, s.n_missing) == (5, 0.5, "fail", 33, 0)
    none = returns.summary(out.limit(0), base.limit(0), "blind-first").first()
    assert (none.n_errors, none.coverage, none.status, none.exit_code) == (0, 1.0, "pass", 0)


def test_quality_states_fail_closed(spark):
    states = spark.createDataFrame([("a", "succeeded", "t", "h", 1), ("b", "succeeded", None, None, 1)], "content_uid string, status string, translated_text string, output_hash string, attempt_count int")
    states = states.withColumns({"lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    results = spark.createDataFrame([("a", "RETRY", "v", "in", "h", None)], "content_uid string, route string, qa_rule_set_version string, qa_input_hash string, output_hash string, checked_at timestamp")
    archive = spark.createDataFrame([], "content_uid string, translated_text string, output_hash string, qa_rule_set_version string, qa_input_hash string, route string, issues_json string, rejected_at timestamp")
    judged = lambda uid, route="RETRY", text="in": spark.createDataFrame([(uid, route, "v", text, [("C",)])], "content_uid string, route string, qa_rule_set_version string, qa_input_hash string, issues array<struct<issue_code:string>>")
    now = F.lit("2024-01-01").cast("timestamp")
    for bad in (judged("b"), judged("z"), judged("a", "PASS"), judged("a", text="other")):
        with pytest.raises(ValueError):
            qa_state.send_back(states, results, archive, bad, now, 3)
    with pytest.raises(ValueError):
        qa_state.send_back(states, results.withColumn("output_hash", F.lit("old")), archive, judged("a"), now, 3)
    after, kept = qa_state.send_back(states, results, archive, judged("a"), now, 3)
    assert {r.content_uid: r.status for r in after.collect()} == {"a": "failed-retryable", "b": "succeeded"}
    assert [r.translated_text for r in kept.collect()] == ["t"]
    assert qa_state.due(states, results, "v").select("content_uid").collect() == [("b",)]
    assert qa_state.due(states, results, "w", 1).select("content_uid").collect() == [("a",)]


def test_story_occurrences(spark):
    a, b, c = (UID.format(x) for x in "abc")
    xml = f'<save><node id="N"><attribute id="Title" handle="{a.upper()}"/><node id="M"><attribute id="UUID" value="m1"/><attribute id="OldText" handle="{b}"/></node></node></save>'
    dialog = {"save": {"regions": {"dialog": {"category": {"value": "Bark"}, "nodes": [{"node": [{"UUID": {"value": "n1"}, "speaker": {"value": "0"}, "TaggedTexts": [{"h": a}]}, {"UUID": {"value": "n2"}, "speaker": {"value": "-1"}, "TaggedTexts": [b]}]}]}}}}
    files = [("q", "JournalQuest", xml), ("d", "DialogsRaw", json.dumps(dialog)), ("g", "StoryGoals", f"x\n{c} {c}\n"), ("broken", "Cinematics", "<a"), ("bad", "DialogsRaw", "{"), ("none", "RootTemplates", None), ("?", "Odd", xml)]
    found = story.occurrences(spark.createDataFrame(files, "path string, family string, value string"))
    got = sorted((r.path, r.content_uid, r.node_id, r.attribute_role, r.story_domain, r.has_speaker, r.is_old_text) for r in found.collect())
    assert got == [
        ("d", a, "n1", "TagText", "AmbientDialogue", True, False),
        ("d", b, "n2", "TagText", "AmbientDialogue", False, False),
        ("g", c, "line/2", "StoryGoalText", "ContextSupportOnly", False, False),
        ("g", c, "line/2", "StoryGoalText", "ContextSupportOnly", False, False),
        ("q", a, "N#1", "Title", "QuestTitle", False, False),
        ("q", b, "m1", "OldText", "JournalEntry", False, True),
    ]
    texts = spark.createDataFrame([(a, "x"), (b, "y"), (c, "%%% EMPTY")], "content_uid string, text string")
    candidates = texts.select("content_uid").unionByName(spark.createDataFrame([("none",)], "content_uid string"))
    old = found.where("path = 'q'")
    assert {r.content_uid: r.reason for r in story.clearance(candidates, old, texts).collect()} == {a: "ClearedForTranslationSupplement", b: "OldTextOnly", c: "MissingOrEmptySourceText", "none": "MissingOrEmptySourceText"}


def test_passive_handles(spark):
    a, b = UID.format("a"), UID.format("b")
    text = f'new entry "P"\ntype "PassiveData"\ndata "DisplayName" "{a};1"\ndata "Icon" "{b}"\nnew entry "S"\ntype "SpellData"\ndata "DisplayName" "{a}"'
    files = spark.createDataFrame([("f", text)], "path string, value string")
    targets = spark.createDataFrame([(a,), (b,)], "content_uid string")
    assert [(r.entry, r.field, r.content_uid) for r in story.passive_handles(files, targets).collect()] == [("P", "DisplayName", a)]


def test_lineage_ends_in_a_cycle(spark):
    rows = [(1, "p", "x", "", "y", {"f": "u"}), (2, "p", "y", "", "x", {}), (3, "p", "z", "", "gone", {"f": "v"}), (4, "p", "s", "", "s", {"f": "w"}), (5, "p", "s", "", "", {"f": "other"})]
    definitions = spark.createDataFrame(rows, "id int, provider string, name string, entity_type string, using string, fields map<string,string>")
    o = spark.createDataFrame([("u", "p", "x", "", "f"), ("v", "p", "z", "", "f"), ("w", "p", "s", "", "f"), ("n", "p", "absent", "", "f")], "content_uid string, provider string, entity_name string, entity_type string, field_name string")
    got = graph.lineage_uids(o, definitions, lambda value, uid: value == uid)
    assert sorted(map(tuple, got.collect())) == [(3, "v"), (4, "w")]
    assert [(r.name, r.is_equivalent) for r in graph.equivalent(definitions, "name").orderBy("name").collect()] == [("s", False), ("x", True), ("y", True), ("z", True)]


def test_framed_digest(spark):
    rows = [("b", "1"), ("a", None), ("é", "22")]
    want = hashlib.sha256()
    for cell in ("a", "", "b", "1", "é", "22", "3"):
        want.update(len(cell.encode()).to_bytes(8, "big") + cell.encode())
    got = merge.framed_digest(spark.createDataFrame(rows, "k string, v string"), "k", "v").first()
    assert (got.n_rows, got.inventory_sha256) == (3, want.hexdigest())
    assert merge.framed_digest(spark.createDataFrame([], "k string, v string"), "k", "v").first().n_rows == 0


def test_batch_numbers_beyond_four_digits_stay_apart(spark):
    rows = spark.range(10_050).select(F.col("id").alias("k"), F.lit("c").alias("category"), F.col("id").alias("grp"))
    got = batch.plan(rows, "category", "grp", ["k"], {"c": 1}).select("batch_id").distinct()
    assert got.count() == 10_050 and got.where("batch_id IN ('c-1000', 'c-10000')").count() == 2
