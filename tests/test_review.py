"""Packages, prompts, reviews, the provider loop, spreadsheets and stages."""

import io
import zipfile

import pytest

from loomwork import stages
from loomwork.operators import package, review
from loomwork.sources import grammars, provider, xlsx


def test_material_by_mode(spark):
    one = lambda text, version="1": {"text": text, "version": version}
    rows = spark.createDataFrame([("u1", {"en": one("Hi {x}"), "fr": one("Salut", "2")}, "ctx"), ("u2", {"zh": one("old")}, None), ("u3", {"en": one("a"), "zh": one("b")}, None)], "ContentUid string, locales map<string,struct<text:string,version:string>>, Context string")
    shown, base = package.material(rows, "context", "en", "zh", ["fr"])
    assert shown.columns == "ContentUid SourceLocale SourceText TargetLocale SourceVersion PresenceStatus TranslationRequired ProtectedTokens ExistingTargetText TargetVersion ReferenceText[fr] Context TranslatedTargetText TranslationStatus TranslatorNotes TranslatorName".split()
    assert {r.ContentUid: (r.PresenceStatus, r.TranslationRequired, r.ProtectedTokens, r["ReferenceText[fr]"], r.ExistingTargetText, r.Context) for r in shown.collect()} == {"u1": ("source-only", True, '["{x}"]', "Salut", "", "ctx"), "u2": ("target-only", False, "[]", "", "old", ""), "u3": ("source+target", True, "[]", "", "b", "")}
    assert {r.ContentUid: (r.ProtectedTokens, r.References["fr"] and r.References["fr"].version) for r in base.collect()} == {"u1": (["{x}"], "2"), "u2": ([], None), "u3": ([], None)}
    assert "Context" not in package.contract("basic")[0] and package.contract("basic")[1][0] == "TranslatedTargetText"
    blind = package.material(rows, "blind-first", "en", "zh")[0]
    assert blind.columns[-6:] == ["Context", "GlossaryReference", "IndependentTargetText", "TranslationStatus", "TranslatorNotes", "TranslatorName"] and "ExistingTargetText" not in blind.columns
    with pytest.raises(ValueError, match="blind"):
        package.guard(shown)
    with pytest.raises(ValueError, match="mode"):
        package.contract("other")


def test_buckets_and_story_domains(spark):
    rows = [("multilingual-x", "", "multilingual"), ("bark-speaker", "QuestX", "bark"), ("quest-journal", "", "quest"), ("x", "Quest1", "quest"), ("x", "AbilityOrSkill", "ui-skill"), ("ui-skill-candidate", "", "ui-skill"), ("x", "exactReuse", "multilingual"), ("stat-reference", "y", "context"), (None, None, "context")]
    df = spark.createDataFrame(rows, "m string, c string, want string")
    assert df.where(package.buckets(df.m, df.c) != df.want).count() == 0
    rows = [("DialogsRaw", "", "", "", "a/Cinematic/b", "CinematicSubtitle"), ("Dialog", "Narrator", "", "", "", "Narration"), ("DialogsBinary", "TagQuestion", "bark", "", "", "PlayerDialogueOption"), ("DialogsRaw", "x", "Bark", "", "", "AmbientDialogue"), ("DialogsRaw", None, None, None, None, "NPCDialogue"), ("Cinematics", "", "", "", "", "CinematicSubtitle"), ("JournalQuest", "", "", "QuestTitle", "", "QuestTitle"), ("JournalQuest", "", "", "Objective", "", "QuestDescription"), ("JournalQuest", "", "", "x", "", "JournalEntry"), ("ReadableLocalizationRegistry", "", "", "DisplayName", "", "BookTitle"), ("ReadableLocalizationRegistry", "", "", "", "", "ReadableWorldText"), ("RootTemplates", "", "", "", "", "StoryRelatedTerm"), ("StoryGoals", "", "", "", "", "ContextSupportOnly"), ("else", "", "", "", "", "Unknown")]
    df = spark.createDataFrame(rows, "f string, k string, c string, field string, p string, want string")
    assert df.where(grammars.story_domain(df.f, df.k, df.c, df.field, df.p) != df.want).count() == 0


def test_prompts(spark):
    rows = spark.createDataFrame([("u1", "ui", "Open the Door {x}"), ("u2", "bark", "x")], "uid string, category string, text string")
    rules = spark.createDataFrame([("ui", ["Be short.", "No dots."])], "category string, rules array<string>")
    terms = spark.createDataFrame([("door", "porte"), ("axe", "hache")], "source string, target string")
    got = package.prompts(rows.where("category = 'ui'"), rules, terms, "category", "text").first()
    assert got.prompt == "Be short.\nNo dots.\ndoor = porte\n{x}\nOpen the Door {x}"
    with pytest.raises(Exception, match="no rules for category bark"):
        package.prompts(rows, rules, terms, "category", "text").collect()


def test_evidence(spark):
    rows = spark.createDataFrame([("u1",), ("u2",)], "uid string")
    evidence = spark.createDataFrame([("u1", "quest", "b"), ("u1", "bark", "a"), ("u1", "bark", "a")], "uid string, kind string, summary string")
    assert {r.uid: (r.evidence_flags, r.context_summary) for r in package.evidence_flags(rows, evidence, "uid").collect()} == {"u1": ("bark;quest", "a | b"), "u2": ("", "")}


def test_review_surface(spark):
    manifest = spark.createDataFrame([("A", "Hi {x}"), ("B", "Yes"), ("C", "No"), ("D", "Go")], "candidate_id string, source_text string")
    back = [("A", "Hi {x}", "NeedsRevision", "Salut"), ("B", "Yes!", "Approved", ""), ("C", "No", "maybe", None), ("C", "No", "NeedsRevision", " "), ("Z", "?", "NotApplicable", "")]
    got = sorted(map(tuple, review.check_surface(spark.createDataFrame(back, "candidate_id string, source_text string, decision string, revised_text string"), manifest).collect()))
    assert got == [("A", "TOKENS_MISSING"), ("B", "SOURCE_CHANGED"), ("C", "DECISION_UNKNOWN"), ("C", "REPEATED"), ("C", "REVISION_EMPTY"), ("D", "MISSING"), ("Z", "FOREIGN")]


def test_acceptance_is_bound(spark):
    log = spark.createDataFrame([(1, "u", "h1", "h1", "i", "v2", "ACCEPT"), (2, "w", "h", "h", "i", "v2", "REVISE"), (3, "x", "h", "g", "i", "v2", "ACCEPT")], "resolution_id long, content_uid string, base_output_hash string, resolved_output_hash string, qa_input_hash string, qa_rule_set_version string, decision string")
    now = lambda h: spark.createDataFrame([("u", h, "i", "v2"), ("w", "h", "i", "v2"), ("x", "g", "i", "v2")], "content_uid string, output_hash string, qa_input_hash string, qa_rule_set_version string")
    assert [r.content_uid for r in review.accepted(log, now("h1")).collect()] == ["u"]
    assert review.accepted(log, now("h2")).collect() == []


def test_provider(spark):
    def call(uid, text):
        if uid == "boom":
            raise RuntimeError
        return ("succeeded", text.upper(), None, 3, 4) if uid == "ok" else ("failed-retryable", None, "HTTP_503", None, None)

    rows = spark.createDataFrame([("ok", "a"), ("boom", "b"), ("busy", "c")], "content_uid string, text string")
    got = {r.content_uid: (r.outcome, r.translated_text, r.error_code, r.attempts, r.prompt_tokens) for r in provider.run(rows, call, sleep=lambda s: None).collect()}
    assert got == {"ok": ("succeeded", "A", None, 1, 3), "boom": ("failed-final", None, "PROVIDER_EXCEPTION:RuntimeError", 1, None), "busy": ("failed-final", None, "HTTP_503", 3, None)}


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Uid</t></si><si><t>Text</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3"><v>7</v></c><c r="C3" t="s"><v>2</v></c></row><row><c r="A4"><v></v></c></row></sheetData></worksheet>')
    (tmp_path / "m.xlsx").write_bytes(data.getvalue())
    assert [tuple(r) for r in xlsx.read(spark, str(tmp_path), ["Uid", "Text"]).collect()] == [("7", "ab", "m.xlsx", 3)]
    with pytest.raises(Exception, match="no header"):
        xlsx.read(spark, str(tmp_path), ["Other"]).collect()


def test_stages(tmp_path):
    path = str(tmp_path / "state.json")
    state = stages.load(path)
    one = stages.fingerprint({"b": 1, "a": "é"})
    assert one == stages.fingerprint({"a": "é", "b": 1})
    x, y = tmp_path / "x", tmp_path / "y"
    x.write_text("x")
    y.write_text("y")
    for stage in stages.STAGES:
        state = stages.finish(state, stage, one, str(x))
    stages.save(path, state)
    state = stages.load(path)
    assert all(stages.reusable(state, s, one) for s in stages.STAGES) and not stages.reusable(state, "validate", "other")
    state = stages.finish(state, "package", "other", str(y))
    assert stages.reusable(state, "evidence", one) and stages.reusable(state, "package", "other") and not stages.reusable(state, "translate", one)
    y.write_text("changed")
    assert not stages.reusable(state, "package", "other")


def test_provider_waits_by_streak_and_as_asked(spark):
    answers = {"a1": ("failed-retryable", None, "HTTP_503", None, None), "a2": ("failed-retryable", None, "HTTP_429", None, None, 500.0), "a3": ("failed-retryable", None, "HTTP_429", None, None, 7.0), "ok": ("succeeded", "T", None, 1, 1), "b1": ("failed-retryable", None, "HTTP_503", None, None)}
    rows = spark.createDataFrame([(k, "x") for k in answers], "content_uid string, text string").coalesce(1).sortWithinPartitions("content_uid")
    import json
    import tempfile

    log = tempfile.mktemp()

    def sleep(seconds):
        with open(log, "a") as f:
            f.write(json.dumps(seconds) + "\n")

    provider.run(rows, lambda uid, text: answers[uid], max_attempts=1, sleep=sleep).collect()
    # a1 fails (first in a row), a2 asks for more than the most, a3 for 7 s, b1 is the fourth in a row; ok ends the streak.
    assert [json.loads(x) for x in open(log)] == [2.0, 60.0, 7.0, 16.0]


def test_scope(spark):
    rows = spark.createDataFrame([(f"u{i}", i) for i in range(20)], "ContentUid string, n int")
    scope = lambda *uids: spark.createDataFrame([(u,) for u in uids], "ContentUid string")
    assert package.scoped(rows, None).count() == 20 and sorted(r.n for r in package.scoped(rows, scope("u1", "u3", "u1")).collect()) == [1, 3]
    with pytest.raises(ValueError, match="x0, x1"):
        package.scoped(rows, scope("u1", "x1", "x0"))
    with pytest.raises(ValueError, match=r", \.\.\.$"):
        package.scoped(rows, scope(*[f"x{i}" for i in range(12)]), shown=12 - 1 - 1)
