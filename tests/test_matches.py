"""Rule matches with offsets, against a plain search of each rule."""

import random
import re

import pytest

from loomwork.operators import matches, qa
from loomwork.operators.matches import Matcher, fold


def rules_of(spark, rows):
    return spark.createDataFrame([(i, kind, p, c, "why", "", case) for i, kind, p, c, case in rows], matches.RULES)


def plain(text, rows):
    found = []
    for i, kind, pattern, category, case in rows if text is not None else []:
        for m in re.finditer(re.escape(pattern) if kind == "literal" else pattern, text, re.IGNORECASE if case else 0):
            found.append((m.start(), m.end(), i, category, m.group(0)))
    return sorted(found, key=lambda f: f[:3])


RULES = [("R1", "literal", "aa", "x", False), ("R2", "literal", "AAB", "x", True), ("R3", "literal", "a.b", "y", False), ("R4", "literal", "(", "y", False), ("R5", "regex", "b+|$", "z", False), ("R6", "regex", "[é-ë]a?", "z", True), ("R7", "literal", "ß😀", "z", True), ("R8", "literal", "k", "k", True), ("R9", "literal", "aa", "w", False)]


def test_all_matches_are_the_plain_ones(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "A", "b", "B", ".", "(", "é", "É", "ß", "ẞ", "😀", "K", "k", " ", "İ"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "aaa" * 20_000), (1, texts[1])]
    df = spark.createDataFrame(rows, "id int, text string")
    rules = rules_of(spark, RULES)
    want = sorted((i, n + 1, *f[:2], f[2], f[3], f[4]) for i, t in rows for n, f in enumerate(plain(t, RULES)))
    got = lambda: sorted(map(tuple, matches.matches(df, "id", "text", rules).collect()))
    assert got() == want
    monkeypatch.setattr(matches, "BLOCK_RULES", 2)  # five passes instead of one
    assert got() == want
    counted = {(r.level, r.name): r.n for r in matches.counts(matches.matches(df, "id", "text", rules)).collect()}
    assert counted["rule", "R1"] == sum(1 for w in want if w[4] == "R1") and counted["category", "z"] == sum(1 for w in want if w[5] == "z")


def test_case_is_ignored_as_a_pattern_ignores_it():
    letters = "kKKsSſiIİıµμΜςσΣßẞéÉΐΐﬅﬆжЖ"
    for c in letters:
        found = {(s, e) for s, e, _ in Matcher([("r", "literal", c, True)])(letters)}
        assert found == {m.span() for m in re.finditer(re.escape(c), letters, re.IGNORECASE)}, c
    assert len(fold("İß😀ﬃ")) == 4


def test_literals_are_no_patterns(spark):
    df = spark.createDataFrame([(1, "axb a.b ( \\E[x] aaa"), (2, None)], "id int, text string")
    found = qa.usage_findings(df, "id", "text", [("U1", "a.b"), ("U2", "("), ("U3", "\\E["), ("U4", "aa"), ("U5", "\\Q")])
    assert sorted(map(tuple, found.collect())) == [(1, "U1", 1), (1, "U2", 1), (1, "U3", 1), (1, "U4", 1)]


def test_rule_sets_that_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    for rows, fault in (([], "no rules"), ([RULES[0], RULES[0]], "duplicate"), ([("R", "regex", "(", "c", False)], "invalid regex"), ([("R", "literal", "", "c", False)], "incomplete"), ([("R", "other", "x", "c", False)], "incomplete")):
        with pytest.raises(ValueError, match=fault):
            matches.matches(df, "id", "text", rules_of(spark, rows))


def test_candidates(spark):
    targets = spark.createDataFrame([("h1", "測試詞與甲詞 {name}"), ("h2", "沒有命中"), ("h3", "甲詞")], "uid string, text string")
    sources = spark.createDataFrame([("h1", "source one"), ("h2", "source two")], "uid string, text string")
    rules = rules_of(spark, [("R1", "literal", "測試詞", "Lexical", False), ("R2", "regex", "甲詞|乙詞", "Terminology", False)])
    got = {r.uid: r for r in matches.candidates(targets, sources, "uid", "text", rules).collect()}
    assert set(got) == {"h1", "h3"} and got["h1"].finding_count == 2 and [f.rule_id for f in got["h1"].findings] == ["R1", "R2"]
    assert got["h1"].protected_tokens == ["{name}"] and got["h3"].source_text == "" and got["h1"].candidate_id.startswith("TWUSAGE-") and len(got["h1"].candidate_id) == 24


def test_glossary_terms(spark):
    rows = spark.createDataFrame([(1, "Open the DOOR, doorman"), (2, None), (3, "nothing")], "id int, text string")
    glossary = spark.createDataFrame([("door", "porte"), ("Door", "Tür"), ("axe", "hache"), ("the", "le"), ("the", "le")], "source string, target string")
    got = {r.id: [tuple(t) for t in r.used] for r in matches.terms_in("text", glossary, rows, "used").collect()}
    assert got == {1: [("Door", "Tür"), ("door", "porte"), ("the", "le")], 2: [], 3: []}
    assert {r.id: r.used for r in matches.terms_in("text", glossary.limit(0), rows, "used").collect()} == {1: [], 2: [], 3: []}
