"""Dimensions from JSON, and what is refused."""

import json

import pytest

from loomwork.sources import configs

RULES = {"version": "3", "sourceLocale": "en", "targetLocale": "zh", "commonRules": ["a"], "categoryRules": {"ui": ["short"], "item": []}, "glossary": [{"source": "door", "target": "門"}]}
PRICES = {"schemaVersion": "1.0", "currency": "USD", "models": [{"provider": "p", "model": "m", "inputPerMillion": "0.000125", "outputPerMillion": 2}]}
USAGE = {"schemaVersion": "1.0", "rules": [{"ruleId": "R1", "kind": "literal", "pattern": "x", "category": "c", "rationale": "r", "ignoreCase": True}]}


@pytest.fixture
def put(tmp_path):
    def write(value, raw=None):
        path = tmp_path / "doc.json"
        path.write_text(raw if raw is not None else "﻿" + json.dumps(value, ensure_ascii=False), encoding="utf-8")
        return str(path)

    return write


def test_read(spark, put):
    rules = configs.ruleset(spark, put(RULES))
    assert rules[:4] == ("3", "en", "zh", ["a"]) and {r.category: r.rules for r in rules.category_rules.collect()} == {"ui": ["short"], "item": []} and [tuple(r) for r in rules.glossary.collect()] == [("door", "門")]
    prices = configs.pricing(spark, put(PRICES))
    assert prices.currency == "USD" and [tuple(map(str, r)) for r in prices.prices.collect()] == [("p", "m", "0.000125000000", "2.000000000000")]
    assert [tuple(r) for r in configs.usage_rules(spark, put(USAGE)).collect()] == [("R1", "literal", "x", "c", "r", "", True)]


@pytest.mark.parametrize(
    ("reader", "value", "fault"),
    [
        ("ruleset", RULES | {"version": " "}, "version is required"),
        ("ruleset", RULES | {"targetLocale": None}, "targetLocale is required"),
        ("ruleset", {k: v for k, v in RULES.items() if k != "commonRules"}, "commonRules is required"),
        ("ruleset", RULES | {"commonRules": [1]}, "string array"),
        ("ruleset", RULES | {"categoryRules": {}}, "non-empty object"),
        ("ruleset", RULES | {"categoryRules": {" ": []}}, "category names"),
        ("ruleset", RULES | {"categoryRules": {"ui": "x"}}, "categoryRules.ui must be"),
        ("ruleset", RULES | {"glossary": {}}, "glossary must be an array"),
        ("ruleset", RULES | {"glossary": ["x"]}, r"glossary\[0\] must be an object"),
        ("ruleset", RULES | {"glossary": [{"source": "x"}]}, "requires source and target"),
        ("ruleset", [], "root must be"),
        ("pricing", PRICES | {"schemaVersion": "2"}, "schemaVersion 1.0"),
        ("pricing", PRICES | {"currency": ""}, "requires currency"),
        ("pricing", PRICES | {"models": ["x"]}, "must contain objects"),
        ("pricing", PRICES | {"models": [PRICES["models"][0] | {"inputPerMillion": "x"}]}, "finite"),
        ("pricing", PRICES | {"models": [PRICES["models"][0] | {"inputPerMillion": "NaN"}]}, "non-negative"),
        ("pricing", PRICES | {"models": [PRICES["models"][0] | {"outputPerMillion": -1}]}, "non-negative"),
        ("pricing", PRICES | {"models": PRICES["models"] * 2}, "duplicate pricing entry: p/m"),
        ("usage_rules", USAGE | {"more": 1}, "schemaVersion 1.0"),
        ("usage_rules", USAGE | {"rules": []}, "no rules"),
        ("usage_rules", USAGE | {"rules": [USAGE["rules"][0] | {"x": 1}]}, r"rules\[0\]"),
        ("usage_rules", USAGE | {"rules": [USAGE["rules"][0] | {"rationale": ""}]}, r"rules\[0\]"),
        ("usage_rules", USAGE | {"rules": USAGE["rules"] * 2}, "duplicate ruleId: R1"),
    ],
)
def test_refused(spark, put, reader, value, fault):
    with pytest.raises(ValueError, match=fault):
        getattr(configs, reader)(spark, put(value))


def test_no_json(spark, put):
    with pytest.raises(ValueError, match="invalid ruleset"):
        configs.ruleset(spark, put(None, "{"))
