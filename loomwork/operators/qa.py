"""Quality checks of source and target texts: issues, the route they lead to, and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Least source length, least and most target/source ratio by category.
CONSERVATIVE = (20, 0.15, 4.0)
POLICIES = {
    "dialogue_general": (20, 0.15, 4.0),
    "dialogue_story": (20, 0.15, 4.0),
    "quest": CONSERVATIVE,
    "bark": (12, 0.20, 3.0),
    "ui": (8, 0.20, 3.0),
    "skill_spell": CONSERVATIVE,
    "item": CONSERVATIVE,
    "book_lore": CONSERVATIVE,
    "character_world": CONSERVATIVE,
    "system_message": CONSERVATIVE,
    "tutorial": CONSERVATIVE,
    "other": CONSERVATIVE,
}
#: Issues in the order in which they are reported, and the route each asks for.
SEVERITY = {
    "CATEGORY_RULE_MISSING": "FAIL",
    "OUTPUT_EMPTY": "RETRY",
    "PROTECTED_TOKEN_MISSING": "RETRY",
    "PROTECTED_TOKEN_ADDED": "RETRY",
    "LSTAG_MALFORMED": "RETRY",
    "SOURCE_EQUALS_TARGET": "REVIEW",
    "LENGTH_RATIO_SUSPICIOUS": "REVIEW",
}


def evaluate(pairs: DataFrame, category: str, source: str, target: str, required: Column | None = None) -> DataFrame:
    """``pairs`` with ``issues`` (codes in a fixed order) and ``route``; the tokens required are those of the source, or ``required``.

    A category without a policy fails and has its texts compared no further; nor have texts of which one is empty.
    """
    policy = F.create_map(*[x for k, v in POLICIES.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])[F.col(category)]
    s, t = T.stripped(F.coalesce(F.col(source), F.lit(""))), T.stripped(F.coalesce(F.col(target), F.lit("")))
    n, m = F.length(s), F.length(t)
    wanted, got = T.protected_tokens(F.col(source)) if required is None else required, T.protected_tokens(F.col(target))
    compared = F.col("_p").isNotNull() & (n > 0) & (m > 0)
    rows = pairs.withColumn("_p", policy).withColumn("_ratio", F.when(n > 0, m / n))
    tests = {
        "CATEGORY_RULE_MISSING": F.col("_p").isNull(),
        "OUTPUT_EMPTY": m == 0,
        "PROTECTED_TOKEN_MISSING": F.size(T.multiset_minus(wanted, got)) > 0,
        "PROTECTED_TOKEN_ADDED": F.size(T.multiset_minus(got, wanted)) > 0,
        "LSTAG_MALFORMED": T.markup_faults(F.col(target), T.MARKUP),
        "SOURCE_EQUALS_TARGET": compared & (s == t) & s.rlike(T.LANGUAGE_BEARING),
        "LENGTH_RATIO_SUSPICIOUS": compared & (n >= F.col("_p")[0]) & ((F.col("_ratio") < F.col("_p")[1]) | (F.col("_ratio") > F.col("_p")[2])),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in tests.items()]))
    return rows.withColumn("issues", issues).drop("_p", "_ratio").withColumn("route", route(F.col("issues")))


def route(issues: Column) -> Column:
    """The gravest of what the issues ask for: FAIL, RETRY, REVIEW, else PASS."""
    asks = lambda r: F.exists(issues, lambda x: x.isin(*[k for k, v in SEVERITY.items() if v == r]))
    return F.when(asks("FAIL"), "FAIL").when(asks("RETRY"), "RETRY").when(asks("REVIEW"), "REVIEW").otherwise("PASS")


def stale(results: DataFrame, states: DataFrame, key: str, ruleset: str) -> DataFrame:
    """Results with whether they still hold: same output and same rules."""
    joined = results.join(states.select(key, F.col("output_hash").alias("_now")), key)
    return joined.withColumn("is_stale", (F.col("output_hash") != F.col("_now")) | (F.col("ruleset") != ruleset)).drop("_now")


def coverage(judged: DataFrame, total: int) -> DataFrame:
    """route, checked, n: results by route and whether they still hold (checked or stale), and a row of what was never judged.

    ``judged``: route and is_stale of every stored result; ``total``: rows of the corpus.
    """
    by = judged.groupBy("route", F.when(F.col("is_stale"), "stale").otherwise("checked").alias("checked")).agg(F.count(F.lit(1)).alias("n"))
    rest = judged.agg((F.lit(total) - F.count(F.lit(1))).cast("long").alias("n")).select(F.lit(None).cast("string").alias("route"), F.lit("not checked").alias("checked"), "n")
    return by.unionByName(rest)


def usage_findings(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """key, rule_id, n_matches: a few literal rules that a text meets, and how often; a literal is never read as a pattern.

    Counts alone stay in generated code; offsets, and many rules, are for :mod:`.matches`.
    """
    quoted = lambda p: "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    found = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.regexp_count(F.col(text), F.lit(quoted(p))).cast("long").alias("n_matches")) for i, p in rules])
    return rows.select(key, F.inline(found)).where("n_matches > 0")
