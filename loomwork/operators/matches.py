"""Matches of many rules in texts, with offsets: an automaton for literals, compiled patterns beside it.

All literals of a block of rules are searched in one walk over a text, however many
there are (Aho-Corasick); patterns are walked one by one. For each rule matches are the
leftmost that do not overlap. Offsets count code points, the end is exclusive. Texts stay
where they are: matching is one pass without a shuffle.

Rules are a dimension table. BLOCK_RULES of them, and BLOCK_CHARS of their text, go to
every executor at once; more are dealt to further blocks, each a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import MARKUP, candidate_id, markup_tokens, protected_tokens

RULES = "rule_id string, kind string, pattern string, category string, rationale string, recommendation string, ignore_case boolean"
FINDING = "array<struct<start:int,end:int,rule_id:string,category:string,matched_text:string,rationale:string,recommendation:string>>"
BLOCK_RULES, BLOCK_CHARS = 100_000, 8 << 20
#: Letters that a comparison without case takes for one another though neither is the other's lower case.
_ALIKE = {"\u0130": "i", "\u0131": "i", "\u1fd3": "\u0390", "\u1fe3": "\u03b0", "\ufb06": "\ufb05"}


def fold(text: str) -> str:
    """``text`` with a stand-in for each character that ignores its case; the length stays."""
    lower = text.lower()
    if text.isascii():
        return lower

    def one(c: str) -> str:
        if c in _ALIKE:
            return _ALIKE[c]
        folded = c.casefold()
        folded = folded if len(folded) == 1 else c.lower()
        return folded if len(folded) == 1 else c

    return "".join(map(one, text))


class Matcher:
    """The matches of a block of rules in a text."""

    def __init__(self, rules: list[tuple[str, str, str, bool]]):
        import ahocorasick

        self.patterns, self.verify, lists = [], {}, ({}, {})
        for i, (_, kind, pattern, ignore_case) in enumerate(rules):
            flags = re.IGNORECASE if ignore_case else 0
            if kind == "literal":
                lists[ignore_case].setdefault(fold(pattern) if ignore_case else pattern, []).append(i)
                if ignore_case:
                    self.verify[i] = re.compile(re.escape(pattern), flags)
            else:
                self.patterns.append((i, re.compile(pattern, flags)))
        self.automata = []
        for folded, words in enumerate(lists):
            if words:
                automaton = ahocorasick.Automaton()
                for word, numbers in words.items():
                    automaton.add_word(word, (len(word), numbers))
                automaton.make_automaton()
                self.automata.append((bool(folded), automaton))

    def __call__(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, rule) in no particular order."""
        for folded, automaton in self.automata:
            free: dict[int, int] = {}  # where the next match of a rule may start
            for last, (length, numbers) in automaton.iter(fold(text) if folded else text):
                start = last + 1 - length
                for i in numbers:
                    if start >= free.get(i, 0) and (not folded or self.verify[i].match(text, start, last + 1)):
                        free[i] = last + 1
                        yield start, last + 1, i
        for i, pattern in self.patterns:
            for m in pattern.finditer(text):
                yield m.start(), m.end(), i


def checked(rules: DataFrame) -> DataFrame:
    """``rules``, or an error: no rule, one without id, kind, pattern or category, an id given twice, a pattern that does not compile."""
    bad = F.coalesce("rule_id", F.lit("")) == ""
    bad = bad | ~F.coalesce(F.col("kind").isin("literal", "regex"), F.lit(False)) | (F.coalesce("pattern", F.lit("")) == "") | (F.coalesce("category", F.lit("")) == "")
    faults = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("bad")).where("n > 1 OR bad").limit(1).collect()
    if faults:
        raise ValueError(f"duplicate ruleId: {faults[0].rule_id}" if faults[0].n > 1 else f"incomplete rule: {faults[0].rule_id}")
    if rules.isEmpty():
        raise ValueError("rule set contains no rules")
    return rules


def blocks(rules: DataFrame) -> Iterator[list[Row]]:
    """Rules by id in blocks of a bounded size, one at a time on the driver."""
    block, size = [], 0
    for rule in checked(rules).select("rule_id", "kind", "pattern", "category", "rationale", "recommendation", F.coalesce("ignore_case", F.lit(False)).alias("ignore_case")).orderBy("rule_id").toLocalIterator():
        if rule.kind == "regex":
            try:
                re.compile(rule.pattern, re.IGNORECASE if rule.ignore_case else 0)
            except re.error as e:
                raise ValueError(f"invalid regex for {rule.rule_id}: {e}") from e
        block.append(rule)
        size += len(rule.pattern) + len(rule.category) + len(rule.rationale or "") + len(rule.recommendation or "")
        if len(block) >= BLOCK_RULES or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _finder(spark, block: list[Row]):
    """A column function from texts to the findings of one block."""
    shared = spark.sparkContext.broadcast([tuple(r) for r in block])
    ready: list[Matcher] = []
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *[(c, pa.string()) for c in ("rule_id", "category", "matched_text", "rationale", "recommendation")]]))

    @F.arrow_udf(FINDING)
    def find(texts: pa.Array) -> pa.Array:
        rules = shared.value
        if not ready:  # once in a worker
            ready.append(Matcher([(r[0], r[1], r[2], r[6]) for r in rules]))
        out = []
        for text in texts.to_pylist():
            found = sorted(((s, e, rules[i][0], i) for s, e, i in ready[0](text)), key=lambda m: m[:3]) if text is not None else []
            out.append([{"start": s, "end": e, "rule_id": name, "category": rules[i][3], "matched_text": text[s:e], "rationale": rules[i][4], "recommendation": rules[i][5]} for s, e, name, i in found])
        return pa.array(out, kind)

    return find


def with_findings(rows: DataFrame, text: str, rules: DataFrame, name: str = "findings") -> DataFrame:
    """``rows`` with ``name``: all matches in the text, in order of start, end and rule.

    A null text has none. Rules beyond one block take a pass each; what they
    find in a row meets in that row, so nothing is shuffled.
    """
    found = [_finder(rows.sparkSession, b) for b in blocks(rules)]
    parts = [f"_{name}_{i}" for i in range(len(found))]
    out = rows.withColumns({p: f(F.col(text)) for p, f in zip(parts, found, strict=True)})
    if len(parts) == 1:
        return out.withColumnRenamed(parts[0], name)
    return out.withColumn(name, F.array_sort(F.concat(*parts))).drop(*parts)


def matches(rows: DataFrame, key: str | list[str], text: str, rules: DataFrame) -> DataFrame:
    """key, place (from 1), start, end, rule_id, category, matched_text: a row for each match."""
    keys = [key] if isinstance(key, str) else list(key)
    found = with_findings(rows.select(*keys, text), text, rules).select(*keys, F.posexplode("findings").alias("place", "f"))
    return found.select(*keys, (F.col("place") + 1).alias("place"), *[F.col(f"f.{c}").alias(c) for c in ("start", "end", "rule_id", "category", "matched_text")])


def candidates(targets: DataFrame, sources: DataFrame, key: str, text: str, rules: DataFrame, prefix: str = "TWUSAGE") -> DataFrame:
    """One row for each text that a rule meets: id, both texts, the findings and the tokens to keep.

    ``sources`` has key and text of the source; a key it does not have has an empty source text.
    """
    source = sources.select(key, F.col(text).alias("source_text"))
    found = with_findings(targets.select(key, F.col(text).alias("target_text")), "target_text", rules).where(F.size("findings") > 0)
    return found.join(source, key, "left").select(candidate_id(prefix, F.col(key).cast("string")).alias("candidate_id"), key, F.coalesce("source_text", F.lit("")).alias("source_text"), "target_text", F.size("findings").alias("finding_count"), "findings", F.concat(protected_tokens(F.col("target_text")), markup_tokens(F.col("target_text"), MARKUP)).alias("protected_tokens"))


def counts(found: DataFrame) -> DataFrame:
    """level (rule or category), name, n: how often each was met, from :func:`matches`, in one pass."""
    grouped = found.groupingSets([[F.col("rule_id")], [F.col("category")]], F.col("rule_id"), F.col("category")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return grouped.select(F.when(F.col("g") == 1, "rule").otherwise("category").alias("level"), F.when(F.col("g") == 1, F.col("rule_id")).otherwise(F.col("category")).alias("name"), "n")


def terms_in(text: str, glossary: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the glossary entries (source, target) whose source occurs in the text in any case, in order.

    The entries' sources are literals of the automaton, so a text is walked once for all of them.
    """
    entries = glossary.select("source", "target").distinct()
    rules = entries.select(F.to_json(F.struct("source", "target")).alias("rule_id"), F.lit("literal").alias("kind"), F.col("source").alias("pattern"), F.col("source").alias("category"), F.col("target").alias("rationale"), F.lit("").alias("recommendation"), F.lit(True).alias("ignore_case"))
    if entries.isEmpty():
        return rows.withColumn(name, F.array().cast("array<struct<source:string,target:string>>"))
    met = with_findings(rows, text, rules, "_terms")
    return met.withColumn(name, F.array_sort(F.array_distinct(F.transform("_terms", lambda f: F.struct(f["category"].alias("source"), f["rationale"].alias("target")))))).drop("_terms")

