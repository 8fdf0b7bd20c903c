"""Quality rules per document, judged per host with an empirical beta prior.

Document rules are counts over words. For each rule, and for failing any of them,
each host's share of failing documents is shrunk towards the corpus by a beta
prior fitted to the hosts themselves; a host goes when one of these shares reaches
HOST_LIMIT, and its verdict is joined back. Hosts of every size are judged alike:
a small one stays near the prior by itself. A host is the domain of a source: an
address without scheme, "www.", port and path, in lower case. Only DataFrame
functions. What crosses a shuffle is one narrow row per document and one per host;
texts stay in place.

Defined cases: null or empty text has no words and fails the base rule; a null
host is a host of its own; repeated rows each count and each return; very long
texts are read whole; a share that equals the limit fails; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A word window, and what a rule allows: repeated words, symbols, repeated lines (per cent), mean word length.
WINDOW, MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTHS = 5, 20, 10, 30, (2, 14)
#: A host goes when one of its shrunk shares of failing documents reaches HOST_LIMIT.
HOST_LIMIT = 0.5
#: Hosts are spread over so many salts in the join back, since one may hold a third of all rows.
SALTS = 32


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def domain(source: Column) -> Column:
    """The host of an address, or the source itself where it is a plain label."""
    bare = F.regexp_replace(F.lower(source), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[/:?#][\s\S]*$", ""), r"^www\.", "")


def measures(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    base = documents.select("doc_id", domain(F.col(host).cast("string")).alias("host"), text.alias("text"), words.alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    base = base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    measured = ("doc_id", "host", "n_words", "word_chars", "n_symbols")
    base = base.select(*measured, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "hashed")
    # Windows of five from pairs and fours: three combinations a word. Each step is a projection of its own, so nothing is computed twice.
    n, measured = F.size("hashed"), (*measured, "n_dup_lines")
    both = lambda a, b: F.xxhash64(a, b)
    base = base.select(*measured, "hashed", F.zip_with("hashed", F.slice("hashed", 2, n), both).alias("two"))
    base = base.select(*measured, "hashed", F.zip_with("two", F.slice("two", 3, n), both).alias("four"))
    base = base.select(*measured, F.slice(F.zip_with("four", F.slice("hashed", WINDOW, n), both), 1, F.greatest(n - WINDOW + 1, F.lit(0))).alias("windows"))
    base = base.select(*measured, "windows", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("again"))
    base = base.select(*measured, F.when(F.col("again"), F.sort_array(F.arrays_zip(F.col("windows").alias("h"), F.sequence(F.lit(0), F.size("windows") - 1).alias("i")))).alias("pairs"))
    return base.select(*measured, F.when(F.col("pairs").isNull(), F.lit(0)).otherwise(_covered(F.col("pairs"))).cast("long").alias("n_repeat_words"))


def _covered(pairs: Column) -> Column:
    """Words in windows found twice or more, from (window, place) in order: equal windows are neighbours, their places are merged in order.

    Each fold has linear work: a place adds what it covers beyond the place before it.
    """
    beside = F.arrays_zip(pairs.alias("x"), F.slice(pairs, 2, F.size(pairs)).alias("next"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pairs).alias("prev"))
    again = F.filter(beside, lambda z: F.coalesce(z["x"]["h"] == z["next"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["prev"]["h"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda z: z["x"]["i"]))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["sum"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("sum"), (i + WINDOW).alias("end"))

    return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-(10**6)).alias("end")), step, lambda acc: acc["sum"])


def failed(column=F.col) -> dict[str, Column]:
    """The rules by name; each is true where a document fails it."""
    n, chars = column("n_words"), column("word_chars")
    return {
        "few_words": n < 10,
        "repeats": 100 * column("n_repeat_words") > MAX_REPEAT * n,
        "symbols": 100 * column("n_symbols") > MAX_SYMBOLS * chars,
        "dup_lines": 100 * column("n_dup_lines") > MAX_DUP_LINES * n,
        "word_length": (chars < WORD_LENGTHS[0] * n) | (chars > WORD_LENGTHS[1] * n),
    }


ANY = "any"


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, n_docs, shares (a map from rule to shrunk share, "any" among them), host_ok: one row per host.

    A prior's mean is the corpus share; its strength follows from how far the
    hosts' shares spread beyond what their sizes explain (method of moments).
    Without such spread every host has the corpus share.
    """
    bad = failed()
    anything = F.lit(False)
    for rule in bad.values():
        anything = anything | rule
    bad[ANY] = anything
    # Two steps: a host with a third of all rows is first summed in salted parts.
    salted = measured.groupBy("host", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(r) for r, c in bad.items()])
    hosts = cut(salted.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in bad]))
    one = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *[f for r in bad for f in (F.sum(r).alias(f"f_{r}"), F.sum(F.col("n") * (F.col(r) / F.col("n")) * (F.col(r) / F.col("n"))).alias(f"q_{r}"))]).first()  # one row
    shares = {}
    for rule in bad:
        mean = (one[f"f_{rule}"] or 0) / (one.n or 1)
        excess = one[f"q_{rule}"] / one.n - mean * mean - mean * (1 - mean) * one.hosts / one.n if one.n else 0.0
        if excess > 0 and one.hosts > 1:
            strength = max(0.0, mean * (1 - mean) / excess - 1)
            shares[rule] = (F.col(rule) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        else:
            shares[rule] = F.lit(float(mean))
    kept = hosts.select("host", F.col("n").alias("n_docs"), F.create_map(*[x for r, c in shares.items() for x in (F.lit(r), c)]).alias("shares"))
    return kept.withColumn("host_ok", F.array_max(F.map_values("shares")) < HOST_LIMIT)


def judge(documents: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: the measures, base_failed, and kept (false where base_failed or the host fails)."""
    measured = cut(measures(documents, host))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    verdicts = host_verdicts(measured).select("host", F.col("host_ok"), F.col("shares")[ANY].alias("failed_share"), F.array_max(F.map_values("shares")).alias("worst_share"), salt.alias("salt"))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    met = rows.alias("d").join(verdicts.alias("v"), F.col("d.host").eqNullSafe(F.col("v.host")) & (F.col("d.salt") == F.col("v.salt")), "left")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return met.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.coalesce("host_ok", F.lit(True))).alias("kept"),
        F.round("failed_share", 6).alias("host_failed_share"),
        F.round("worst_share", 6).alias("host_worst_share"),
    )

