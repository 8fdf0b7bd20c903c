"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Only DataFrame functions. Per document the matches of a pattern and the pieces
between them give code-point offsets, summed in blocks of about the root of
their number, so nothing is shuffled and a text of a million matches ends in
seconds. Context is up to NEAR characters before and after a match, reaching
over at most one other match of its kind; it raises or lowers the score. Added
kinds need ACCEPT; base kinds are kept whatever they score.

Defined cases: null text counts as empty and yields no span; a null doc_id is
carried through; repeated rows give repeated rows; very long texts are read
whole; spans of several kinds on the same characters all stay, ordered by start
and then kind; an empty table gives an empty table; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds. Possessive repeats and the \G anchors change
#: no match; they keep the matcher from recursing or rescanning very long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
#: Kinds that the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Order of kinds at equal starts, first the base kinds; with the score before context.
KINDS = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.4, "ssn": 0.3}
BASE = 4
#: Words that raise the score of a kind when they stand near it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
#: Words that lower it: what looks alike but is no personal data.
AGAINST = {
    "email": r"(?i)\b(?:no-?reply|example|package|import)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter|build)\b",
    "card": r"(?i)\b(?:isbn|order|invoice|tracking|serial|barcode)\b",
    "phone": r"(?i)\b(?:order|version|isbn|coordinates|latitude)\b",
    "iban": r"(?i)\b(?:sample|example|part|serial|licen[cs]e)\b",
    "ssn": r"(?i)\b(?:part|serial|model|order|tracking)\b",
}
NEAR, CONTEXT_BONUS, CONTEXT_MALUS, CHECKSUM_BONUS, ACCEPT = 48, 0.3, 0.3, 0.4, 0.6


def luhn(digits: Column) -> Column:
    """Whether the string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 by 97, letters standing for 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def proposed(text: Column, pattern: str, only_if: Column) -> Column:
    """array<struct<g, m>>: the pieces between the matches of a pattern, and after each its match (null after the last)."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(only_if, found).otherwise(F.array().cast("array<struct<g:string,m:string>>"))


def matches(found: Column) -> Column:
    """array<struct<s, e, v, before, after>>: the matches with code-point offsets, from a column of :func:`proposed`.

    Offsets are sums within blocks of about the root of n pieces, and of blocks: appending n entries to one array costs n * n, this costs n ** 1.5.
    """
    n, empty = F.size(found), lambda x: F.coalesce(x, F.lit(""))
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    length = lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    sums = lambda block, size: F.aggregate(block, zero, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), wide), lambda i: sums(F.slice(found, i, wide), length)))
    offsets = F.transform(F.array(blocks), lambda b: F.flatten(F.zip_with(b, sums(F.transform(b, lambda x: x["at"]), lambda x: x)["out"], lambda x, base: F.transform(x["out"], lambda y: y + base))))[0]
    none = F.array(F.lit(None).cast("struct<g:string,m:string>"))
    beside = F.arrays_zip(offsets.alias("at"), found.alias("x"), F.concat(none, found).alias("prev"), F.slice(found, 2, n).alias("next"), F.slice(found, 3, n).alias("then"))

    def hit(z: Column) -> Column:
        x = z["x"]
        start = z["at"] + F.length(x["g"])
        before = F.right(F.concat(F.right(empty(z["prev"]["g"]), F.lit(NEAR)), empty(z["prev"]["m"]), x["g"]), F.lit(NEAR))
        after = F.left(F.concat(empty(z["next"]["g"]), empty(z["next"]["m"]), F.left(empty(z["then"]["g"]), F.lit(NEAR))), F.lit(NEAR))
        return F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["m"].alias("v"), before.alias("before"), after.alias("after"))

    kept = F.transform(F.filter(beside, lambda z: z["x"]["m"].isNotNull()), hit)
    return F.when(n > 1, kept).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, text and ``found``: array<struct<s, k, e, kind, score>> by start and kind, base spans and accepted others."""
    text = F.col("text")
    base = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = base.select(
        "doc_id",
        "text",
        proposed(text, EMAIL, text.contains("@")).alias("email"),
        proposed(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")).alias("ip"),
        proposed(text, CARD, text.rlike(CARD)).alias("card"),
        proposed(text, PHONE, text.rlike(r"\+[0-9]")).alias("phone"),
        proposed(text, IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}")).alias("iban"),
        proposed(text, SSN, text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")).alias("ssn"),
    )
    raw = pieces.select("doc_id", "text", *[matches(F.col(kind)).alias(kind) for kind in KINDS])

    def valid(kind: str, x: Column) -> Column:
        value = x["v"]
        if kind == "ip":
            return value.rlike(IP_PARTS)
        if kind == "card":
            return F.length(_digits(value)).between(12, 19) & luhn(_digits(value))
        if kind == "phone":
            return F.length(_digits(value)).between(9, 15)
        if kind == "iban":
            return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(value, F.lit(" "), F.lit("")))
        if kind == "ssn":
            return ~value.rlike(r"^(?:000|666|9)") & ~value.rlike(r"-00-|-0000$")
        return F.lit(True)

    def scored(kind: str, order: int) -> Column:
        def make(x: Column) -> Column:
            bonus = CHECKSUM_BONUS if kind == "iban" else 0.0
            near = F.concat(x["before"], F.lit(" "), x["after"])
            score = F.lit(KINDS[kind] + bonus) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST[kind]), CONTEXT_MALUS).otherwise(0.0)
            return F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), score).alias("score"))

        kept = F.transform(F.filter(F.col(kind), lambda x: valid(kind, x)), make)
        return kept if order < BASE else F.filter(kept, lambda x: x["score"] >= ACCEPT)

    return raw.select("doc_id", "text", F.array_sort(F.concat(*[scored(k, i) for i, k in enumerate(KINDS)])).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(documents: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of the base spans, all spans and the highest score (null without spans)."""
    found, found_spans = F.col("found"), spans(documents)
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_spans.select(
        "doc_id",
        *[count(k) for k in list(KINDS)[:BASE]],
        F.sha2(joined(F.filter(found, lambda x: x["k"] < BASE)), 256).alias("base_sha256"),
        joined(found).alias("spans"),
        F.array_max(F.transform(found, lambda x: x["score"])).alias("top_score"),
    )


def redact(documents: DataFrame, mask: str = "[PII]") -> DataFrame:
    """The documents with every span of the text replaced; other columns stay. Overlapping spans are masked once."""
    text, found = F.col("text"), F.col("found")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return spans(documents).select("doc_id", masked.alias("text"))
