"""Text expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: tokens that a translation must keep, letters that mark a language, and content handles.
PROTECTED = r"(\{[^{}]+\}|%(?:[0-9]+\$)?[sdif])"
LANGUAGE_BEARING = r"[A-Za-z]{4,}"
HANDLE = r"(?<![A-Za-z0-9])(h[0-9a-f]{8}g[0-9a-f]{4}g[0-9a-f]{4}g[0-9a-f]{4}g[0-9a-f]{12})(?![A-Za-z0-9])"

#: Fixed value: the tag whose structure a target must keep.
MARKUP = "LSTag"


def sha256(text: Column | str) -> Column:
    """Hex SHA-256 of the UTF-8 bytes; null stays null."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def protected_tokens(text: Column) -> Column:
    """Placeholders in order, repeats kept; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(1)), F.array().cast("array<string>"))


def handles(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HANDLE), F.lit(1))


def multiset_minus(left: Column, right: Column) -> Column:
    """Elements of ``left`` beyond those of ``right``, with multiplicity, in the order of their values."""
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.flatten(F.transform(F.array_sort(F.array_distinct(left)), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count(left, x) - count(right, x)))))


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def candidate_id(prefix: str, uid: Column, fold: bool = True) -> Column:
    """prefix-XXXXXXXXXXXXXXXX from the first 16 hex digits of the hash."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(F.lower(uid) if fold else uid, 256), 1, 16)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def normalize_key(value: Column) -> Column:
    """Group keys and paths: forward slashes, lower case, no blanks at the ends."""
    return F.lower(F.trim(F.replace(value, F.lit("\\"), F.lit("/"))))


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.substring_index(normalize_key(path), "/", -1), r"\.[^.]*$", "")


def safe_relative(path: Column) -> Column:
    """Whether a path inside an archive stays inside: not absolute, no drive, no step up."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (p != "") & ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def markup_state(text: Column, tag: str) -> Column:
    """struct<depth, lowest>: where nesting of ``tag`` ends and how far below zero it went."""
    tags = F.regexp_extract_all(text, F.lit(rf"(</?{tag}(?:\s[^>]*)?>)"), F.lit(1))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t.startswith("</"), -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(acc["lowest"], depth).alias("lowest"))

    return F.aggregate(tags, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")), step)


def markup_faults(text: Column, tag: str) -> Column:
    """Whether ``tag`` is badly written somewhere: cut off, closed with attributes, closed unopened, or left open.

    Names match in any case; blanks may stand after ``<`` and ``</``. A tag that ends with ``/`` closes itself.
    """
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(<\s*/?\s*{tag}\b[^>]*>)"), F.lit(1))
    is_closing = lambda t: t.rlike(r"^<\s*/")

    def step(acc: Column, t: Column) -> Column:
        closes = is_closing(t)
        own = F.when(closes, -1).when(t.rlike(r"/\s*>$"), 0).otherwise(1)
        depth = acc["depth"] + own
        return F.struct(depth.alias("depth"), F.least(acc["lowest"], depth).alias("lowest"))

    state = F.aggregate(found, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")), step)
    attributes = F.exists(found, lambda t: is_closing(t) & t.rlike(rf"(?i)^<\s*/\s*{tag}\b\s*[^\s>]"))
    cut_off = F.regexp_count(text, F.lit(rf"(?i)<\s*/?\s*{tag}\b")) > F.size(found)
    return F.coalesce(cut_off | attributes | (state["depth"] != 0) | (state["lowest"] < 0), F.lit(False))


def markup_tokens(text: Column, tag: str) -> Column:
    """Every ``tag`` in order, without attributes: opened, closed, or closed by itself."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(rf"(?i)(<\s*/?\s*{tag}\b[^>]*>)"), F.lit(1)), F.array().cast("array<string>"))
    return F.transform(found, lambda t: F.when(t.rlike(r"^<\s*/"), f"</{tag}>").when(t.rlike(r"/\s*>$"), f"<{tag}/>").otherwise(f"<{tag}>"))


def percent(part: Column, total: Column) -> Column:
    """Two decimals, half to even; 0 where there is no total."""
    return F.coalesce(F.bround(100.0 * part / F.nullif(total, F.lit(0)), 2), F.lit(0.0))


def retry_delay(streak: Column, retry_after: Column | None = None, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before the next try, after the ``streak``-th failure in a row: the server's wish or doubling, from 0 to ``most``."""
    if base < 0 or most < 0:
        raise ValueError("delays must not be negative")
    doubling = F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(streak - 1, F.lit(0)))
    wish = doubling if retry_after is None else F.when(retry_after.isNotNull(), F.greatest(retry_after.cast("double"), F.lit(0.0))).otherwise(doubling)
    return F.least(F.lit(float(most)), wish)


def instant(text: Column) -> Column:
    """Timestamp of ISO text with or without fraction and Z; null where it is not one."""
    return F.try_to_timestamp(text)


def canonical_cell(value: Column) -> Column:
    """Spreadsheet cells as comparable text: trimmed, whole floats without a fraction, booleans in lower case."""
    t = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(t.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).when(F.lower(t).isin("true", "false"), F.lower(t)).otherwise(t)
