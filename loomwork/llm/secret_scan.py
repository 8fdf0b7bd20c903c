"""Secrets: known shapes, and values in a credential's place whose guess cost is high.

Base shapes are regular expressions. The method adds values that follow a wider
set of credential words: their guess cost is the cheapest segmentation of the
value into dictionary words, dates, repeats of a character or of a short block,
sequences, keyboard walks and brute-force characters, found by dynamic
programming in time linear in the value. A segment may be any stretch of a run,
not the longest alone. The dictionary is ranked: the words of a public vocabulary
in the order of its ids (a parameter: ``words``), after a few that are common in
passwords; without it only these few. A value that costs at least ``min_log10``
guesses is a secret; "pwd: documentation" is not.

Defined cases: null text counts as empty and yields no span; null ids are
carried through; repeated rows give repeated rows; spans of several kinds on the
same characters all stay, ordered by start and then kind; an empty table gives an
empty table; other columns are ignored; whole texts are read whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Fixed patterns of the base kinds, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
#: Credential words beside those of the base, and a value after them; the value is group 1.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pwd|pass(?:word|wd|phrase|code)?|secret|credentials?|auth|bearer|token|api[_-]?key|private[_-]?key|client[_-]?secret|access[_-]?key)["']?[\x20\t]*(?::|=>?)[\x20\t]*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
MIN_LOG10 = 10.0

#: Words that are more common in passwords than in prose; their place is the guess count.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login princess sunshine football baseball shadow superman "
    "batman trustno1 hello freedom whatever secret changeme default example test guest root user summer winter spring autumn love "
    "server system access account service support token apikey key value string none null true false your here insert replace "
    "placeholder dummy sample demo production staging development local database"
).split()
#: Rows of keys, for walks along them.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301$5!7", "aaeoissit")
#: The longest word looked up, and the longest block whose repeats are a segment.
LONGEST, PERIODS = 20, 12

_BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for up, low in zip(ROWS, ROWS[1:], strict=False) for i, b in enumerate(low) for a in up[i : i + 2]}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
_DATE_COST = {True: math.log10(365 * 120 * 4), False: math.log10(120)}
_CHOICE = 0.3


def ranked(words: Iterable[str] = ()) -> dict[str, float]:
    """log10 of guesses for each word of WORDS and then of ``words`` (lower case, 3 to LONGEST characters), by place."""
    out: dict[str, float] = {}
    for word in (*WORDS, *words):
        if 3 <= len(word) <= LONGEST and word not in out:
            out[word] = math.log10(len(out) + 2)
    return out


def vocabulary(path: str) -> list[str]:
    """The whole words of a vocabulary of word ends (a JSON file of a public tokenizer), in the order of ids; read on the driver."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w, _ in sorted(ids.items(), key=lambda x: x[1]) if w.endswith("</w>"))
    return [w for w in whole if w.isascii() and w.isalpha()]


def _alphabet(value: str) -> float:
    """log10 of the characters that a brute-force guesser tries at each place."""
    n = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search("[^A-Za-z0-9]", value))
    return math.log10(max(n, 10))


def _runs(n: int, joined, least: int) -> Iterable[tuple[int, int]]:
    """Maximal stretches of at least ``least`` places in which each place from the second on is joined with the one before."""
    start = 0
    for i in range(1, n + 1):
        if i == n or not joined(i):
            if i - start >= least:
                yield start, i
            start = i


def guess_cost(value: str, ranks: dict[str, float] | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``.

    A run's cost is concave in its length, so a segment that starts more than a
    word's length into a run is never better than one that starts with the run:
    from each end only the starts near the run's beginning are tried.
    """
    if not value:
        return 0.0
    ranks = _FEW if ranks is None else ranks
    low, n, per_char = value.lower(), len(value), _alphabet(value)
    plain = low.translate(LEET)
    runs: list[tuple[int, int, int, object]] = []  # start, end, least length, cost of a length
    runs += [(s, e, 3, lambda k: per_char + math.log10(k)) for s, e in _runs(n, lambda i: value[i] == value[i - 1], 3)]
    for step in (1, -1):
        runs += [(s, e, 3, lambda k: 1.0 + math.log10(k)) for s, e in _runs(n, lambda i, d=step: ord(value[i]) - ord(value[i - 1]) == d, 3)]
    runs += [(s, e, 3, lambda k: 1.7 + 0.5 * math.log10(k) + 0.3 * (k - 1) ** 0.5) for s, e in _runs(n, lambda i: (low[i - 1], low[i]) in _BESIDE, 3)]
    blocks = [(1, s, e) for s, e, _, _ in runs if e - s > 3 and value[s] == value[s + 1]]
    for p in range(2, min(PERIODS, n // 2) + 1):
        # Places that equal those one block before; the block before the first of them is part of the repeat.
        for s, e in _runs(n, lambda i, p=p: i >= p and value[i] == value[i - p], p + 1):
            if s >= p - 1 and not any(p % q == 0 and x <= s - p + 1 and e <= y for q, x, y in blocks[-PERIODS:]):  # a shorter block says the same for less
                blocks.append((p, s - p + 1, e))
                runs.append((s - p + 1, e, 2 * p, lambda k, p=p: p * per_char + math.log10(k / p + 1)))
    opens: dict[int, list] = {}
    for run in runs:
        opens.setdefault(run[0], []).append((*run, []))
    dates = {}
    for at in range(n):
        if value[at].isdigit() and (m := _DATE.match(value, at)):
            dates.setdefault(m.end(), []).append((at, _DATE_COST[len(m[0]) > 4]))
    best, live = [0.0] * (n + 1), []
    for end in range(1, n + 1):
        live = [run for run in (*live, *opens.get(end - 1, ())) if run[1] >= end]
        # A brute-force span is a sum of characters; each other segment costs one more choice.
        found = best[end - 1] + per_char
        for start, cost in dates.get(end, ()):
            found = min(found, best[start] + cost + _CHOICE)
        for begin, _, least, cost, starts in live:
            if begin <= end - least <= begin + LONGEST + PERIODS:
                starts.append(end - least)
            least_cost = math.inf
            for start in tuple(starts):
                c = best[start] + cost(end - start)
                if c < least_cost:
                    least_cost = c
                else:  # an earlier start that is better now stays so, as costs are concave
                    starts.remove(start)
            found = min(found, least_cost + _CHOICE)
        for start in range(max(0, end - LONGEST), end - 2):
            word = low[start:end]
            rank, extra = ranks.get(word), 0.0
            if rank is None:
                rank, extra = ranks.get(plain[start:end]), 0.6
            if rank is not None:
                found = min(found, best[start] + rank + extra + _CHOICE * (value[start:end] != word) + _CHOICE)
        best[end] = found
    return best[n]


_FEW = ranked()


def find(text: str, min_log10: float = MIN_LOG10, ranks: dict[str, float] | None = None) -> list[tuple[int, int, int, float]]:
    """(start, kind's place in KINDS, end, log10 of guesses) by start, then kind; base matches whatever they cost."""
    out = []
    separated = ":" in text or "=" in text
    if separated:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                out.append((m.start(), 0, m.end(), guess_cost(m[2], ranks)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), guess_cost(m[0], ranks)) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), guess_cost(m[0], ranks)) for m in HEX.finditer(text)]
    if separated:
        # A base span may stop within the value; only one that covers it whole settles it. Both lists go by start, so one walk finds the farthest end of the spans that start no later.
        known, i, reach = sorted((s, e) for s, _, e, _ in out), 0, -1
        for m in CONTEXT.finditer(text):
            while i < len(known) and known[i][0] <= m.start(1):
                reach, i = max(reach, known[i][1]), i + 1
            if m.end(1) > reach and (cost := guess_cost(m[1], ranks)) >= min_log10:
                out.append((m.start(1), 3, m.end(1), cost))
    return sorted(out)


def joined(found: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)


def digest(documents: DataFrame, min_log10: float = MIN_LOG10, words: Iterable[str] = ()) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, all spans, and the dearest guess (null without spans)."""
    kind = dict(documents.dtypes)["doc_id"]
    ranks = ranked(words)  # bounded by the vocabulary
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_log10"]

    def each(batch: pa.RecordBatch):
        rows = [find(t or "", min_log10, ranks) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(3)]
        base = [hashlib.sha256(joined([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
        top = [round(max(x[3] for x in r), 6) if r else None for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string()), pa.array(top, pa.float64())], names)

    return arrow_map(documents.select("doc_id", "text"), each, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, top_log10 double")


def masked(text: str, min_log10: float = MIN_LOG10, mask: str = "[SECRET]", ranks: dict[str, float] | None = None) -> str:
    """``text`` with each stretch covered by spans replaced by one mask; a value of which a span holds the beginning goes whole."""
    out, at, i = [], 0, 0
    spans = find(text, min_log10, ranks)
    values = [m.span(1) for m in CONTEXT.finditer(text)] if any(k == 0 for _, k, _, _ in spans) else []
    for s, k, e, _ in spans:
        if k == 0:  # values and spans both go by start and do not overlap within their kind
            while i < len(values) and values[i][1] <= e:
                i += 1
            if i < len(values) and values[i][0] < e:
                e = values[i][1]
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, min_log10: float = MIN_LOG10, mask: str = "[SECRET]", words: Iterable[str] = ()) -> DataFrame:
    """The documents with their secrets masked, n_chars (where there) brought up to date; other columns and null texts stay."""
    ranks = ranked(words)

    def each(batch: pa.RecordBatch):
        texts = [None if t is None else masked(t, min_log10, mask, ranks) for t in batch.column("text").to_pylist()]
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return arrow_map(documents, each, documents.schema)
