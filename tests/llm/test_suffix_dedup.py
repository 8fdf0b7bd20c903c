"""Suffix order and removed bytes against plain definitions."""

import hashlib
import random

import numpy as np
import pytest

from loomwork.llm import induced_sort, suffix_dedup


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_suffix_order(seed, budget):
    rng = random.Random(seed)
    letters = rng.choice([[1, 2], [1, 2, 3, 256], list(range(1, 257)), [7]])
    t = np.array([rng.choice([*letters, 0]) if rng.random() < 0.9 else 0 for _ in range(rng.choice([1, 2, 3, 50, 700]))], np.uint16)
    if seed % 3 == 0:
        t = np.concatenate([t] * 3)
    depth = 20
    got = induced_sort.suffix_order(t, depth, budget)
    assert sorted(got.tolist()) == list(range(len(t)))
    keys = [tuple(t[i : i + depth]) for i in got.tolist()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_equal_stretches(kind):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 2, 400).astype(kind)
    a, b, n = rng.integers(0, 370, 5000), rng.integers(0, 370, 5000), rng.integers(1, 30, 5000)
    want = [bool((t[x : x + k] == t[y : y + k]).all()) for x, y, k in zip(a, b, n, strict=True)]
    assert induced_sort.equal_stretches(t, a, b, n).tolist() == want
    assert 0 < sum(want) < 5000
    assert induced_sort.equal_stretches(t, a[:0], b[:0], n[:0]).tolist() == []


def brute(rows, width):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_against_definition(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    rng = random.Random(4)
    words = ["alpha", "beta", "gämma", "delta", "epsilon", "zeta", "eta", "the", "of"]
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    passage, common = line(40), line(14)
    rows = []
    for i in range(60):
        text = line(rng.choice([3, 15, 60]))
        kind = rng.randrange(6)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1:
            text = text + passage[rng.randrange(50) :] + line(5)
        elif kind == 2:
            text = "\n".join([text, common, line(9), common])
        elif kind == 3 and rows:
            near = list(rng.choice(rows)[1] or "x")
            near[rng.randrange(len(near))] = "#"
            text = "".join(near)
        rows.append((rng.randrange(10**6) * 100 + i, text))
    rows += [(5, None), (6, ""), (7, "a" * 400), (8, "ab" * 300), (9, "a" * 99), (10**12, "x" * 5000 + passage), (11, "a" * 100), (12, "\0" * 150)]
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, chunk int").repartition(5)
    got = sorted((tuple(r) for r in suffix_dedup.dedup(docs, keep_text=False).collect()), key=str)
    assert got == brute(rows, 100)


def test_repeated_and_null_ids_and_empty_tables(spark):
    text = "0123456789" * 11
    docs = spark.createDataFrame([(1, text + "a"), (1, text + "a"), (None, text + "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_removed, r.kept) for r in suffix_dedup.dedup(docs).collect()), key=str)
    # The first row by order is the one without an id; within it the period of ten repeats.
    assert [g[:2] for g in got] == [(1, 111), (1, 111), (2, 0), (None, 100)]
    assert suffix_dedup.dedup(docs.limit(0)).collect() == []


def test_many_routes_and_small_chunks(spark, monkeypatch):
    """Rows of a chunk are dealt to routes by one sort; chunks end by rows too."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 7)
    monkeypatch.setattr(suffix_dedup, "_routes", lambda _: 100_000)
    monkeypatch.setattr(suffix_dedup, "PARTITIONS", 8)
    base = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    rows = [(i, base[i * 5 : i * 5 + 300]) for i in range(40)] + [(100 + i, None) for i in range(20)] + [(200, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs).collect()}
    seen, want = set(), {}
    for d, t in rows:
        t, gone = t or "", set()
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(t[s : s + 100])
        want[d] = len(gone)
    assert got == want


def test_hashes_decide_nothing_in_a_shard(spark, monkeypatch):
    """All minimizer hashes equal: one shard, in which bytes alone tell strings apart."""
    plain = suffix_dedup.rolling
    monkeypatch.setattr(suffix_dedup, "rolling", lambda symbols, width: plain(symbols, width) & np.uint64(0))
    rng = random.Random(8)
    long = "".join(rng.choice("ab") for _ in range(20_000))
    rows = [(1, long), (2, long[500:900] + "c" + long[700:1200]), (3, "".join(rng.choice("ab") for _ in range(3000))), (4, "x" + long[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((*r,) for r in suffix_dedup.dedup(docs, keep_text=False).collect()), key=str)
    assert got == brute(rows, 100)
