"""Tokenizer alignment, language identification and phrases against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import language, phrases, token_align
from loomwork.llm.common import table

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a  b", " lead  x ", "trail  ", "   ", " ", "a▁b", "x\ty \n z", "\x00 a", "<|endoftext|> <s> hi </s>", "日本語 テキスト 😀👍🏽 é́", "a" * 300 + " " + "b" * 70, "    x　y ᠎ z \x1c q", "don't we'll  I'M", "12345 678  90%", " \n\n  a", "end \n ", "ﬁ ﬂ Ⅷ ½"]


def given(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


# Tokenizer alignment


def plain_alignment(rows):
    """Each overlap by comparing ranges, each group by walking the shared ends."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte = token_align._byte_alphabet()
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a_side.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in range(b_side.get_piece_size()) for p in [b_side.id_to_piece(i)]]
    out, counts = [], Counter()
    for doc_id, text in rows:
        ids = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ((), ())
        parts = [[a_bytes[i] for i in ids[0]], [b_bytes[i] for i in ids[1]]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            out.append((doc_id, 0, 0, "", 0, []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links, first = [], 0
        for i, end in zip(ids[0], ends[0], strict=True):
            start = ends[0][ends[0].index(end) - 1] if ends[0].index(end) else 0
            while ends[1][first] <= start:
                first += 1
            at = first
            while at < len(ends[1]) and (ends[1][at - 1] if at else 0) < end:
                links.append((i, ids[1][at]))
                at += 1
        groups, done = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            stop = [e.index(end) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, ids[k][done[k] : stop[k]])) for k in (0, 1)))
            done = stop
        counts.update(links)
        out.append((doc_id, len(ids[0]), len(ids[1]), hashlib.sha256(";".join(groups).encode()).hexdigest(), len(groups), links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((d, a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, h, g, x in out), key=str)


def aligned(df):
    return sorted(map(tuple, token_align.align(df, A, B).collect()), key=str)


def test_alignment_is_the_plain_one(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    odd = [(10_000 + i, t) for i, t in enumerate(ODD)] * 2 + [(None, "no id")]
    docs = docs.unionByName(given(spark, odd, "doc_id long, text string"))
    assert aligned(docs) == plain_alignment([tuple(r) for r in docs.collect()])


def test_alignment_of_a_long_text_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK", 7)
    monkeypatch.setattr(token_align, "GROUP_TOKENS", 50)
    monkeypatch.setattr(token_align, "KEPT_WORDS", 40)
    monkeypatch.setattr(token_align, "TEXT_BYTES", 900)  # long texts are encoded in pieces
    text = " ".join(r.text for r in table(spark, DATA, "documents").limit(20).collect())
    rows = [(1, text), (2, "日本語" * 200), (3, "short one"), (4, None), (5, "seven tokens of a word or so and"), (6, "a b c d e f"), (7, "ab" * 8)]
    assert aligned(given(spark, rows, "doc_id long, text string")) == plain_alignment(rows)


def test_alignment_ignores_other_columns_and_takes_empty_tables(spark):
    rows = [(1, "some text", 5, "x", 9)]
    docs = given(spark, rows, "doc_id long, text string, key int, chunk string, n_a int")
    assert aligned(docs) == plain_alignment([(1, "some text")])
    assert aligned(docs.limit(0)) == []


def test_alignment_counts_pairs_over_the_corpus(spark):
    docs = given(spark, [(1, "the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    counts = token_align.pair_counts(token_align._swept(docs, A, B)).collect()
    assert sorted(r["count"] for r in counts) == [1, 1, 2] and all(r.best for r in counts)


# Language identification


def words_of(lang, rng, n):
    stems = {"xx": ["dorn", "kelt", "marn", "vost"], "yy": ["iulu", "aeo", "oua", "eia"]}[lang]
    return " ".join(rng.choice(stems) for _ in range(n))


def test_language_learns_from_text_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(i, words_of(lang, rng, 30), lang) for i in range(240) for lang in ["xx" if i % 2 else "yy"]]
    docs = given(spark, rows)
    net = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    # What the held-out fold and other columns say changes nothing.
    lied = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).withColumn("rank", F.lit(1))
    again = {r.doc_id: r for r in language.identify(lied.repartition(5)).collect()}
    assert {i: (r.lang_pred, r.score) for i, r in again.items()} == {i: (r.lang_pred, r.score) for i, r in got.items()}
    found = {r.doc_id: r.spans for r in language.spans(given(spark, [(1, words_of("xx", rng, 40) + " " + words_of("yy", rng, 40), None), (2, None, None), (3, "", None)]), net).collect()}
    assert found[2] == found[3] == [] and found[1][0].start == 0 and all(a.end == b.start for a, b in zip(found[1], found[1][1:]))
    assert {found[1][0].lang, found[1][-1].lang} == {"xx", "yy"}


def test_language_of_odd_texts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, words_of("xx", rng, 12), "xx") for i in range(30)] + [(i, words_of("yy", rng, 12), "yy") for i in range(30, 60)]
    odd = [(100, None, "xx"), (101, "", "yy"), (102, "12 34 !?", "xx"), (103, "a", None), (104, words_of("xx", rng, 60_000), None), (None, "kelt", None), (103, "a", None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in language.identify(given(spark, rows + odd)).collect()))
    assert len(got) == 67
    by = {g[1]: g for g in got if not g[0]}
    assert all(by[i][2:] == ("und", 0.0) for i in (100, 101, 102))
    assert by[104][2] == "xx" and by[103][2] in ("xx", "yy")
    assert language.identify(given(spark, [])).collect() == []
    assert [tuple(r)[2:] for r in language.identify(given(spark, [(1, "kelt", None)])).collect()] == [("und", 0.0)]
    assert [r.lang_pred for r in language.identify(given(spark, [(i, "kelt", "xx") for i in range(9)])).collect()] == ["xx"] * 9


def test_backpropagation_is_the_derivative():
    rng = np.random.default_rng(1)
    cell = language.Cell.new(rng)
    cell = language.Cell([t.astype(float) for t in cell.tables], [s.astype(float) for s in cell.states])
    x, weight = rng.integers(0, 5, (6, 3)), rng.normal(size=(6, 3, language.HIDDEN))

    def run():
        h, states, kept = np.zeros((3, language.HIDDEN)), np.empty((6, 3, language.HIDDEN)), [None] * 6
        for t in range(6):
            h, kept[t] = cell.step(x[t], h)
            states[t] = h
        return states, kept

    states, kept = run()
    grads = language._gradients(cell, x, range(6), states, kept, weight)
    for k, part in enumerate([*cell.tables, *cell.states]):
        for _ in range(4):
            i, j = (int(x[2, 1]) if k < 3 else int(rng.integers(part.shape[0]))), int(rng.integers(part.shape[1]))
            old, sums = part[i, j], []
            for step in (1e-6, -1e-6):
                part[i, j] = old + step
                sums.append(float((run()[0] * weight).sum()))
            part[i, j] = old
            assert grads[k][i, j] == pytest.approx((sums[0] - sums[1]) / 2e-6, rel=1e-3, abs=1e-4)


def test_language_of_the_table_is_learnt(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


# Phrases


def plain_phrases(rows, least=10, top=2000, longest=3):
    f, n = [Counter() for _ in range(longest + 1)], Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[k].update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    held, kept = Counter(), {}
    for k in range(2, longest + 1):
        for (lang, w), a in f[k].items():
            for m in range(2, k):
                for i in range(k - m + 1):
                    held[lang, w[i : i + m]] = max(held[lang, w[i : i + m]], a if a >= least else 0)
    for k in range(2, longest + 1):
        for (lang, w), a in f[k].items():
            if a < least or held[lang, w] and 100 * held[lang, w] >= 50 * a:
                continue
            score, cut = min((10**6 * a * a // (f[c][lang, w[:c]] * f[k - c][lang, w[c:]]), c) for c in range(1, k))
            kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[cut][lang, w[:cut]], f[k - cut][lang, w[cut:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in kept.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def mined(df, **more):
    return sorted(map(tuple, phrases.phrases(df, **more).collect()))


def test_phrases_are_the_plain_ones(spark, monkeypatch):
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang")
    odd = [(1, None, "en"), (2, "", None), (3, "Áb ab\tAB. a b c, a b c; a b c\x0bq " * 30, None), (4, ".,;:!?", "en"), (4, "x  y\x00 é x y\x00 é " * 15, "zz"), (5, "x y z " * 20, "und")]
    docs = docs.unionByName(given(spark, [(i, t, lang) for i, t, lang in odd])).withColumn("word", F.lit("w")).withColumn("chunk", F.lit(1))
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()])
    assert want and mined(docs) == want
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 200)  # many chunks, long texts cut where pieces end
    monkeypatch.setattr(phrases, "WAITING_BYTES", 500)
    assert mined(docs.repartition(3)) == want


def test_phrases_longer_and_all_of_them(spark):
    rows = [(i, "one two three four five. one two three four, two three. Four five six", "en" if i % 3 else None) for i in range(40)]
    docs = given(spark, rows)
    want = plain_phrases([(r[2], r[1]) for r in rows], least=12, top=10**9, longest=4)
    assert mined(docs, least=12, top=None, longest=4) == want == mined(docs, least=12, top=50, longest=4)
    assert [r[1] for r in mined(docs, least=12, top=1, longest=4)] == [1, 1]


def test_phrases_of_empty_tables(spark):
    assert mined(given(spark, [])) == []
    assert mined(given(spark, [(1, None, None), (2, "only a few words", "en")])) == []


def test_phrase_scores_past_64_bits(spark):
    big = 3 * 10**12
    words = given(spark, [("en", b"a", big, b"\x00" * 4 + b"\x01"), ("en", b"b", big + 7, b"\x00" * 4 + b"\x02")], "lang string, word binary, f long, key binary")
    found = {1: words.select("key", "f"), 2: given(spark, [(b"\x00" * 4 + b"\x01" + b"\x00" * 4 + b"\x02", big - 5)], "key binary, f long")}
    [row] = phrases._ranked(found, words, given(spark, [("en", 9)], "lang string, total long"), 2, 50, 10).collect()
    assert row.score == 10**6 * (big - 5) ** 2 // (big * (big + 7))
