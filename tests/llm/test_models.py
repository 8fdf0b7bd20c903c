"""Quality classifier, BPE, decontamination, secret scans and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from loomwork.llm import bpe, decontaminate, quality, secret_scan, textvec

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def labelled(spark, n=600):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ran", "tel", "mo", "sha", "per") for b in ("dor", "ni", "ket", "lum", "a", "ost")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.choice([8, 40, 200]))]
        text = [w + rng.choice(["###", "$$$", "!!"]) for w in text] if bad else text
        rows.append((i, " ".join(text), 7.0, 1))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(9001, None, 0.0, 1), (9002, "", 0.0, 1), (9003, "word " * 50_000, 0.0, 1), (9003, "word " * 50_000, 0.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int"), spark.createDataFrame([*labels, (9001, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    out = quality.classify(docs, labels).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.98 * len(held)
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels.repartition(3)).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in out) < 1e-6
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(600) if i % 4 and i % 3}


def test_quality_ignores_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    first, second = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert first == pytest.approx(second)


def test_quality_is_fitted_to_all_labels_in_parts(spark, monkeypatch):
    docs, labels = labelled(spark, 900)
    sizes = spark.sparkContext.accumulator(0)

    def counting(net, x, y, epochs, plain=quality.fit):
        sizes.add(len(y))
        return plain(net, x, y, epochs)

    monkeypatch.setattr(quality, "fit", counting)
    inputs = quality.cut(quality.with_inputs(docs, quality.word_vectors(docs)))
    net = quality.train(inputs, labels, part_rows=150)
    usable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(900))
    assert quality.ROUNDS * 0.7 * usable <= sizes.value <= quality.ROUNDS * 0.9 * usable  # all but those for the temperature, each round
    held = quality.score(inputs, net).where(quality.held_out() & (quality.F.col("doc_id") < 900)).collect()
    assert sum((r[quality.SCORE] >= 0.3) == bool(r.doc_id % 4) for r in held) >= 0.97 * len(held)
    two = labels.where("doc_id IN (1, 4)")
    assert all(0 <= r[quality.SCORE] <= 1 for r in quality.score(inputs, quality.train(inputs, two)).collect())


def test_quality_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {round(r.score, 6) for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 4000)
    rng = random.Random(5)
    pieces = ["the", " of", "Über", "😀", "  ", "\n", "\t", "'ll", "'x", "123", "##", "<|endoftext|>", "é", "​", "Ａ", "a" * 90, " ", "\r\n", "漢字"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(120))), 1) for i in range(200)]
    rows += [(1000, None, 1), (1001, "", 1), (None, "no id", 1), (1002, "ab" * 20_000 + " " * 3000, 1), (1003, "twice", 1), (1003, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    encoder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    want = []
    for d, t, _ in rows:
        ids = encoder.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert sorted(map(tuple, encoded.collect()), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.text) for r in bpe.decode(encoded, VOCABULARY).collect()), key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)
    assert bpe.encode(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).collect() == []


def test_words_of_columns():
    texts = ["Hello, WORLD ÉTÉ", None, "", "hello", "x" * 70 + ".y", "  ", "world été"]
    for column in (pa.array(texts), pa.array(["pad", *texts]).slice(1)):
        h, n = textvec.words(column)
        assert n.tolist() == [3, 0, 0, 1, 2, 0, 2]
        assert h[0] == h[3] and h[1] == h[6] and h[2] == h[7] and len(set(h.tolist())) == 5
    assert [s for s in textvec.slices(pa.array(texts), 20)][0][0] == 0 and sum(n for _, n in textvec.slices(pa.array(texts), 20)) == len(texts)


def longest_common(item, region, weight):
    table = np.zeros((len(item) + 1, len(region) + 1))
    for i, a in enumerate(item, 1):
        for j, b in enumerate(region, 1):
            table[i, j] = max(table[i - 1, j], table[i, j - 1], (table[i - 1, j - 1] + weight[i - 1]) if a == b else 0)
    return table[-1, -1] / sum(weight)


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        item, region, weight = rng.integers(0, 5, 12), rng.integers(0, 5, 30), rng.random(12)
        assert decontaminate.covered(item, region, weight)[0] == pytest.approx(longest_common(item, region, weight))


def test_leaks(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "sh", "ng", "l", "x")]
    common = ["the", "of", "and"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([12, 30, 60]))) for i in range(25)] + [(90, None), (91, "")]
    rows, truth = [], set()
    for d in range(400):
        body = text(rng.choice([20, 150, 400])).split()
        if d % 5 == 0:
            i = rng.randrange(25)
            piece = items[i][1].split()
            if d % 10 == 0:  # a paraphrase: one word in eight is another
                piece = [rng.choice(words) if rng.random() < 0.12 else w for w in piece]
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() for w in piece] if d % 15 == 0 else piece
            truth.add((d, i))
        rows.append((d, " ".join(body), 3))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "the of and " * 3000, 1), (0, rows[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got <= truth and len(got) >= 0.95 * len(truth)
    assert {x for x in truth if x[0] % 10} <= got  # word for word
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in got}
    assert decontaminate.leaks(docs.limit(0), benchmark).collect() == [] == decontaminate.leaks(docs, benchmark.limit(0)).collect()


def test_leaks_of_frequent_short_items(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "sh", "ng", "l", "x")]
    text = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    items = [text(15) for _ in range(3)]
    rows, truth = [], set()
    for d in range(300):
        body = text(rng.choice([60, 200]))
        if d % 3 == 0:  # in a third of the documents
            piece = list(items[0])
            if d % 6 == 0:
                piece[rng.randrange(15)] = "other"
            body[(at := rng.randrange(len(body))) : at] = piece
            truth.add((d, 0))
        elif d % 50 == 1:  # between repeats of one rare word
            body = [f"again{d}"] * 40 + items[1] + [f"again{d}"] * 40
            truth.add((d, 1))
        rows.append((d, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth and len(found) == len(truth) and all(r.covered >= 0.6 and r.cosine is not None for r in found)


def test_passages_as_pairs_of_blocks():
    rng = np.random.default_rng(2)
    idf = rng.random(decontaminate.BUCKETS).astype(np.float32)
    for trial in range(40):
        counts = rng.choice([0, 1, 15, 16, 17, 31, 32, 33, 48, 100, 300], rng.integers(0, 9)).astype(np.int64)
        bucket = rng.integers(0, [3, 60, 30_000][trial % 3], counts.sum())
        text, first, length = decontaminate.passages(counts)
        held = rng.random(decontaminate.BUCKETS) < 0.5
        want = np.stack(decontaminate._norms(bucket, idf[bucket], first, length, held))
        grid, last, *pair, of, where = decontaminate.grid_of(bucket, counts)
        got = np.zeros((2, len(of)))
        for at, *stretch in decontaminate._stretches(grid, last, *pair, most=5):
            got[:, at : at + 5] = decontaminate._norms_of(*stretch, np.append(idf * idf, np.float32(0)), held)
        order, plain = np.lexsort((where, of)), np.lexsort((first, text))
        assert of[order].tolist() == text[plain].tolist() and where[order].tolist() == first[plain].tolist()
        assert np.allclose(got[:, order], want[:, plain], rtol=1e-4, atol=1e-6)


def test_latent_space_is_fitted_to_every_passage(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(vocabulary[int(300 * rng.random() ** 3)] for _ in range(rng.choice([3, 20, 40, 130]))) for _ in range(2500)]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(3)
    items = [textvec.words(pa.array([" ".join(rng.choice(vocabulary) for _ in range(25))]))[0] for _ in range(4)]
    streams = decontaminate.packed(documents)
    seen, n, n_words, n_passages = decontaminate.frequencies(streams)
    numbers = lambda h: (h % np.uint64(decontaminate.BUCKETS)).astype(int)
    columns = np.unique(numbers(textvec.words(pa.array([" ".join(vocabulary)]))[0]))
    rows, weights = [], []
    idf = np.log((n + 1) / (seen + 0.5)).clip(0.01).astype(np.float32)
    for h, w in [(textvec.words(pa.array([t]))[0], 1.0) for t in texts] + [(h, 7.0) for h in items]:
        for _, first, length in zip(*decontaminate.passages(np.array([len(h)])), strict=True):
            counts = np.bincount(np.searchsorted(columns, numbers(h[first : first + length])), minlength=len(columns)) * idf[columns]
            rows.append(counts / np.linalg.norm(counts) * w)
            weights.append(w)
    assert (n, n_words, n_passages) == (2502, sum(len(t.split()) for t in texts), weights.count(1.0))
    assert seen.sum() == sum(len(set(numbers(textvec.words(pa.array([t]))[0]).tolist())) for t in texts)
    a = np.array(rows)
    basis = decontaminate.latent_basis(streams, items, 7.0, idf, 2, dim=8)[columns]
    x = decontaminate._start(8)[columns].astype(float)
    for _ in range(decontaminate.POWER):
        x = np.linalg.qr(a.T @ (a @ x))[0]
    # The same space but for the words with next to no part in it.
    kept = np.linalg.norm(basis, axis=1) > 0
    assert np.allclose((basis @ basis.T)[np.ix_(kept, kept)], (x @ x.T)[np.ix_(kept, kept)], atol=2e-3) and (x[kept] ** 2).sum() >= 0.94 * 8


def test_fit_holds_one_matrix_at_a_time():
    n, dim = decontaminate.BUCKETS, decontaminate.DIM
    rng = np.random.default_rng(4)
    x, idf = rng.normal(size=(n, dim)).astype(np.float16), rng.random(n).astype(np.float32)
    peaks, got = [], []
    for make in (lambda: decontaminate._start(dim), lambda: decontaminate._weighted(x, idf)):
        tracemalloc.start()
        got.append(make())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (got[0] == np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32) / np.float32(n**0.5)).all()
    assert (got[1][:-1] == x.astype(np.float32) * idf[:, None]).all() and not got[1][-1].any()
    assert max(peaks) < 1.5 * 4 * n * dim


def test_keep_clean_tells_rows_apart_by_text(spark):
    item = " ".join(f"word{i}" for i in range(20))
    rows = [(None, f"before {item} after"), (None, "clean one"), (1, f"some {item} more"), (1, "clean two"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(7)
    pieces = ["password", "TOKEN", "api_key", "Api", "Key", "secret", '"', " ", ":", "=", "= ", "abcdef", "x1", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789ab", "\n", "é", "😀", "pwd", "kT9$vQz7!mWp2", "letmein"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40))), "c") for i in range(400)]
    rows += [(1000, None, "c"), (1001, "", "c"), (None, "token: abcdef", "c"), (1002, "token=" + "a" * 200_000, "c"), (1003, "ſecret=abcdefg K", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.digest(docs).collect()), key=str)
    want = []
    for d, t, _ in rows:
        found = base_secrets(t or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.append((d, *[sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert secret_scan.digest(docs.limit(0)).collect() == []


def plain_cost(value, ranks):
    """The cheapest segmentation, every stretch tried as a segment of every kind."""
    low, n, per_char = value.lower(), len(value), secret_scan._alphabet(value)
    plain = low.translate(secret_scan.LEET)

    def costs(i, j):
        k, piece = j - i, value[i:j]
        if k == 1:
            yield per_char - 0.3
        if k >= 3:
            if len(set(piece)) == 1:
                yield per_char + math.log10(k)
            if any(all(ord(y) - ord(x) == step for x, y in zip(piece, piece[1:], strict=False)) for step in (1, -1)):
                yield 1.0 + math.log10(k)
            if all(pair in secret_scan._BESIDE for pair in zip(low[i:j], low[i + 1 : j], strict=False)):
                yield 1.7 + 0.5 * math.log10(k) + 0.3 * (k - 1) ** 0.5
            word = low[i:j]
            if word in ranks:
                yield ranks[word] + 0.3 * (piece != word)
            elif plain[i:j] in ranks:
                yield ranks[plain[i:j]] + 0.6 + 0.3 * (piece != word)
        for p in range(2, min(secret_scan.PERIODS, k // 2) + 1):
            if all(piece[x] == piece[x - p] for x in range(p, k)):
                yield p * per_char + math.log10(k / p + 1)
        if (m := secret_scan._DATE.fullmatch(piece)) and secret_scan._DATE.match(value, i).end() == j:
            yield secret_scan._DATE_COST[len(m[0]) > 4]

    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = min((best[i] + c + 0.3 for i in range(j) for c in costs(i, j)), default=math.inf)
    return best[n]


def test_guess_costs_are_minimal():
    rng, ranks = random.Random(12), secret_scan.ranked(["aab", "were", "poiu", "abca", "cdefg", "zzz"])
    pieces = ["aaa", "aaaa", "b", "abc", "bcdefg", "qwert", "tyuiop", "were", "password", "P4ssw0rd", "2024", "20240131", "x9#", "abcabc", "zz", "k2k2k2", "987"]
    for _ in range(400):
        value = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        assert abs(secret_scan.guess_cost(value, ranks) - plain_cost(value, ranks)) < 1e-9, value
    began = time.time()
    secret_scan.guess_cost("a" * 100_000, ranks)
    secret_scan.find("password=Xk29ssmQ pass: abcdef, " * 5000)
    assert time.time() - began < 40


def test_guess_costs():
    cost = secret_scan.guess_cost
    assert cost("") == 0 and cost("password") < 2 and cost("qwertyuiop") < 4.5 and cost("aaaaaaaaaaaa") < 4 and cost("19991231") < 6 and cost("abcdefgh") < 3
    assert cost("P@ssw0rd") < 4 < cost("kT9$vQz7!mWp2") and cost("kT9$vQz7!mWp2") > 15
    assert cost("passwordqwerty1999") < 10 < cost("zk3Jd92LqPw0Xv")
    spans = lambda text: secret_scan.joined(secret_scan.find(text))
    assert spans("pwd: kT9$vQz7!mWp2") == "guess:5:18" and spans("pwd: password123") == ""


def test_values_longer_than_their_base_span():
    text = 'a password: Tr0ub4d&or#3x! b "token": "Zx81mQ%pl9vvK" c secret=abcdef$5 d'
    assert secret_scan.joined(secret_scan.find("password: Tr0ub4d&or#3x!")) == "assign:0:17,guess:10:24"
    assert secret_scan.joined(secret_scan.find("password: Tr0ub4dor3x")) == "assign:0:21"
    assert secret_scan.masked(text) == 'a [SECRET] b "[SECRET]" c [SECRET] d'


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", 18, "s"), (2, None, None, "s"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, source string")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a [SECRET] b", 12, "s"), (2, None, None, "s"), (3, "clean", 5, None)]


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "byte_level_bpe"] and corpus_pipeline.ORACLE_SQL is None
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        assert out.count() <= kept.count()
        kept = out
    final = corpus_pipeline.run(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    encoder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.decoded) for r in final.collect()}
    assert got == {d: (len(encoder.encode_ordinary(t)), t) for d, t in texts.items()} and 0 < len(got) < docs.count()
    assert not any(secret_scan.find(t) for t in texts.values())
