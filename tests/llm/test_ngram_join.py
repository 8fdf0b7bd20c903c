"""The join against all pairs, with regions of any size; components against a search."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import graph, ngram_join


def shingles(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent):
    ids = [d for d, _ in rows]
    sets = {d: shingles(t, k) for d, t in rows}
    low = {d: d for d in ids}
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {d: (len(sets[d]), low[d]) for d in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    common = [rng.choice(words) for _ in range(30)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 20, 60, 150]))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 4, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text).replace("w1", rng.choice(["w1", "W1"]))))
            n += 1
    chain = [rng.choice(words) for _ in range(120)]
    for _ in range(10):  # each links with the next, the first not with the last
        chain[rng.randrange(120)] = rng.choice(words)
        rows.append((n, "\n".join(chain)))
        n += 1
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A\tB "), (1005, "b a"), (1006, "w1 " * 3000), (1007, "  x y")]


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 5), (5, 80, 6), (4, 85, 7), (3, 60, 8)])
def test_against_all_pairs(spark, k, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, node int, root binary")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.component_table(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize(("chunk", "leaf"), [(4096, 32), (10, 2)])
def test_every_link_counts(spark, monkeypatch, chunk, leaf):
    monkeypatch.setattr(ngram_join, "CELL_NODES", chunk)  # cells dealt to several tasks
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    rng = random.Random(3)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    near = [(2000 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(20, 60)]  # all link with each other
    rows = corpus(9) + near + [(3000, near[0][1])]
    sets = [shingles(t, 4) for _, t in rows]
    want = {d: sum(i != j and bool(s) and bool(o) and 100 * len(s & o) >= 85 * len(s | o) for j, o in enumerate(sets)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in ngram_join.component_table(docs, 4, 85).collect()} == want
    assert min(want[d] for d, _ in near) == 40


def numbers(rng, groups, size=60):
    """Sets in groups of near copies, as sorted arrays."""
    out = []
    for _ in range(groups):
        base = rng.sample(range(4000), size)
        for _ in range(rng.choice([1, 3, 12])):
            s = set(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                s.discard(rng.choice(base))
                s.add(rng.randrange(4000))
            out.append(np.array(sorted(s), np.uint64))
    return out


@pytest.mark.parametrize("dense", [False, True])
def test_overlaps(dense, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    sets = numbers(random.Random(2), 4 if dense else 30)
    a, b = sets[::2], sets[1:]
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert ngram_join.overlaps(a, b).tolist() == want


def test_windows_carry_links_between_cells():
    """Links whose ends belong to different cells are found in the window of a cell, and lost without it."""
    sets = numbers(random.Random(4), 3)
    percent, n = 85, len(sets)
    size = np.array([len(s) for s in sets])
    inter = ngram_join.overlaps(sets, sets)
    want = {(x, y) for x in range(n) for y in range(n) if x != y and ngram_join._linked(inter[x, y], size[x], size[y], percent)}
    pivots = list(range(0, n, 3))
    d = ngram_join._distance(inter[:, pivots], size, size[pivots])
    cell, within = ngram_join.voronoi(d, 1 - percent / 100, np.arange(n))
    across = {(x, y) for x, y in want if cell[x] != cell[y]}
    assert across and all(within[y, cell[x]] for x, y in want)
    assert within.sum() < within.size
    found = {(x, int(y)) for j in range(len(pivots)) for x, ys in ngram_join.join_cell(sets, np.flatnonzero(cell == j), np.flatnonzero(within[:, j]), percent) for y in ys}
    assert found == want
    alone = {(x, int(y)) for j in range(len(pivots)) for x, ys in ngram_join.join_cell(sets, np.flatnonzero(cell == j), np.flatnonzero(cell == j), percent) for y in ys}
    assert alone == want - across


def test_cells_split_again(monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    sets = numbers(random.Random(6), 60)
    n, every = len(sets), np.arange(len(sets))
    size, inter = np.array([len(s) for s in sets]), ngram_join.overlaps(sets, sets)
    want = {(x, y) for x in range(n) for y in range(n) if x != y and ngram_join._linked(inter[x, y], size[x], size[y], 80)}
    assert {(x, int(y)) for x, ys in ngram_join.join_cell(sets, every, every, 80) for y in ys} == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z z"), (3, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.component_table(docs).collect()), key=str)
    assert got == [(1, 1), (1, 1), (3, 3), (None, 1), (None, None)]
    assert ngram_join.component_table(docs.limit(0)).collect() == []


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, "other words", None)], "doc_id long, text string, source string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keep_one_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (1, "quite another text of six words"), (None, "p q r s t u"), (None, "p q r s t u"), (None, None), (None, None), (7, ""), (7, "")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, (r.text or "").lower()) for r in kept)) == [(0, ""), (0, ""), (0, "p q r s t u"), (1, "a b c d e f"), (1, "quite another text of six words"), (7, ""), (7, "")]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, x) for x in range(201, 260)]
    low = {x: x for p in pairs for x in p}
    for _ in range(80):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in low.items() if x != r}


def test_few_links_go_to_few_files(spark, monkeypatch):
    files = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: files.append(len((out := cut(df)).inputFiles())) or out)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in graph.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(1, 301)}
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_overlaps_are_counted_in_small_parts():
    rng = np.random.default_rng(2)
    a, b = ([np.flatnonzero(row).astype(np.uint64) for row in rng.random((1000, 600)) < 0.1] for _ in range(2))
    tracemalloc.start()
    got = ngram_join.overlaps(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x, y = (np.array([np.isin(np.arange(600), s) for s in sets], np.int64) for sets in (a, b))
    assert (got == x @ y.T).all()
    assert peak < 100 << 20  # 6 million pairs of occurrences


def test_links_of_far_nodes_count(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 1e6)  # every region goes by rare shingles
    rows = corpus(9)
    sets = [shingles(t, 4) for _, t in rows]
    want = {d: sum(i != j and bool(s) and bool(o) and 100 * len(s & o) >= 85 * len(s | o) for j, o in enumerate(sets)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.component_table(docs, 4, 85).collect()}
    assert got == {d: (*v, want[d]) for d, v in brute(rows, 4, 85).items()}


@pytest.mark.parametrize("every", [True, False])
def test_far_nodes_are_not_copied_to_every_cell(spark, monkeypatch, every):
    """Short texts that chain by a common line, yet are far from each other: once each went to the cell of every pivot."""
    rng = random.Random(1)
    common = "all of these texts begin with one line"
    texts = [common + "".join(f" {rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(22)) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes, marks = ngram_join.node_table(docs, 5)
    names = [r.node for r in nodes.orderBy("doc_id").collect()]
    members = spark.createDataFrame([(b"r", bytes(node), len(shingles(t, 5)), 1, t) for node, t in zip(names, texts, strict=True)], "region binary, node binary, n long, copies long, text string")
    written = []
    monkeypatch.setattr(ngram_join, "_members", lambda *_: ngram_join.cut(members))
    cut = ngram_join.cut
    monkeypatch.setattr(ngram_join, "drop_cut", lambda df: written.append(df.where("cell IS NOT NULL").count()) if "cell" in df.columns else None)
    assert cut(ngram_join.met_links(docs, nodes, marks, 5, 80, every=every)).where("met > 0").count() == 0
    assert written[0] < 8 * len(texts)  # of 18 pivots


def test_tasks_of_a_cell_are_bounded_whatever_its_own_nodes(spark, monkeypatch):
    """A cell whose nodes are all its own, as those of a frequent rare shingle are: once each task had all of them."""
    for name, most in (("CELL_NODES", 40), ("OWN_NODES", 60), ("TASK_SHINGLES", 1500)):
        monkeypatch.setattr(ngram_join, name, most)
    rows = [(b"hot", i, 1, 10, b"", True) for i in range(400)] + [(b"part", i, 1, 10, b"", i < 30) for i in range(90)] + [(b"one", i, 1, 10, b"", i < 2) for i in range(5)]
    cells = spark.createDataFrame(rows, "cell binary, node long, copies long, n long, shingles binary, own boolean")
    cells = cells.selectExpr("*", "CAST(NULL AS BINARY) AS rare", "CAST(NULL AS BINARY) AS prefix", "false AS far")
    tasks = {}
    for r in ngram_join.dealt_cells(cells).collect():
        tasks.setdefault((bytes(r.cell), r.task), []).append(r)
    assert max(len(t) for t in tasks.values()) < 200 and len([c for c, _ in tasks if c == b"one"]) == 1
    met = sorted((c, x.node, y.node) for (c, _), t in tasks.items() for x in t if x.own for y in t if y.there)
    assert met == sorted((c, x[1], y[1]) for c in (b"hot", b"part", b"one") for x in rows if x[0] == c and x[5] for y in rows if y[0] == c)


@pytest.mark.parametrize("rare", [1.0, 1e6])
def test_links_of_dealt_cells_count(spark, monkeypatch, rare):
    for name, most in (("CELL_NODES", 3), ("OWN_NODES", 2), ("TASK_SHINGLES", 100), ("WRITTEN_SHINGLES", 50), ("RARE", rare), ("CHAINED", 4)):
        monkeypatch.setattr(ngram_join, name, most)
    rows = corpus(9)
    sets = [shingles(t, 4) for _, t in rows]
    want = {d: sum(i != j and bool(s) and bool(o) and 100 * len(s & o) >= 85 * len(s | o) for j, o in enumerate(sets)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.component_table(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {d: (*v, want[d]) for d, v in brute(rows, 4, 85).items()}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_comparisons_are_written_a_few_at_a_time():
    """1,000 copies of one text's shingles in the cells of 30 pivots: once they all were in memory at once."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[:200] + [f"x{i}y{j}" for j in range(200)]) for i in range(1000)]
    names = [ngram_join.digest_of(s) for s in ngram_join.Shingler(5).sets(texts)]
    n = len(texts)
    flat = pa.table({"region": pa.array([b"r"] * (n + 30)), "part": pa.array([0] * (n + 30)), "node": pa.array(names + names[:30]), "n": pa.array([396] * (n + 30)), "copies": pa.array([1] * (n + 30)), "text": pa.array(texts + texts[:30]), "own": pa.array([True] * n + [False] * 30), "rare": pa.array([False] * (n + 30))})
    batches = list(ngram_join._compare(5, 80, True, None)(iter(flat.to_batches(100))))
    assert sum(b.num_rows for b in batches) == (n - 30) * 30 + 30  # a pivot is far from the others
    assert max(b.nbytes for b in batches) < 4 << 20  # of 95 MB


def test_workers_get_few_rows_at_a_time(spark, monkeypatch):
    """A route's rows hold the parts of many texts each: a partition of them once came in one batch."""
    monkeypatch.setattr(ngram_join, "BATCH_ROWS", 50)
    monkeypatch.setattr(ngram_join, "ROUTE_ROWS", 7)
    seen = []
    for name in ("components", "cut"):
        real = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda df, name=name, real=real: seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or real(df))
    docs = spark.createDataFrame([(i, f"a b c d e f{i % 3} g h i j k l m n") for i in range(20)], "doc_id long, text string")
    assert ngram_join.component_table(docs).count() == 20
    assert [rows for name, rows in seen if name == "components"] == ["7", "50"]
    assert {rows for name, rows in seen if name == "cut"} == {"50"}
