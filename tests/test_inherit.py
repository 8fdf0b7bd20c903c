"""Layered definitions, inheritance by doubling, and the reconciliation of parents."""

import random

from loomwork.operators import inherit
from loomwork.operators.ordinals import with_ordinals

LAYER = "name string, priority int, path string, entry int, using string, fields map<string,string>, pak string"


def test_layered_fields(spark):
    rows = [
        ("A", 1, "p", 0, "Base", {"f": "old", "g": "old-g", "h": "hidden"}, "one"),
        ("A", 3, "p", 0, "A", {"f": "new", "n": None}, "three"),
        ("A", 2, "q", 5, "Other", {"g": "mid", "f": "mid"}, "two"),
        ("B", 1, "p", 0, "B", {"x": "1"}, "one"),
        ("B", 1, "p", 1, "B", {"x": "2", "y": "3"}, "one-b"),
        ("C", 1, "p", 0, None, {}, "one"),
        ("D", 1, "p", 0, "D", None, "one"),
    ]
    heads, fields = inherit.layered_fields(spark.createDataFrame(rows, LAYER), "name", ["priority", "path", "entry"], "using", "fields", ["pak"])
    assert {r.name: (r.n_layers, r.using, r.pak) for r in heads.collect()} == {"A": (3, "Other", "three"), "B": (2, "", "one-b"), "C": (1, "", "one"), "D": (1, "", "one")}
    assert sorted(map(tuple, fields.collect())) == [("A", "f", "new", "three"), ("A", "g", "mid", "two"), ("A", "n", None, "three"), ("B", "x", "2", "one-b"), ("B", "y", "3", "one-b")]
    assert inherit.layered_fields(spark.createDataFrame([], LAYER), "name", ["priority"], "using", "fields")[1].collect() == []


def test_nearest_over_a_chain_of_ten_thousand_and_cycles(spark):
    n = 10_000
    rows = [(i, i - 1 if i else None, 7 if i == 0 else None) for i in range(n)]
    rows += [(n + 1, n + 2, None), (n + 2, n + 3, None), (n + 3, n + 1, None), (n + 4, n + 2, None)]  # a cycle and what hangs on it
    rows += [(n + 5, -9, None), (n + 6, n + 5, None), (n + 7, n + 7, None), (n + 8, n + 1, 3), (n + 9, n + 8, None)]
    got = {r.id: (r.depth, r.owner, r.value, r.ends) for r in inherit.nearest(spark.createDataFrame(rows, "id int, up int, v int"), "id", "up", "v").collect()}
    assert all(got[i] == (i, 0, 7, "value") for i in range(n))
    assert all(got[n + i] == (None, None, None, "cycle") for i in (1, 2, 3, 4))
    assert got[n + 5] == (1, None, None, "missing") and got[n + 6] == (2, None, None, "missing") and got[n + 7] == (0, None, None, "root")
    assert got[n + 8] == (0, n + 8, 3, "value") and got[n + 9] == (1, n + 8, 3, "value")
    assert inherit.nearest(spark.createDataFrame([], "id int, up int, v int"), "id", "up", "v").collect() == []


def walked(entities, fields):
    """Each entity by walking up and remembering what was met."""
    up, own = dict(entities), {}
    for e, f, v in fields:
        own.setdefault(e, {})[f] = v
    out, ends = [], {}
    for e in up:
        seen, at, depth, met = set(), e, 0, set()
        while True:
            seen.add(at)
            for f, v in own.get(at, {}).items():
                if f not in met:
                    met.add(f)
                    out.append((e, f, at, depth, v))
            nxt = up[at]
            if not nxt:
                ends[e] = "root"
            elif nxt in seen:
                ends[e] = "cycle"
            elif nxt not in up:
                ends[e] = "missing"
            else:
                at, depth = nxt, depth + 1
                continue
            break
    return sorted(out), ends


def test_inherited_fields_are_the_walked_ones(spark):
    rng = random.Random(8)
    for trial in range(3):
        names = [f"e{i}" for i in range(60)]
        entities = [(e, rng.choice([*names, "", None, "gone"])) for e in names]
        fields = [(e, f, f"{e}.{f}") for e in names for f in "abc" if rng.random() < 0.3]
        table, ends = inherit.inherited(spark.createDataFrame(entities, "entity string, using string"), spark.createDataFrame(fields, "entity string, field string, value string"), "entity", "using")
        want, how = walked(entities, fields)
        assert sorted(map(tuple, table.collect())) == want
        assert {r.entity: r.ends for r in ends.collect()} == how
        counts = inherit.inheritance_counts(ends, table).first()
        assert (counts.explicit_relations, counts.inherited_relations, counts.effective_entities) == (len(fields), len(want) - len(fields), 60)
        assert (counts.missing_parents, counts.cycles_detected) == tuple(list(how.values()).count(x) for x in ("missing", "cycle"))


DEF = "id string, name string, entity_type string, using string, fields map<string,string>, provider string, internal_path string"


def defined(spark, rows):
    return spark.createDataFrame([(i, n, t, u, {"f": f}, p, path) for i, n, t, u, f, p, path in rows], DEF)


def test_reconciliation(spark):
    at = lambda m: f"Public/{m}/Stats/x.txt"
    base = [("b1", "Base", "T", "", "1", "P1", at("A")), ("b2", "Base", "T", "", "2", "P2", at("B"))]
    kids = [
        ("same", "Kid", "T", "Base", "k", "P1", at("A")),
        ("amb", "Kid", "T", "Base", "k", "P3", at("A")),
        ("type", "Kid", "U", "Base", "k", "P3", at("A")),
        ("gone", "Kid", "T", "Nowhere", "k", "P3", at("A")),
        ("one", "Kid", "T", "Solo", "k", "P3", at("A")),
        ("eq", "Kid", "T", "Twin", "k", "P3", at("A")),
    ]
    more = [("s1", "Solo", "", "", "1", "P9", at("Z")), ("t1", "Twin", "T", "", "1", "P7", at("A")), ("t2", "Twin", "T", "", "1", "P8", at("B"))]
    self_named = [
        ("d0", "Dir", "T", "Dir", "0", "P1", at("A")), ("d1", "Dir", "T", "", "1", "P2", at("B")), ("d2", "Dir", "T", "", "2", "P3", at("C")),  # A needs B, B needs C
        ("x0", "Tra", "T", "Tra", "0", "P1", at("A")), ("x1", "Tra", "T", "", "1", "P3", at("C")),
        ("m0", "Many", "T", "Many", "0", "P1", at("A")), ("m1", "Many", "T", "", "1", "P2", at("B")), ("m2", "Many", "T", "", "2", "P2b", at("B")),
        ("u0", "Unp", "T", "Unp", "0", "P1", at("C")), ("u1", "Unp", "T", "", "1", "P2", at("A")),
        ("v0", "Unc", "T", "Unc", "0", "P1", at("C")), ("v1", "Unc", "T", "", "1", "P2", "Elsewhere/x"),
        ("w0", "NoM", "T", "NoM", "0", "P1", "Elsewhere/y"), ("w1", "NoM", "T", "", "1", "P2", at("A")),
        ("q0", "Equ", "T", "Equ", "0", "P1", at("C")), ("q1", "Equ", "T", "Equ", "0", "P2", at("A")),
    ]
    candidates = defined(spark, base + kids + self_named)
    support = defined(spark, [*more, ("b1", "Changed", "T", "", "9", "P1", at("A"))])
    modules = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "folder string, uuid string")
    direct = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    far = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "c", 1)], "start string, node string, depth int")
    edges = inherit.reconcile(candidates, support, modules, direct, far)
    got = {r.child_id: (r.status, r.selected_id) for r in edges.collect()}
    assert got == {
        "same": ("ResolvedSameProviderDefinition", "b1"),
        "amb": ("AmbiguousMultipleDefinitions", None),
        "type": ("InheritedReferenceMissingParent", None),
        "gone": ("InheritedReferenceMissingParent", None),
        "one": ("ResolvedUniqueCompatibleDefinition", "s1"),
        "eq": ("EquivalentProviderDefinition", None),
        "d0": ("ResolvedByDirectModuleDependency", "d1"),
        "x0": ("ResolvedByTransitiveModuleDependency", "x1"),
        "m0": ("AmbiguousMultiplePriorProviders", None),
        "u0": ("SupportedButRuntimeWinnerUnproven", None),
        "v0": ("MetadataDoesNotCoverProvider", None),
        "w0": ("MetadataDoesNotCoverProvider", None),
        "q0": ("EquivalentProviderDefinition", None),
        "q1": ("ResolvedByTransitiveModuleDependency", "q0"),
    }
    uid = lambda *rows: spark.createDataFrame(rows, "content_uid string")
    related = spark.createDataFrame([("amb", "h1"), ("amb", "h9"), ("u0", "h1"), ("u0", "h2"), ("m0", "h3"), ("same", "h4"), ("eq", "h5")], "edge_id string, content_uid string")
    verdicts = inherit.outcome(edges, related, uid(("h1",), ("h2",), ("h3",), ("h4",), ("h5",), ("h6",)), uid(("h6",), ("h8",)))
    assert {r.content_uid: r.verdict for r in verdicts.collect()} == {"h1": "hold", "h2": "warning", "h3": "warning", "h6": "hold"}
    assert tuple(inherit.outcome_counts(edges).first()) == (1, 4, 2, 1, 2)


def test_ordinals(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randrange(40), i % 50) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(5)
    got = with_ordinals(df, ["x", "y"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(1, 401))
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.n)] == sorted((x, y) for _, x, y in rows)
    from pyspark.sql import functions as F

    by = {}
    for r in with_ordinals(df, [F.desc("x"), "y"], "n", within=["g"], first=0).collect():
        by.setdefault(r.g, []).append((r.n, -r.x, r.y))
    for g, found in by.items():
        assert [n for n, *_ in sorted(found)] == list(range(len(found))) and [f[1:] for f in sorted(found)] == sorted((-x, y) for h, x, y in rows if h == g)
    few = with_ordinals(df.limit(2), ["x"], "n").collect()  # more partitions than rows
    assert sorted(r.n for r in few) == [1, 2] and with_ordinals(df.limit(0), ["x"], "n").collect() == []
    first, second = (sorted(map(tuple, with_ordinals(df, ["x"], "n", within=["g"]).collect()), key=str) for _ in range(2))
    assert first == second


def test_running_maxima_and_retry_delays(spark):
    from pyspark.sql import functions as F

    from loomwork.operators import pacing
    from loomwork.operators.ordinals import with_running_max

    rng = random.Random(6)
    rows = [(i, rng.choice(["w1", "w1", "w1", "w2", None]), rng.random() < 0.7, rng.choice([None, None, -1.0, 3.5, 900.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, worker string, retryable boolean, retry_after double").repartition(6)
    streaks, want = {}, {}
    for n, worker, again, asked in rows:
        streaks[worker] = streaks.get(worker, 0) + 1 if again else 0
        s = streaks[worker]
        want[n] = (s, 0.0 if not s else min(60.0, max(0.0, asked)) if asked is not None else min(60.0, 2.0 * 2 ** (s - 1)))
    assert {r.n: (r.streak, r.delay) for r in pacing.retry_delays(df, "worker", ["n"]).collect()} == want
    assert pacing.retry_delays(df.limit(0), "worker", ["n"]).collect() == []
    top, best = {}, {}
    for n, worker, again, asked in rows:
        top[worker] = max((x for x in (top.get(worker), asked) if x is not None), default=None)
        best[n] = top[worker]
    assert {r.n: r.top for r in with_running_max(df, ["n"], F.col("retry_after"), "top", within=["worker"]).collect()} == best


def test_a_cycle_ends_the_rounds(spark, monkeypatch):
    """Rounds end when nothing comes any more: once a cycle kept every round going until steps outnumbered the nodes."""
    nodes = [("a", "b"), ("b", "a"), *[(f"n{i}", f"n{i - 1}" if i else "a") for i in range(6)], *[(f"s{i}", "") for i in range(500)], ("lost", "gone"), ("under", "lost")]
    entities = spark.createDataFrame(nodes, "entity string, using string")
    fields = spark.createDataFrame([("b", "f", "v"), ("n2", "f", "w")], "entity string, field string, value string")
    calls, settled = [], inherit.settled
    monkeypatch.setattr(inherit, "settled", lambda df: calls.append(1) or settled(df))
    want = {k: "root" if k[0] == "s" else "missing" if k in ("lost", "under") else "cycle" for k, _ in nodes}
    assert dict(map(tuple, inherit.inheritance_end(entities, "entity", "using").collect())) == want
    assert len(calls) <= 5
    calls.clear()
    table, ends = inherit.inherited(entities, fields, "entity", "using")
    assert dict(map(tuple, ends.collect())) == want
    got = {r.entity: (r.owner, r.depth, r.value) for r in table.collect()}
    assert got == {"a": ("b", 1, "v"), "b": ("b", 0, "v"), "n0": ("b", 2, "v"), "n1": ("b", 3, "v"), **{f"n{i}": ("n2", i - 2, "w") for i in range(2, 6)}}
    assert len(calls) <= 12
