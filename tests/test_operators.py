"""Truth tables, edge rows and fail-closed checks of operators."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import align, batch, classify, graph, inherit, merge, qa, rank, report, sets, state, transitions, validate
from loomwork.sources import writers


def column(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("status", "output", "present", "stale", "same", "route", "accepted", "want"),
    [
        ("pending", False, False, False, False, None, False, "WAITING_TRANSLATION/EXECUTION_PENDING"),
        ("running", True, True, False, True, "PASS", True, "WAITING_TRANSLATION/EXECUTION_RUNNING"),
        ("invalidated", True, True, False, True, "PASS", True, "WAITING_TRANSLATION/EXECUTION_INVALIDATED"),
        ("failed-retryable", False, False, False, False, None, False, "WAITING_RETRY/EXECUTION_FAILED_RETRYABLE"),
        ("failed-final", False, False, False, False, None, False, "BLOCKED/EXECUTION_FAILED_FINAL"),
        ("skipped", True, True, False, True, "PASS", True, "BLOCKED/EXECUTION_SKIPPED"),
        ("other", True, True, False, True, "PASS", True, "BLOCKED/EXECUTION_STATUS_UNKNOWN"),
        (None, True, True, False, True, "PASS", True, "BLOCKED/EXECUTION_STATUS_UNKNOWN"),
        ("succeeded", False, True, False, True, "PASS", True, "BLOCKED/SUCCEEDED_OUTPUT_MISSING"),
        ("succeeded", True, False, False, True, None, True, "BLOCKED/QA_RESULT_MISSING"),
        ("succeeded", True, True, True, True, "PASS", True, "BLOCKED/QA_RESULT_STALE"),
        ("succeeded", True, True, False, False, "PASS", True, "BLOCKED/QA_OUTPUT_MISMATCH"),
        ("succeeded", True, True, False, True, "PASS", False, "MERGE_READY/READY"),
        ("succeeded", True, True, False, True, "RETRY", False, "WAITING_RETRY/QA_RETRY"),
        ("succeeded", True, True, False, True, "REVIEW", True, "MERGE_READY/HUMAN_REVIEW_ACCEPTED"),
        ("succeeded", True, True, False, True, "REVIEW", False, "WAITING_REVIEW/QA_REVIEW"),
        ("succeeded", True, True, False, True, "FAIL", True, "BLOCKED/QA_FAIL"),
        ("succeeded", True, True, False, True, "ODD", True, "BLOCKED/QA_ROUTE_UNKNOWN"),
    ],
)
def test_disposition(spark, status, output, present, stale, same, route, accepted, want):
    lit = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v)
    assert column(spark, state.disposition(*map(lit, (status, output, present, stale, same, route, accepted)))) == want


def test_status_after(spark):
    after = lambda outcome, n: column(spark, state.status_after(F.lit(outcome), F.lit(n), 3))
    assert [after("succeeded", 9), after("running", 1), after("failed-retryable", 2), after("failed-retryable", 3), after("failed-final", 1)] == ["succeeded", "running", "failed-retryable", "failed-final", "failed-final"]


def test_qa_issues_and_routes(spark):
    rows = [
        (1, "dialogue_general", "Hello {name}, how are you today?", "Bonjour {name}, comment vas-tu ?"),
        (2, "dialogue_general", "Hello {name}", "  "),
        (3, "dialogue_general", "Take %1$s and {x}", "Prends %1$s"),
        (4, "bark", "Hello there friend", "Hello there friend"),
        (5, "ui", "Open the big door", "x"),
        (6, "ui", "Open the big door", "y" * 60),
        (7, "odd", "Hello there friend", "Hello there friend"),
        (8, "ui", "1234 5678", "1234 5678"),
        (9, "ui", "a {x} b", "a {x} {x} b"),
        (10, "quest", "Find the lost ring", "<LSTag Type='a'>Trouve</LSTag> cela"),
        (11, "quest", "Find the lost ring", "<LSTag>Trouve cela"),
        (12, "item", "Find the lost ring", "Trouve cela</LSTag>"),
        (13, "tutorial", "Find the lost ring", "<LSTag>Trouve</LSTag b> cela"),
        (14, "other", "Find the lost ring", "Trouve cela <LSTag Type"),
        (15, "other", "Find the lost ring", "Trouve < lstag Type='a' / > cela"),
        (16, "other", "Find the lost ring", "</LSTag>Trouve cela<LSTag>"),
    ]
    df = spark.createDataFrame(rows, "id int, category string, s string, t string")
    got = {r.id: (r.route, r.issues) for r in qa.evaluate(df, "category", "s", "t").collect()}
    assert got == {
        1: ("PASS", []),
        2: ("RETRY", ["OUTPUT_EMPTY", "PROTECTED_TOKEN_MISSING"]),
        3: ("RETRY", ["PROTECTED_TOKEN_MISSING"]),
        4: ("REVIEW", ["SOURCE_EQUALS_TARGET"]),
        5: ("REVIEW", ["LENGTH_RATIO_SUSPICIOUS"]),
        6: ("REVIEW", ["LENGTH_RATIO_SUSPICIOUS"]),
        7: ("FAIL", ["CATEGORY_RULE_MISSING"]),
        8: ("PASS", []),
        9: ("RETRY", ["PROTECTED_TOKEN_ADDED"]),
        10: ("PASS", []),
        11: ("RETRY", ["LSTAG_MALFORMED"]),
        12: ("RETRY", ["LSTAG_MALFORMED"]),
        13: ("RETRY", ["LSTAG_MALFORMED"]),
        14: ("RETRY", ["LSTAG_MALFORMED"]),
        15: ("PASS", []),
        16: ("RETRY", ["LSTAG_MALFORMED"]),
    }


def test_reuse_classes(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "z"), (5, "c", "z"), (10, "a", None), (11, "b", None), (12, "c", None), (13, "d", None)], "k int, text string, t string")
    got = {r.k: r.reuse_class for r in align.reuse_classes(rows, F.col("k") >= 10, "k", "text", "t").collect()}
    assert got == {10: "conflict", 11: "single", 12: "consensus", 13: "none"}


def test_text_expressions(spark):
    assert column(spark, T.protected_tokens(F.lit("a {x} %s %1$d {x} %%"))) == ["{x}", "%s", "%1$d", "{x}"]
    assert column(spark, T.protected_tokens(F.lit(None).cast("string"))) == []
    tokens = lambda *x: F.array(*map(F.lit, x))
    assert column(spark, T.multiset_minus(tokens("b", "a", "a"), tokens("a"))) == ["a", "b"]
    assert column(spark, T.stripped(F.lit("  a b　"))) == "a b"
    assert column(spark, T.percent(F.lit(1), F.lit(0))) == 0.0 and column(spark, T.percent(F.lit(1), F.lit(8))) == 12.5
    assert [column(spark, T.safe_relative(F.lit(p))) for p in ("a/b.txt", "/a", "a/../b", "..\\a", "C:\\a", "", "a..b/c")] == [True, False, False, False, False, False, True]
    assert column(spark, T.stem(F.lit("A\\B\\Name.LSX"))) == "name"
    assert column(spark, T.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})) == '{"a":null,"b":1}'
    assert [column(spark, T.retry_delay(F.lit(n))) for n in (1, 2, 6)] == [2.0, 4.0, 60.0] and column(spark, T.retry_delay(F.lit(1), F.lit(90.0))) == 60.0
    assert [column(spark, T.canonical_cell(F.lit(x))) for x in ("1.0", " True ", "1.50", None)] == ["1", "true", "1.50", ""]
    depth = column(spark, T.markup_state(F.lit("<p>a</p></p><p x='1'>"), "p"))
    assert (depth.depth, depth.lowest) == (0, -1)
    assert column(spark, T.candidate_id("BARK", F.lit("ABC"))) == column(spark, T.candidate_id("BARK", F.lit("abc")))


def test_next_fit(spark):
    rows = [("a", "g1")] * 3 + [("a", "g2")] * 3 + [("a", "g3")] * 2 + [("a", "g4")] * 7 + [("b", "g1")] * 5
    df = spark.createDataFrame([(i, c, g) for i, (c, g) in enumerate(rows)], "id int, category string, grp string")
    got = {r.id: (r.unit, r.batch_id) for r in batch.plan(df, "category", "grp", ["id"], {"a": 5, "b": 5}).collect()}
    units = sorted(set(got.values()))
    assert units == [("g1", "a-0001"), ("g1", "b-0001"), ("g2", "a-0002"), ("g3", "a-0002"), ("g4#part-0001", "a-0003"), ("g4#part-0002", "a-0004")]


def test_group_key(spark):
    key = lambda *c: column(spark, batch.group_key(F.array(*map(F.lit, c)).cast("array<string>"), F.lit("UID9")))
    assert [key(" B\\X ", "a/y"), key("", "  "), key()] == ["a/y", "uid:uid9", "uid:uid9"]


def test_closures(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "a string, b string")
    got = {(r.start, r.node): r.depth for r in graph.closure(edges, "a", "b").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2}
    nodes = spark.createDataFrame([(1, None, 5), (2, 1, None), (3, 2, None), (4, 99, None), (5, 6, None), (6, 5, None), (7, 2, 8)], "id int, up int, v int")
    found = {r.id: (r.depth, r.owner, r.value) for r in inherit.nearest(nodes, "id", "up", "v").collect()}
    assert {k: found[k][1:] for k in found} == {1: (1, 5), 2: (1, 5), 3: (1, 5), 4: (None, None), 5: (None, None), 6: (None, None), 7: (7, 8)}


def test_parents_and_precedence(spark):
    defs = spark.createDataFrame([("1", "Base", "T", None), ("2", "Base", "T", "Base"), ("3", "Kid", "T", "Base"), ("4", "Kid2", "U", "Base")], "id string, name string, entity_type string, using string")
    c = graph.parent_candidates(defs, defs)
    assert sorted(map(tuple, c.collect())) == [("2", "1"), ("3", "1"), ("3", "2")]
    assert [tuple(r) for r in graph.unique_parents(c).collect()] == [("2", "1")]


def test_sets_fail_closed(spark):
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert sorted(r.k for r in sets.boundary(keys(1, 2, 3), keys(2), "k").collect()) == [1, 3]
    with pytest.raises(ValueError, match="outside"):
        sets.boundary(keys(1), keys(2), "k")
    with pytest.raises(ValueError, match="repeated"):
        sets.require_unique(keys(1, 1), "k")
    with pytest.raises(ValueError, match="left-only: 1"):
        sets.require_equal_keys(keys(1, 2), keys(2), "k")


def test_decisions_fail_closed(spark):
    rows = spark.createDataFrame([(1, None, "unresolved"), (2, "item", "classified")], "k int, primary_category string, status string")
    decide = lambda *d: classify.overlay_decisions(rows, spark.createDataFrame(list(d), "k int, action string, category string"), "k")
    assert {r.k: (r.primary_category, r.status) for r in decide((1, "classify", "ui")).collect()} == {1: ("ui", "classified"), 2: ("item", "classified")}
    for bad in ((2, "classify", "ui"), (9, "exclude", None)):
        with pytest.raises(ValueError, match="decision"):
            decide(bad)


def test_reconcile(spark):
    rows = [(1, "revise", "a"), (1, "revise", "a"), (2, "revise", "a"), (2, "revise", "b"), (3, "revise", None), (4, "accept", None)]
    got = {r.k: (r.resolution, r.resolved_text) for r in merge.reconcile(spark.createDataFrame(rows, "k int, decision string, proposal string"), "k").collect()}
    assert got == {1: ("adopted", "a"), 2: ("conflict", None), 3: ("conflict", None), 4: ("unchanged", None)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, text string, t string")
    assert align.reuse_classes(empty, F.col("k") >= 10, "k", "text", "t").collect() == []
    assert rank.winner(empty, "text", [F.col("k")], ["k"]).collect() == []
    assert report.rollup(empty, "text", "t").collect() == []
    assert validate.missing(empty, empty, "k").collect() == []


def test_layered_merge(spark):
    rows = [("a", 3, None, False), ("a", 2, None, True), ("a", 1, 7, False), ("b", 2, 5, True), ("c", 2, None, False), ("c", 1, 9, True)]
    df = spark.createDataFrame(rows, "k string, layer int, v int, stop boolean")
    got = {r.k: (r.n_layers, r.merged_value) for r in rank.layered_merge(df, "k", [F.desc("layer")], "v", F.col("stop")).collect()}
    assert got == {"a": (2, None), "b": (1, 5), "c": (2, 9)}


def test_batch_input_order_and_lanes(spark):
    rows = [("U2", ["B\\x", ""], "classified", "ui"), ("u1", ["b/x"], "classified", "ui"), ("u3", ["a"], "classified", "other"), ("u4", None, "excluded", "ui"), ("u5", [], "unclassified", "other")]
    df = spark.createDataFrame(rows, "uid string, subkeys array<string>, status string, primary_category string")
    lanes = {r.uid: r.lane for r in batch.sort_out(df).collect()}
    assert lanes == {"U2": "eligible", "u1": "eligible", "u3": "unresolved", "u4": "excluded", "u5": "unresolved"}
    assert [r.uid for r in df.where("size(subkeys) > 0").orderBy(batch.record_key(F.col("subkeys"), F.col("uid"))).collect()] == ["u3", "u1", "U2"]


def test_batches_of_split_and_whole_groups(spark):
    rows = [(i, "c", "big") for i in range(23)] + [(100 + i, "c", "small") for i in range(4)] + [(200, "c", "tiny"), (300, "d", "big")]
    out = batch.plan(spark.createDataFrame(rows, "id int, category string, grp string"), "category", "grp", ["id"], {"c": 10, "d": 10}).collect()
    got = {r.id: (r.unit, r.batch_id) for r in out}
    assert len(out) == len(rows) and got[0] == ("big#part-0001", "c-0001") and got[10] == ("big#part-0002", "c-0002") and got[22] == ("big#part-0003", "c-0003")
    assert got[100] == ("small", "c-0003") and got[200] == ("tiny", "c-0003") and got[300] == ("big", "d-0001")


def test_forecast_and_cost_without_samples(spark):
    none = spark.createDataFrame([], "category string, prompt_tokens long, completion_tokens long")
    left = spark.createDataFrame([("a", 3), ("b", 1)], "category string, n_remaining long")
    assert report.forecast(none, left, "category").first().asDict() == {"status": "unavailable", "n_remaining": 4, "n_samples": 0, "prompt_tokens": None, "completion_tokens": None}
    assert report.forecast(none, left.limit(0), "category").first().prompt_tokens == 0
    some = spark.createDataFrame([("a", 10, 1)] * 10 + [("b", 50, 5)] * 2, "category string, prompt_tokens long, completion_tokens long")
    assert report.forecast(some, left, "category").first().prompt_tokens == round(3 * 10 + 200 / 12)
    tried = spark.createDataFrame([("p", "m", "succeeded", 1_000_000, 2_000_000, None), ("p", "m", "failed-final", 5, None, None), ("p", "n", "running", 1, 1, 2), ("q", "m", "succeeded", None, None, None)], "provider string, model string, outcome string, prompt_tokens long, completion_tokens long, total_tokens long")
    prices = spark.createDataFrame([("p", "m", "1.5", "0.25")], "provider string, model string, i string, o string").selectExpr("provider", "model", "cast(i as decimal(12,6)) input_per_million", "cast(o as decimal(12,6)) output_per_million")
    used = {(r.provider, r.model): (r.n_ended, r.n_known, r.n_priced, str(r.input_cost), str(r.output_cost)) for r in report.usage(tried, prices).collect()}
    assert used == {("p", "m"): (2, 2, 1, "1.500000000000", "0.500000000000"), ("q", "m"): (1, 0, 0, "None", "None")}
    assert report.cost_summary(report.usage(tried, prices)).first().cost_status == "partial"


def execution(spark, rows):
    states = spark.createDataFrame([(u, "b1", s, t, "i", h, None, a, n, w, None, None) for u, s, t, h, a, n, w in rows], "content_uid string, batch_id string, status string, translated_text string, input_hash string, output_hash string, last_successful_run_id string, last_attempt_id long, attempt_count int, lease_owner string, lease_expires_at timestamp, updated_at timestamp")
    attempts = spark.createDataFrame([(a, "r", u, "b1", n, "p", "m", None, None, "running", None, None, "i", None, None, None, None) for u, s, t, h, a, n, w in rows if s == "running"], "attempt_id long, run_id string, content_uid string, batch_id string, attempt_number int, provider string, model string, started_at timestamp, finished_at timestamp, outcome string, error_code string, error_message string, input_hash string, output_hash string, prompt_tokens long, completion_tokens long, total_tokens long")
    return states, attempts


def test_transitions_are_denied(spark):
    now = F.timestamp_seconds(F.lit(5))
    states, attempts = execution(spark, [("u1", "running", None, None, 7, 1, "w1"), ("u2", "succeeded", "x", "h", 8, 3, None), ("u3", "succeeded", None, None, 9, 1, None)])
    end = lambda a, w, tokens=1: spark.createDataFrame([(a, w, True, True, "T", "H", None, None, tokens, 1, 2)], "attempt_id long, worker_id string, succeeded boolean, retryable boolean, translated_text string, output_hash string, error_code string, error_message string, prompt_tokens long, completion_tokens long, total_tokens long")
    for results, fault in ((end(7, "w2"), "own lease for u1"), (end(99, "w1"), "unknown attempt"), (end(7, "w1", -1), "negative")):
        with pytest.raises(ValueError, match=fault):
            transitions.complete(states, attempts, results, now, 3)
    after, ended = transitions.complete(states, attempts, end(7, "w1"), now, 3)
    assert after.where("content_uid = 'u1'").first().output_hash == "H" and ended.first().outcome == "succeeded"
    uids = lambda *u: spark.createDataFrame([(x,) for x in u], "content_uid string")
    assert transitions.reopen(states, uids("u2"), now, 3).where("content_uid = 'u2'").first().status == "failed-final"
    for bad, fault in (("u1", "not succeeded"), ("u3", "no completed"), ("u4", "unknown")):
        with pytest.raises(ValueError, match=fault):
            transitions.reopen(states, uids(bad), now, 3)
    assert transitions.run_status(states) == "incomplete" and transitions.run_status(states.limit(1).withColumn("status", F.lit("invalidated"))) == "completed" and transitions.run_status(states.where("status = 'succeeded'")) == "completed"


def test_snapshot_is_replaced_by_what_reads_it(spark, tmp_path):
    path = str(tmp_path / "states")
    writers.replace_snapshot(spark.range(3), path)
    writers.replace_snapshot(writers.read_snapshot(spark, path).selectExpr("id + 10 AS id"), path)
    writers.drop_old_snapshots(spark, path)
    assert sorted(r.id for r in writers.read_snapshot(spark, path).collect()) == [10, 11, 12] and len(list((tmp_path / "states" / "data").iterdir())) == 1


def test_run_report_of_completed_transitions(spark):
    """What transitions write is what the report counts."""
    states = spark.createDataFrame([(f"u{i}", "b1", "pending", 0) for i in range(4)], "content_uid string, batch_id string, status string, attempt_count int")
    nothing = {"translated_text": "string", "input_hash": "string", "output_hash": "string", "last_successful_run_id": "string", "last_attempt_id": "bigint", "lease_owner": "string", "lease_expires_at": "timestamp", "updated_at": "timestamp"}
    states = states.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    attempts = spark.createDataFrame([], "attempt_id long, run_id string, content_uid string, batch_id string, attempt_number int, provider string, model string, started_at timestamp, finished_at timestamp, outcome string, error_code string, error_message string, input_hash string, output_hash string, prompt_tokens long, completion_tokens long, total_tokens long")
    at = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    run = {"run_id": "r1", "provider": "p", "model": "m", "status": "running"}
    states, attempts = transitions.claim(states, attempts, run, "w", 4, at(10), at(50), 2)
    states, attempts = states.cache(), attempts.cache()
    ended = attempts.select("attempt_id", F.lit("w").alias("worker_id"), (F.col("content_uid") < "u2").alias("succeeded"), (F.col("content_uid") == "u2").alias("retryable"), F.lit("t").alias("translated_text"), F.lit("h").alias("output_hash"), F.when(F.col("content_uid") == "u2", "HTTP_503").otherwise("HTTP_429").alias("error_code"), F.lit("e").alias("error_message"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"), F.lit(2).cast("long").alias("total_tokens"))
    states, attempts = transitions.complete(states, attempts, ended, at(40), 2)
    runs = spark.createDataFrame([("r1", "2024-01-01 00:00:00", None), ("r2", "2024-01-01 00:00:00", "2024-01-01 00:01:00"), ("r3", None, None)], "run_id string, s string, f string").select("run_id", F.col("s").cast("timestamp").alias("started_at"), F.col("f").cast("timestamp").alias("finished_at"))
    got = {r.run_id: r for r in report.runs(runs, attempts, "run_id").collect()}
    one = got["r1"]
    assert (one.n_attempts, one.n_succeeded, one.n_failed_retryable, one.n_failed_final, one.n_retries, one.n_http_429, one.n_http_5xx, one.n_transport) == (4, 2, 1, 1, 0, 1, 1, 0)
    assert one.mean_seconds == 30.0 and one.per_minute == 3.0  # two successes from the run's start to the last end, 40 s later
    assert got["r2"].n_attempts == 0 and got["r2"].per_minute == 0.0 and got["r3"].per_minute is None
    assert report.rates(attempts).first().failure_percent == 25.0
