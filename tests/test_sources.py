"""Readers, grammars and writers over small invented files."""

import pytest

from loomwork.sources import grammars, readers, writers

H = ["h0000000{}g0000g0000g0000g000000000000".format(i) for i in range(8)]


@pytest.fixture
def files(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "path string, value string")


def test_content_xml_round_trip(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f'<contentList><content contentuid="{H[0]}" version="2">  two &amp; </content><content contentuid="{H[1]}" version="1"></content></contentList>', encoding="utf-8")
    rows = readers.content_xml(spark, str(tmp_path / "a.xml"), "en")
    got = {r.contentUid: (r.text, r.version) for r in rows.collect()}
    assert got == {H[0]: ("  two & ", "2"), H[1]: ("", "1")}
    writers.content_xml(rows, str(tmp_path / "out"))
    again = {r.contentUid: (r.text, r.version) for r in readers.content_xml(spark, str(tmp_path / "out"), "en").collect()}
    assert again == got


def test_repeated_uid_is_an_error(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f'<c><content contentuid="{H[0]}">x</content><content contentuid="{H[0]}">y</content></c>')
    with pytest.raises(ValueError, match="contentUid"):
        readers.content_xml(spark, str(tmp_path / "a.xml"), "en")


def test_json_csv_and_listing(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"contentUid": "u1", "text": "x"}\n\n{"contentUid": "u2", "extra": 1}\n', encoding="utf-8")
    assert sorted(r.contentUid for r in readers.keyed(spark, str(tmp_path / "a.jsonl"), readers.RECORD).collect()) == ["u1", "u2"]
    (tmp_path / "b.csv").write_text('a,b\n"x ""q"" \n y",1\n,\n', encoding="utf-8")
    rows = readers.returned(spark, str(tmp_path / "b.csv"), ["a", "b"]).collect()
    assert [(r.a, r.b, r["__file__"]) for r in rows] == [('x "q" \n y', "1", "b.csv")]
    (tmp_path / "l.txt").write_text("a/b.txt\t12\tff\n")
    assert [tuple(r) for r in readers.listing(spark, str(tmp_path / "l.txt")).collect()] == [("a/b.txt", 12, "ff")]
    assert readers.vdf_pairs('"path"  "C:\\\\x"\n"Path" "d"') == {"path": "d"}


def test_stats_grammar(files):
    text = f'new entry "Base"\ntype "Spell"\ndata "Early" "{H[0]};1"\nusing "Root"\ndata "Name" "{H[1]};2"\ndata "Name" "{H[2]}"\n// {H[3]}\nnew entry "Kid"\ndata "Other" "plain"\n'
    f = files(("s.txt", text))
    got = [(r.entry, r.entity_type, r.using, r.field, r.content_uid) for r in grammars.stats_handles(f).orderBy("line").collect()]
    assert got == [("Base", "Spell", None, "Early", H[0]), ("Base", "Spell", "Root", "Name", H[1]), ("Base", "Spell", "Root", "Name", H[2])]
    nodes = {r.name: (r.entity_type, r.using, r.fields) for r in grammars.stats_definitions(f).collect()}
    assert nodes == {"Base": ("Spell", "Root", {"Early": f"{H[0]};1", "Name": H[2]}), "Kid": (None, None, {"Other": "plain"})}
    assert [r.content_uid for r in grammars.comment_handles(f).collect()] == [H[3]]


def test_handle_positions(files):
    got = sorted(map(tuple, grammars.handle_positions(files(("a", f"x {H[0]};3\n{H[1]}{H[0]} y"), ("b", None))).collect()))
    assert got == [("a", 1, 3, H[0])]


def test_trees(files):
    xml = f'<save><node id="Quest"><attribute id="Title" handle="{H[0]};1"/><node id="Step"><attribute id="D" handle="{H[1]}"/></node></node></save>'
    got = [(r.entity, r.attribute, r.content_uid) for r in grammars.xml_handles(files(("q", xml), ("bad", "<a>"))).collect()]
    assert got == [("Quest", "handle", H[0]), ("Step", "handle", H[1])]
    lsx = f'<r><node id="T"><attribute id="Name" value="Sword"/><attribute id="DisplayName" type="TranslatedString" handle="{H[2]};4"/><attribute id="Other" type="TranslatedString" handle="{H[3]}"/></node></r>'
    assert [tuple(r)[1:] for r in grammars.translated_strings(files(("l", lsx)), "Display.*").collect()] == [("Sword", "DisplayName", H[2])]
    assert [tuple(r)[1:] for r in grammars.markup_handles(files(("x", f'<Grid><Label Text="{H[4]}"/></Grid>'))).collect()] == [("Label", "Text", H[4])]
    dialog = f'{{"speakerlist": [{{"id": "s1"}}], "nodes": [{{"UUID": {{"value": "n1"}}, "TaggedTexts": [{{"text": "{H[5]}"}}]}}]}}'
    assert [(r.node_id, r.content_uid) for r in grammars.dialog_handles(files(("d", dialog), ("bad", "{"))).collect()] == [("n1", H[5])]
    assert [r.speaker for r in grammars.speakers(files(("d", dialog))).collect()] == ["s1"]
    meta = '<save><node id="root"><node id="Conflicts"><node id="M"><attribute id="UUID" value="no"/></node></node><node id="Dependencies"><node id="M"><attribute id="UUID" value="dep"/></node></node><node id="ModuleInfo"><attribute id="Folder" value="F"/><attribute id="UUID" value="me"/></node></node></save>'
    assert [tuple(r)[1:] for r in grammars.modules(files(("m", meta))).collect()] == [("F", "me", "dep")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("u1", ["a", "b"], "b1", None), ("u2", [], "b2", "x")], "uid string, tags array<string>, batch_id string, note string")
    writers.csv(rows, str(tmp_path / "csv"))
    assert sorted(r.tags or "" for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["", "a;b"]
    writers.json_lines(rows, str(tmp_path / "json"))
    assert any('"note":null' in p.read_text() for p in (tmp_path / "json").glob("part-*"))
    writers.batches(rows, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("batch_id=*")) == ["batch_id=b1", "batch_id=b2"]
    assert writers.report(rows.select("uid").orderBy("uid"), str(tmp_path / "r.json")) == {"uid": ["u1", "u2"]}


def test_item_states_stream(spark, tmp_path):
    from loomwork.streaming import attempts

    spark.createDataFrame([("a", "failed-retryable", 1), ("a", "succeeded", 2), ("b", "failed-retryable", 1), ("b", "failed-retryable", 2), ("b", "failed-retryable", 3), ("c", "running", 1), ("d", "succeeded", 9999)], "uid string, outcome string, s long").selectExpr("uid", "outcome", "timestamp_seconds(s) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uid string, outcome string, ts timestamp").parquet(str(tmp_path / "in"))
    got = {(r.uid, r.attempt_count, r.status, r.reason) for r in attempts.drain(attempts.item_states(stream), "update").collect()}
    want = {("a", 2, "succeeded", "attempt"), ("b", 3, "failed-final", "attempt"), ("c", 1, "running", "attempt"), ("d", 1, "succeeded", "attempt")}
    assert got == want | {("c", 1, "failed-retryable", "lease")}


def test_rows_are_numbered_by_file_over_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"a": "{name}{i}"}}\n' for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many splits of one file, many files in one task
    try:
        rows = readers.numbered(spark.read.schema("a string").json(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(r.a == f"{r['__file__'][0]}{r['__row__']}" for r in rows)
    (tmp_path / "d.csv").write_text('x,y\n1,"a\nb"\n,\n3,c\n')
    assert sorted((r["__row__"], r.x, r.y) for r in readers.returned(spark, str(tmp_path / "d.csv"), ["x", "y"]).collect()) == [(2, "1", "a\nb"), (4, "3", "c")]
    assert sorted((r["__row__"], r.a) for r in readers.returned(spark, str(tmp_path / "b.jsonl"), ["a"]).collect()) == [(1, "b1"), (2, "b2"), (3, "b3")]


def test_a_total_order_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(i * 37 % 101, f"t{i % 3}") for i in range(101)], "n int, t string").repartition(5)
    writers.json_lines(writers.in_order(rows, ["t", "n"]), str(tmp_path / "out"))
    import json

    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["ordinal"] for x in lines] == list(range(1, 102)) and [(x["t"], x["n"]) for x in lines] == sorted((r.t, r.n) for r in rows.collect())
