"""The driver's contract."""

import json
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from loomwork.plans.catalog import QUERIES

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_a_row_per_record(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 40 and {r.reuse_class for r in rows} <= {"none", "single", "consensus", "conflict"}


def test_without_the_training_data_subpackage():
    code = "import sys; sys.modules['loomwork.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), e.llm)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), "None"]


def test_bench_prints_one_line(monkeypatch, capsys, spark):
    import bench

    monkeypatch.setattr(bench, "HEADLINE", ["reuse_classes", "state_fold"])
    monkeypatch.setattr(bench, "session", lambda *a: spark)
    monkeypatch.setitem(os.environ, "BENCH_SF_DIR", "/root/testdata/sf0.001")
    bench.main()
    out = json.loads(capsys.readouterr().out)
    assert set(out) == {"metric", "value", "unit", "queries", "sf"} and set(out["queries"]) == {"reuse_classes", "state_fold"}
