"""Every stage of the pipeline on nulls, empties, repeats, ties, very long texts, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use or used.
CLASHING = "leaking_text item_id chunk bucket route region key score y x words part data local node root cosine".split()


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    plain = docs.orderBy("doc_id").limit(40)
    text = plain.first().text
    rows = [(9001, None), (9002, ""), (None, text), (9003, "the and of " * 60_000), (9004, text), (9004, text), (9005, f"{text} {item} {text}"), (9006, f"{text} {item} {text}"), (9007, " \n\t "), (9008, "password: hunter2hunter2 " + text)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    every = plain.unionByName(extra, allowMissingColumns=True)
    return every.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


def test_stages_keep_columns_and_take_odd_rows(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert len(rows) <= docs.count() and all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
        assert stage(spark, docs.limit(0), DATA).collect() == [] and stage(spark, docs.limit(0), DATA).columns == odd.columns, name
        docs = spark.createDataFrame(rows, odd.schema)
    encode = pipeline.STAGES[-1][1]
    got = encode(spark, odd, DATA).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (9001, 9002)} == {0}
    assert encode(spark, odd.limit(0), DATA).collect() == []


def test_near_copies_leave_one_and_repeated_rows_count_as_copies(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = dict(pipeline.STAGES)["ngram_jaccard_join"](spark, odd, DATA).collect()
    texts = [r.text for r in kept]
    assert sum(t is None for t in texts) == 1 and texts.count("") == 1  # texts without words are copies of nothing
    first = odd.where("doc_id < 9000").orderBy("doc_id").first().text
    assert texts.count(first) == 1


def test_passages_go_and_the_rest_stays(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = [r.doc_id for r in dict(pipeline.STAGES)["benchmark_decontamination"](spark, odd, DATA).collect()]
    assert not {9005, 9006} & set(kept) and {9001, 9002, 9003, 9007} <= set(kept) and kept.count(9004) in (0, 2)
