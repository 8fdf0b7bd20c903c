"""Claims looked up in batch material, results kept by their inputs, counters observed."""

import pytest
from pyspark.sql import functions as F

from loomwork.sources import evidence, material


def rows(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("u"), "id").alias("content_uid"), F.concat(F.lit("Say {x} "), "id").alias("source_text"), F.when(F.col("id") % 4 < 2, "ui").otherwise("item").alias("primary_category"), F.lit("g").alias("canonical_group_key"), F.array(F.lit("k")).alias("context_group_keys"), F.concat(F.lit("b"), (F.col("id") % 4).cast("string")).alias("batch_id"))


def plan_of(spark, table):
    return table.groupBy("batch_id").agg(F.min("primary_category").alias("category"), F.count(F.lit(1)).alias("record_count"))


def test_claims_read_their_batches_alone(spark, tmp_path):
    path = str(tmp_path / "m")
    material.write(rows(spark), path)
    table = material.read(spark, path)
    plan = plan_of(spark, rows(spark)).cache()
    assert material.checked(table, plan).count() == 40
    claims = spark.createDataFrame([("u1", "b1", 2, "h"), ("u5", "b1", 1, "h"), ("u2", "b2", 1, "h")], "content_uid string, batch_id string, attempt_number int, input_hash string")
    got = material.requests(claims, table, plan)
    assert {r.content_uid: (r.batch_id, r.attempt_number, r.source_text, r.primary_category, r.context_group_keys, r.protected_tokens) for r in got.collect()} == {"u1": ("b1", 2, "Say {x} 1", "ui", ["k"], ["{x}"]), "u5": ("b1", 1, "Say {x} 5", "ui", ["k"], ["{x}"]), "u2": ("b2", 1, "Say {x} 2", "item", ["k"], ["{x}"])}
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    for bad, fault in ((("u1", "b9"), "not present in batch plan: b9"), (("u1", "b2"), "ContentUid u1 missing from material for b2"), (("u1", None), "not present"), ((None, "b1"), "missing from material")):
        with pytest.raises(Exception, match=fault):
            material.requests(spark.createDataFrame([(*bad, 1, "h")], claims.schema), table, plan).collect()
    again = table.unionByName(table.where("content_uid = 'u1'"))
    with pytest.raises(Exception, match="duplicate ContentUid: u1"):
        material.requests(claims, again, plan).collect()
    side = spark.createDataFrame([("u1", "near a door")], "content_uid string, context string")
    assert {r.content_uid: r.context for r in material.with_context(table.where("batch_id = 'b1'"), side).limit(40).collect() if r.content_uid in ("u1", "u5")} == {"u1": "near a door", "u5": ""}


def test_material_that_is_refused(spark):
    table = rows(spark)
    plan = plan_of(spark, table)
    for bad, said, fault in (
        (table.unionByName(table.where("content_uid = 'u1'")), plan, "record count mismatch for b1"),
        (table.withColumn("content_uid", F.when(F.col("content_uid") == "u5", "u1").otherwise(F.col("content_uid"))), plan, "duplicate ContentUid: u1"),
        (table.withColumn("content_uid", F.when(F.col("content_uid") == "u5", "").otherwise(F.col("content_uid"))), plan, "missing ContentUid in b1"),
        (table.withColumn("primary_category", F.when(F.col("content_uid") == "u5", "quest").otherwise(F.col("primary_category"))), plan, "category mismatch for b1"),
        (table, plan.where("batch_id <> 'b3'"), "not present in batch plan: b3"),
        (table.where("batch_id <> 'b3'"), plan, "batch material not found: b3"),
    ):
        with pytest.raises(ValueError, match=fault):
            material.checked(bad, said)


def test_digest_knows_rows_and_not_their_order(spark):
    df = rows(spark).withColumn("m", F.create_map(F.lit("a"), F.col("source_text"), F.lit("b"), F.lit(None).cast("string")))
    one = evidence.digest(df)
    assert one == evidence.digest(df.repartition(7).orderBy(F.desc("content_uid"))) and len(one) == 64
    assert one == evidence.digest(df.withColumn("m", F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.col("source_text"))))
    others = [df.limit(39), df.unionByName(df.limit(1)), df.withColumn("source_text", F.when(F.col("content_uid") == "u3", "x").otherwise(F.col("source_text"))), df.withColumnRenamed("m", "n")]
    assert len({one, *map(evidence.digest, others)}) == 5
    assert evidence.digest(df.limit(0)) == evidence.digest(df.where("false"))


def test_a_changed_input_rebuilds_its_part_alone(spark, tmp_path):
    path, built = str(tmp_path / "cache"), []
    left, right = rows(spark, 5), rows(spark, 9)

    def wanted(a, b):
        make = lambda name, df: lambda: built.append(name) or df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
        return {"a": ({"rows": a}, make("a", a)), "b": ({"rows": b, "rules": "hash-1"}, make("b", b))}

    first, made = evidence.parts(spark, path, wanted(left, right))
    assert made == ["a", "b"] == built and first["a"].agg(F.sum("n")).first()[0] == 5
    again, made = evidence.parts(spark, path, wanted(left.repartition(3), right))
    assert made == [] and built == ["a", "b"] and again["b"].agg(F.sum("n")).first()[0] == 9
    changed, made = evidence.parts(spark, path, wanted(left, right.unionByName(left)))
    assert made == ["b"] and changed["b"].agg(F.sum("n")).first()[0] == 14
    assert evidence.parts(spark, path, wanted(left, right), profile="other")[1] == ["a", "b"]
    for part in (tmp_path / "cache" / "a").rglob("*.parquet"):  # a stored result that was tampered with is made anew
        part.write_bytes(part.read_bytes()[:-20])
    mended, made = evidence.parts(spark, path, wanted(left, right))
    assert made == ["a"] and mended["a"].agg(F.sum("n")).first()[0] == 5


def test_counters_are_those_of_a_separate_aggregation(spark, tmp_path):
    df = rows(spark, 1000).repartition(6).withColumn("review", F.when(F.col("batch_id") == "b1", F.array())).withColumn("status", F.when(F.col("batch_id") == "b0", "pending").when(F.col("batch_id") == "b1", "odd"))
    counters = {**evidence.presence_counters({"withContext": "context_group_keys", "withReview": "review"}), **evidence.status_counters("status", ("pending", "running"))}
    jobs = []
    got = evidence.observed(df, lambda x: jobs.append(1) or x.write.parquet(str(tmp_path / "out")), counters)
    assert got == {k: v for k, v in df.agg(*[c.alias(n) for n, c in counters.items()]).first().asDict().items()}
    assert got == {"contentUidCount": 1000, "withContext": 1000, "withReview": 0, "pending": 250, "running": 0, "other": 750} and spark.read.parquet(str(tmp_path / "out")).count() == 1000
