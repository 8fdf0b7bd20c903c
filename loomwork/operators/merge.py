"""Accepted text into a baseline, and checks of what comes out."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(baseline: DataFrame, accepted: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer merge: updated, appended, unchanged and kept rows; an equal edit changes nothing."""
    b, a = baseline.select(key, F.col(value).alias("_old")), accepted.select(key, F.col(value).alias("_new"))
    action = F.when(F.col("_old").isNull(), "append").when(F.col("_new").isNull(), "keep").when(F.col("_new") != F.col("_old"), "update").otherwise("unchanged")
    return b.join(a, key, "full").select(key, F.coalesce("_new", "_old").alias(value), action.alias("action"))


def checks(baseline: DataFrame, accepted: DataFrame, merged: DataFrame, key: str, value: str) -> DataFrame:
    """One row of counts that must be zero: keys lost, edits missing, rows changed without an edit."""
    m = merged.select(key, F.col(value).alias("_m"))
    b, a = baseline.select(key, F.col(value).alias("_b")), accepted.select(key, F.col(value).alias("_a"))
    every = m.join(b, key, "full").join(a, key, "full")
    return every.agg(
        F.count_if(F.col("_m").isNull() & F.col("_b").isNotNull()).alias("n_lost"),
        F.count_if(F.col("_a").isNotNull() & ~F.col("_m").eqNullSafe(F.col("_a"))).alias("n_edit_missing"),
        F.count_if(F.col("_a").isNull() & ~F.col("_m").eqNullSafe(F.col("_b"))).alias("n_foreign_change"),
        F.count_if(F.col("_a").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_changed"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def bridge(ready: DataFrame, target: DataFrame, source: DataFrame, key: str, version: str) -> DataFrame:
    """Ready rows with a version: the target's, else the source's; rows without either are missing."""
    t, s = target.select(key, F.col(version).alias("_t")), source.select(key, F.col(version).alias("_s"))
    origin = F.when(F.col("_t").isNotNull(), "target").when(F.col("_s").isNotNull(), "source").otherwise("missing")
    return ready.join(t, key, "left").join(s, key, "left").withColumn(version, F.coalesce("_t", "_s")).withColumn("version_from", origin).drop("_t", "_s")


def digest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SHA-256 over "key<TAB>text" lines in key order, and the number of rows.

    The ordered text is one value by definition, so this is for snapshots that fit one; hash rows first for larger ones.
    """
    line = F.concat_ws("\t", F.col(key).cast("string"), F.col(text))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(lines, 256).alias("snapshot_sha256"))


def reconcile(reviews: DataFrame, key: str) -> DataFrame:
    """Per key: conflict where a revision lacks text or proposals differ, adopted with exactly one, unchanged with none."""
    revise = F.col("decision") == "revise"
    agg = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(revise & F.col("proposal").isNull()).alias("_blank"), F.count_distinct(F.when(revise, F.col("proposal"))).alias("n_proposals"), F.min(F.when(revise, F.col("proposal"))).alias("_one"))
    resolution = F.when((F.col("_blank") > 0) | (F.col("n_proposals") > 1), "conflict").when(F.col("n_proposals") == 1, "adopted").otherwise("unchanged")
    return agg.select(key, "n_reviews", "n_proposals", resolution.alias("resolution"), F.when(resolution == "adopted", F.col("_one")).alias("resolved_text"))


def framed_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """n_rows, inventory_sha256: SHA-256 over every cell in the order of the first column, each after its length in eight bytes, then the number of rows.

    Such a chain is sequential by definition: sorted rows pass one task as a stream, and nothing is held but the hash. Null is an empty text.
    """
    frame = lambda data: len(data).to_bytes(8, "big") + data

    def run(batches):
        digest, n = hashlib.sha256(), 0

        for batch in batches:
            for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest.update(b"".join(frame(cell.encode()) for cell in cells))
            n += batch.num_rows
        digest.update(frame(str(n).encode()))
        yield pa.RecordBatch.from_pydict({"n_rows": pa.array([n], pa.int64()), "inventory_sha256": [digest.hexdigest()]})

    cells = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    found = cells.repartition(1).sortWithinPartitions(columns[0]).mapInArrow(run, "n_rows bigint, inventory_sha256 string")
    # An empty table may have no task at all; what is left then is the hash of the count.
    one = rows.sparkSession.range(1).join(found, F.lit(True), "left")
    return one.select(F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), F.coalesce("inventory_sha256", F.lit(hashlib.sha256(frame(b"0")).hexdigest())).alias("inventory_sha256"))
