"""Helpers that the operators share: reading, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a table made by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile goes to Python workers in batches of ``rows`` rows at most; the session's own number holds again after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        rows = int(before)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on from stage to stage."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """``run`` over a partition's batches, with its memory given back at the end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, **more) -> DataFrame:
    """``mapInArrow`` for functions of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(lean(run), schema, **more)


def text_of(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else the table carries."""
    return documents.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))


def best_of(df: DataFrame, by: list[str], order: list[Column], top: int, rank: str) -> DataFrame:
    """The first ``top`` rows of each group with their rank: the best of many parts of a group meet, never a whole group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(parts)))
    first = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col(rank) <= top)
    return first.drop("_part", rank).withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= top)
