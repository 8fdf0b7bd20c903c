"""Session defaults. Callers with their own session keep it; nothing here is global."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    build = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        build = build.config(key, value)
    return build.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends there, and a lost executor loses nothing.

    A folder of this machine's own is taken only where none is set and all run on it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="loomwork-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
