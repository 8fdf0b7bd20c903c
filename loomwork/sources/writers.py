"""Writers. Spark's commit makes each output appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinals
from .store import Store

#: Characters in a spreadsheet cell.
CELL_LIMIT = 32_767


def json_lines(rows: DataFrame, path: str) -> None:
    """JSON Lines with nulls kept and text unescaped."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def in_order(rows: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """``rows`` with their numbers in a total order, laid out in it: files that follow each other by name, rows in order in each.

    What is left equal is ordered by a hash of the row. To be written by any of these writers.
    """
    return with_ordinals(rows, order, name).repartitionByRange(name).sortWithinPartitions(name)


def csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by ';', structures become JSON, over-long cells are an error."""
    cells = []
    for name, kind in rows.dtypes:
        column = F.col(f"`{name}`")
        column = F.array_join(column, ";") if kind == "array<string>" else F.to_json(column) if kind.startswith(("array", "map", "struct")) else column.cast("string")
        cells.append(F.when(F.length(column) > CELL_LIMIT, F.raise_error(F.lit(f"{name}: cell over {CELL_LIMIT} characters"))).otherwise(column).alias(name))
    rows.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def content_xml(records: DataFrame, path: str) -> None:
    """Localization XML from contentUid, version and text."""
    out = records.select(F.col("contentUid").alias("_contentuid"), F.col("version").alias("_version"), F.col("text").alias("_VALUE"))
    out.write.mode("overwrite").format("xml").option("rootTag", "contentList").option("rowTag", "content").save(path)


def batches(rows: DataFrame, path: str, batch: str = "batch_id") -> None:
    """A folder per batch."""
    rows.repartition(batch).write.mode("overwrite").partitionBy(batch).json(path)


def chunked(rows: DataFrame, path: str, most: int) -> None:
    """Files of at most ``most`` rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", most).json(path)


def split_status(rows: DataFrame, path: str, status: str = "status") -> None:
    """Classified, unresolved and excluded rows side by side, by one pass."""
    rows.write.mode("overwrite").partitionBy(status).json(path)


def report(rows: DataFrame, path: str) -> dict:
    """A report of few rows as one JSON object of lists, written by the driver beside a temporary file."""
    import os

    got = rows.collect()  # reports are aggregates
    data = {name: [r[name] for r in got] for name in rows.columns}
    part = f"{path}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, sort_keys=True, default=str)
    os.replace(part, path)
    return data


def replace_snapshot(df: DataFrame, path: str) -> None:
    """Make ``df`` the current version of the table at ``path``, by a commit in the log there.

    Readers see the old version or the new one, at any moment. ``df`` may read the
    version that it replaces. Old versions stay until :func:`drop_old_snapshots`; a writer
    that another one has overtaken gets ``store.Conflict``.
    """
    store = Store(df.sparkSession, path)
    store.commit(store.version(), {"table": df})


def read_snapshot(spark, path: str) -> DataFrame:
    return Store(spark, path).read("table")


def drop_old_snapshots(spark, path: str) -> None:
    """Remove all versions but the current one, once nothing reads them."""
    Store(spark, path).vacuum()
