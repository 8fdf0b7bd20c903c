"""Results kept under the fingerprint of what they are made from, and counters observed while they are written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import Conflict, Store


def digest(df: DataFrame) -> str:
    """What a table's rows come to, in any order: their number, and sums of the parts of each row's SHA-256.

    Rows combine in every task; equal rows count as often as they occur. Map entries are
    taken in the order of their keys.
    """
    cells = [F.array_sort(F.map_entries(f"`{c}`")) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes]
    row = F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()  # one row
    said = json.dumps([df.schema.jsonValue(), [str(x) for x in sums]], sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()


def fingerprint(inputs: dict[str, DataFrame | str], profile: str = "") -> str:
    """One hash of named inputs (tables, or hashes known already) and of how they are used."""
    said = {k: v if isinstance(v, str) else digest(v) for k, v in sorted(inputs.items())}
    return hashlib.sha256(json.dumps([said, profile], sort_keys=True).encode()).hexdigest()


def kept(spark: SparkSession, path: str, inputs: dict[str, DataFrame | str], build: Callable[[], DataFrame], profile: str = "") -> tuple[DataFrame, bool]:
    """The result for ``inputs`` and whether it was there already; else what ``build`` makes, stored.

    A result is a version of a store of its own under the fingerprint, with its digest. It
    is verified on reading: one that was cut short or changed since is made anew.
    """
    store = Store(spark, f"{path}/{fingerprint(inputs, profile)}")
    version = store.version()
    if version:
        try:
            found = store.read("result", version)
            if digest(found) == store.metadata(version)["digest"]:
                return found, True
        except Exception as fault:  # files of it are gone or unreadable: it is made anew
            if "FAILED_READ_FILE" not in str(fault) and "PATH_NOT_FOUND" not in str(fault) and "FileNotFound" not in str(fault):
                raise
    made = build()
    try:
        version = store.commit(version, {"result": made})
        store.commit(version, metadata={"digest": digest(store.read("result", version)), "profile": profile})
    except Conflict:  # someone else made the same meanwhile
        return kept(spark, path, inputs, build, profile)
    return store.read("result"), False


def parts(spark: SparkSession, path: str, wanted: dict[str, tuple[dict[str, DataFrame | str], Callable[[], DataFrame]]], profile: str = "") -> tuple[dict[str, DataFrame], list[str]]:
    """Several results by name, each from its own inputs, and the names of those that had to be made: a changed input touches its parts alone."""
    out, made = {}, []
    for name, (inputs, build) in wanted.items():
        out[name], there = kept(spark, f"{path}/{name}", inputs, build, profile)
        if not there:
            made.append(name)
    return out, made


# Counters of what is written ------------------------------------------------------------------


def observed(df: DataFrame, write: Callable[[DataFrame], None], counters: dict[str, Column]) -> dict:
    """``counters`` (aggregates) of what ``write`` writes, gathered in the same pass over the rows.

    For a table that is a plain scan or made deterministically: a task that is tried again
    counts once, as Spark takes the metrics of the tasks whose output it keeps.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in counters.items()]))
    return dict(seen.get)


def presence_counters(columns: dict[str, str], total: str = "contentUidCount") -> dict[str, Column]:
    """A baseline's summary: all rows, and for each name how many have its column filled (not null, and not zero, false or empty)."""

    empty = ("", "0", "false", "[]", "{}")
    filled = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin(*empty)
    return {total: F.count(F.lit(1)), **{name: F.count_if(filled(column)) for name, column in columns.items()}}


def status_counters(status: str, values: tuple[str, ...]) -> dict[str, Column]:
    """How many rows have each status, and how many none of these."""
    return {**{v: F.count_if(F.col(status) == v) for v in values}, "other": F.count_if(~F.coalesce(F.col(status).isin(*values), F.lit(False)))}

