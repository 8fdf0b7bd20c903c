"""Readers of records, ledgers, manifests and returned material. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..operators.sets import require_unique
from ..session import settled

RECORD = "contentUid string, localeId string, text string, version string, sourcePackage string, sourceLocaEntry string, textHash string, presence boolean"
MAPPING = "contentUid string, mappingType string, classification string, version string, reviewRequired boolean, evidence array<struct<sourceRole:string, resourcePath:string, evidenceType:string, ruleId:string, properties:variant>>, metadata variant"
OCCURRENCE = "ContentUid string, PakName string, InternalPath string, ResourceFamily string, ResourceFormat string, StoryDomain string, NodeId string, AttributeRole string, HasSpeaker boolean, HasDialog boolean, HasQuest boolean, IsOldText boolean"
LISTING = "path string, size bigint, crc string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; blank lines are skipped, a line that is no object stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object or an array of objects in a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def keyed(spark: SparkSession, path: str, schema: str, key: str = "contentUid") -> DataFrame:
    """JSON Lines whose key must be present and unique."""
    return require_unique(json_lines(spark, path, schema), key)


def csv_ledger(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks inside cells; a byte order mark is skipped."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Archive listings: path, size and checksum between tabs."""
    return spark.read.schema(LISTING).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with their size and format; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as path and value."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))


def content_xml(spark: SparkSession, path: str, locale: str, package: str = "", entry: str = "") -> DataFrame:
    """Localization XML as records: one per content element, blanks kept, empty text for empty elements; uids must be unique."""
    rows = spark.read.format("xml").option("rowTag", "content").option("ignoreSurroundingSpaces", False).schema("_contentuid string, _version string, _VALUE string").load(path)
    text = F.coalesce("_VALUE", F.lit(""))
    out = rows.select(F.col("_contentuid").alias("contentUid"), F.lit(locale).alias("localeId"), text.alias("text"), F.col("_version").alias("version"), F.lit(package).alias("sourcePackage"), F.lit(entry).alias("sourceLocaEntry"), sha256(text).alias("textHash"), F.lit(True).alias("presence"))
    return require_unique(out, "contentUid")


def numbered(rows: DataFrame, first: int = 1) -> DataFrame:
    """Rows read from files with ``__file__`` and ``__row__``: the file's name and the row's number in its file.

    A file that is read in splits is numbered by a scan over them: a split's rows follow
    those of the splits before it in its file. What is counted is a row for each split.
    """
    place = F.monotonically_increasing_id()
    split = {"__path__": F.col("_metadata.file_path"), "__block__": F.col("_metadata.file_block_start")}
    tagged = settled(rows.select("*", F.col("_metadata.file_name").alias("__file__"), *[c.alias(n) for n, c in split.items()], place.alias("__place__")))
    counts = tagged.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("__place__").alias("begin"))
    before = Window.partitionBy("__path__").orderBy("__block__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*split, "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return tagged.join(offsets, list(split)).withColumn("__row__", F.col("__place__") - F.col("begin") + F.col("before") + first).drop("__path__", "__block__", "__place__", "begin", "before")


def returned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Returned material, CSV or (by its name) JSON Lines, with the file and the row it came from; rows that are blank all over go.

    A CSV's first row of data is number 2, as in a spreadsheet; a line of JSON is numbered from 1.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    lines = path.endswith(".jsonl")
    rows = numbered(spark.read.schema(schema).option("mode", "FAILFAST").json(path) if lines else spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path), 1 if lines else 2)
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in columns]
    any_cell = filled[0]
    for cell in filled[1:]:
        any_cell = any_cell | cell
    return rows.where(any_cell)


def locales(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """JSON Lines of several locales as one table."""
    out = None
    for locale, path in sorted(paths.items()):
        rows = json_lines(spark, path, RECORD).withColumn("localeId", F.lit(locale))
        out = rows if out is None else out.unionByName(rows)
    return out


def vdf_pairs(text: str) -> dict[str, str]:
    """Quoted key and value pairs of a small configuration text, on the driver; the last of equal keys wins."""
    import re

    return {k.lower(): v.replace("\\\\", "\\") for k, v in re.findall(r'"([^"]+)"\s+"([^"]*)"', text)}
