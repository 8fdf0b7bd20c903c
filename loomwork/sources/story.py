"""Occurrences of content handles in story resources: dialog JSON, eight families of XML, and goal texts."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import _parse, _walk, stats_handles, story_domain

#: The families of XML resources, those of dialogs and goals, and attributes that name a node.
XML_FAMILIES = ("DialogsBinary", "JournalQuest", "Cinematics", "LevelResources", "LocalizationRegistry", "ReadableLocalizationRegistry", "RootTemplates", "TagsCharacters")
DIALOGS, GOALS = "DialogsRaw", "StoryGoals"
IDENTITIES = ("UUID", "MapKey", "Name", "ID", "Guid", "GUID")
#: Fields of passives that show text.
PASSIVE_FIELDS = ("DisplayName", "Description", "ExtraDescription")
UID = re.compile(r"h[0-9a-f]{8}(?:g[0-9a-f]{4}){3}g[0-9a-f]{12}", re.I)
RAW = "path string, content_uid string, node_id string, role string, constructor string, category string, has_speaker boolean"


def _node_names(root: ET.Element):
    """Each element with the name of the node it belongs to; unnamed nodes go by their kind and place among all nodes."""
    names: dict[ET.Element, str] = {}
    nodes = 0
    for element, above in _walk(root):
        name = names[above[-1]] if above else ""
        if element.tag.rpartition("}")[2] == "node":
            nodes += 1
            held = (c.get("value") or c.get("handle") for c in element if c.tag.rpartition("}")[2] == "attribute" and c.get("id") in IDENTITIES)
            own = (element.get(k) for k in ("UUID", "MapKey", "Name"))
            name = next((x for x in (*held, *own) if x), "") or f"{element.get('id', 'node')}#{nodes}"
        names[element] = name
        yield element, name


def xml_occurrences(files: DataFrame, family: str) -> DataFrame:
    """Handles in attributes of converted XML, each with the node around it and the attribute's id; broken XML has none."""
    if family not in XML_FAMILIES:
        raise ValueError(f"unknown family {family}")

    def each(path: str, value: str):
        try:
            root = ET.fromstring(value)
        except ET.ParseError:
            return
        for element, node in _node_names(root):
            handle = element.get("handle") or element.get("value")
            if handle and UID.match(handle):
                yield path, handle.lower(), node, element.get("id") or "TranslatedString", None, None, False

    return _occurrences(_parse(files, each, RAW), family)


def dialog_occurrences(files: DataFrame) -> DataFrame:
    """Handles in the tagged texts of dialog nodes, with the node's constructor, the dialog's category and whether anyone speaks."""

    def value_of(holder, key: str) -> str:
        inner = holder.get(key) if isinstance(holder, dict) else None
        return str(inner.get("value", "")) if isinstance(inner, dict) else ""

    def each(path: str, value: str):
        try:
            dialog = json.loads(value)["save"]["regions"]["dialog"]
            nodes = dialog["nodes"][0]["node"]
        except (ValueError, KeyError, IndexError, TypeError):
            return
        for node in nodes if isinstance(nodes, list) else ():
            if isinstance(node, dict):
                for m in UID.finditer(json.dumps(node.get("TaggedTexts", []))):
                    yield path, m[0].lower(), value_of(node, "UUID"), "TagText", value_of(node, "constructor"), value_of(dialog, "category"), value_of(node, "speaker") not in ("", "-1")

    return _occurrences(_parse(files, each, RAW), DIALOGS)


def goal_occurrences(files: DataFrame) -> DataFrame:
    """Handles in lines of goal texts; the node is line/number, from 1."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("n", "line"))
    found = lines.select("path", "n", F.explode(F.regexp_extract_all("line", F.lit(f"(?i)({UID.pattern})"), F.lit(1))).alias("uid"))
    rows = found.select("path", F.lower("uid").alias("content_uid"), F.concat(F.lit("line/"), (F.col("n") + 1).cast("string")).alias("node_id"), F.lit("StoryGoalText").alias("role"), F.lit(None).cast("string").alias("constructor"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("has_speaker"))
    return _occurrences(rows, GOALS)


def _occurrences(rows: DataFrame, family: str) -> DataFrame:
    """Rows of one family with their domain and the flags that follow from it."""
    domain = story_domain(F.lit(family), F.col("constructor"), F.col("category"), F.col("role"), F.col("path"))
    return rows.select("content_uid", "path", F.lit(family).alias("family"), domain.alias("story_domain"), "node_id", F.col("role").alias("attribute_role"), "has_speaker", F.lit(family.startswith("Dialog")).alias("has_dialog"), F.lit(family == "JournalQuest").alias("has_quest"), ((F.col("role") == "OldText") & F.lit(family in XML_FAMILIES)).alias("is_old_text"))


def occurrences(files: DataFrame) -> DataFrame:
    """All occurrences of files (path, family, value), each read by its family's grammar; other families have none."""
    of = lambda family: files.where(F.col("family") == family).select("path", "value")
    parts = [dialog_occurrences(of(DIALOGS)), goal_occurrences(of(GOALS)), *[xml_occurrences(of(f), f) for f in XML_FAMILIES]]
    return reduce(DataFrame.unionByName, parts)


def clearance(candidates: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """content_uid, cleared, reason: whether a candidate has a source text and occurs anywhere but in old texts; one that occurs nowhere is cleared."""
    per = found.groupBy("content_uid").agg(F.bool_and("is_old_text").alias("_old"))
    met = candidates.select("content_uid").distinct().join(texts.select("content_uid", "text"), "content_uid", "left").join(per, "content_uid", "left")
    t = F.coalesce("text", F.lit(""))
    reason = F.when((t == "%%% EMPTY") | ~t.rlike(r"\S"), "MissingOrEmptySourceText").when(F.coalesce("_old", F.lit(False)), "OldTextOnly").otherwise("ClearedForTranslationSupplement")
    return met.select("content_uid", (reason == "ClearedForTranslationSupplement").alias("cleared"), reason.alias("reason"))


def passive_handles(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Handles in the shown fields of passives, for the target keys alone."""
    rows = stats_handles(files)
    return rows.where((F.lower("entity_type") == "passivedata") & F.col("field").isin(*PASSIVE_FIELDS)).join(targets.select("content_uid").distinct(), "content_uid", "left_semi")
