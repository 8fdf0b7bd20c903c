"""Parsers of semi-structured texts, one row per file in, rows of facts out.

The line grammar (entry, type, using, data) is windows over exploded lines. Trees
(XML, JSON) need document order and ancestors, so they run as Arrow-batched
Python over whole files, each file on its own.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HANDLE, handles

_HANDLE = re.compile(HANDLE)


def stats_lines(files: DataFrame) -> DataFrame:
    """path, line, entry, entity_type, using, field, value: data lines with what stands above them.

    ``type`` and ``using`` hold from their own line on, within their entry only.
    """
    lines = files.select("path", F.posexplode(F.split("value", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line", "text"))
    part = lambda word: F.nullif(F.regexp_extract("text", rf'^\s*{word}\s+"([^"]*)"', 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line")
    tagged = lines.withColumn("entry_no", F.count(F.when(F.col("text").rlike(r'^\s*new\s+entry\s+"'), 1)).over(w))
    tagged = tagged.withColumn("_entry", part(r"new\s+entry")).withColumn("_type", part("type")).withColumn("_using", part("using"))
    own = Window.partitionBy("path", "entry_no").orderBy("line")
    last = lambda c: F.last(c, ignorenulls=True).over(own)
    filled = tagged.select("path", "line", "entry_no", "text", last("_entry").alias("entry"), last("_type").alias("entity_type"), last("_using").alias("using"))
    data = filled.where("entry_no > 0").withColumn("field", F.regexp_extract("text", r'^\s*data\s+"([^"]*)"\s+"', 1)).withColumn("value", F.regexp_extract("text", r'^\s*data\s+"[^"]*"\s+"([^"]*)"', 1))
    return data.where("field <> ''").select("path", "line", "entry_no", "entry", "entity_type", "using", "field", "value")


def stats_handles(files: DataFrame) -> DataFrame:
    """Handles in data fields with their entry."""
    return stats_lines(files).select("path", "line", "entry", "entity_type", "using", "field", F.explode(handles(F.col("value"))).alias("content_uid"))


def stats_definitions(files: DataFrame) -> DataFrame:
    """Entries as graph nodes: id, name, entity_type, using and fields, the last of equal fields winning."""
    rows = stats_lines(files)
    last = rows.groupBy("path", "entry_no", "field").agg(F.max_by(F.struct("value", "entry", "entity_type", "using"), "line").alias("x"), F.max("line").alias("line"))
    nodes = last.groupBy("path", "entry_no").agg(F.max_by("x", "line").alias("x"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("field"), F.col("x.value").alias("value"))))).alias("fields"))
    return nodes.select(F.concat_ws("#", "path", "entry_no").alias("id"), F.col("x.entry").alias("name"), F.col("x.entity_type").alias("entity_type"), F.col("x.using").alias("using"), "fields")


def comment_handles(files: DataFrame) -> DataFrame:
    """Handles that stand in comment lines only."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    found = lines.select("path", "line", F.col("text").rlike(r"^\s*//").alias("in_comment"), F.explode(handles(F.col("text"))).alias("content_uid"))
    return found.groupBy("path", "content_uid").agg(F.min("line").alias("line"), F.bool_and("in_comment").alias("comment_only")).where("comment_only")


def handle_positions(files: DataFrame) -> DataFrame:
    """path, line, column, content_uid (both from 1): every handle of free text."""

    def each(path: str, value: str):
        for n, text in enumerate(re.split(r"\r?\n", value), 1):
            yield from ((path, n, m.start() + 1, m[1]) for m in _HANDLE.finditer(text))

    return _parse(files, each, "path string, line int, `column` int, content_uid string").dropDuplicates()


def _parse(files: DataFrame, each: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]

    def run(frames):
        for frame in frames:
            rows = [r for path, value in zip(frame["path"], frame["value"], strict=True) for r in each(path, value or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "value").mapInPandas(run, schema)


def _walk(root: ET.Element):
    """(element, its ancestors from the root) in document order."""
    stack = [(root, ())]
    while stack:
        element, above = stack.pop()
        yield element, above
        stack += [(child, (*above, element)) for child in reversed(element)]


def xml_handles(files: DataFrame, entity_tag: str = "node") -> DataFrame:
    """path, ordinal, element, attribute, entity, content_uid: handles in attributes, with the id of the nearest enclosing entity.

    A file that is no XML gives no rows.
    """

    def each(path: str, value: str):
        try:
            root = ET.fromstring(value)
        except ET.ParseError:
            return
        for n, (element, above) in enumerate(_walk(root)):
            entity = next((a.get("id") or a.get("Name") for a in reversed((*above, element)) if a.tag == entity_tag and (a.get("id") or a.get("Name"))), None)
            for name, text in element.attrib.items():
                if m := _HANDLE.match(text):
                    yield path, n, element.tag.rpartition("}")[2], name, entity, m[1]

    return _parse(files, each, "path string, ordinal int, element string, attribute string, entity string, content_uid string")


def translated_strings(files: DataFrame, field: str = ".*") -> DataFrame:
    """path, entity, field, content_uid: attributes of type TranslatedString whose name matches, as resource files hold them."""
    wanted = re.compile(field)

    def each(path: str, value: str):
        try:
            root = ET.fromstring(value)
        except ET.ParseError:
            return
        for element, above in _walk(root):
            if element.tag == "attribute" and element.get("type") == "TranslatedString" and wanted.fullmatch(element.get("id") or "") and element.get("handle"):
                owner = above[-1] if above else None
                names = {c.get("id"): c.get("value") for c in (owner if owner is not None else ()) if c.tag == "attribute"}
                yield path, names.get("Name") or names.get("UUID") or (owner.get("id") if owner is not None else None), element.get("id"), element.get("handle").split(";")[0]

    return _parse(files, each, "path string, entity string, field string, content_uid string")


def markup_handles(files: DataFrame, back: int = 200) -> DataFrame:
    """path, element, attribute, content_uid: handles in raw markup, named by the tag and attribute that open before them."""

    def each(path: str, value: str):
        for m in _HANDLE.finditer(value):
            before = value[max(0, m.start() - back) : m.start()]
            tag, attribute = re.findall(r"<([A-Za-z_][\w.:-]*)[^<>]*$", before), re.findall(r"([\w.:-]+)\s*=\s*[\"'][^\"']*$", before)
            yield path, tag[-1] if tag else None, attribute[-1] if attribute else None, m[1]

    return _parse(files, each, "path string, element string, attribute string, content_uid string")


def dialog_handles(files: DataFrame) -> DataFrame:
    """path, node_id, pointer, content_uid: handles anywhere in dialog JSON, with the nearest enclosing node's id."""

    def search(value, pointer: str, node: str | None):
        if isinstance(value, dict):
            inner = value.get("UUID", node)
            node = inner.get("value", node) if isinstance(inner, dict) else inner
            for key, child in value.items():
                yield from search(child, f"{pointer}/{key}", node)
        elif isinstance(value, list):
            for i, child in enumerate(value):
                yield from search(child, f"{pointer}/{i}", node)
        elif isinstance(value, str) and (m := _HANDLE.match(value)):
            yield node, pointer, m[1]

    def each(path: str, value: str):
        try:
            data = json.loads(value)
        except ValueError:
            return
        yield from ((path, node, pointer, uid) for node, pointer, uid in search(data, "", None))

    return _parse(files, each, "path string, node_id string, pointer string, content_uid string")


def speakers(files: DataFrame) -> DataFrame:
    """path, ordinal, speaker: the speaker list of a dialog container."""

    def each(path: str, value: str):
        try:
            data = json.loads(value)
        except ValueError:
            return
        found = data.get("speakerlist") or data.get("speakers") or [] if isinstance(data, dict) else []
        for n, s in enumerate(found):
            yield path, n, s if isinstance(s, str) else str(s.get("id") or s.get("list") or "")

    return _parse(files, each, "path string, ordinal int, speaker string")


def modules(files: DataFrame) -> DataFrame:
    """path, folder, uuid, depends_on (null where nothing is): module metadata with its dependencies; conflicts are no dependencies."""

    def each(path: str, value: str):
        try:
            root = ET.fromstring(value)
        except ET.ParseError:
            return
        own, needs = {}, []
        for element, above in _walk(root):
            tags = [a.get("id") for a in above if a.tag == "node"]
            if element.tag == "attribute" and "ModuleInfo" in tags and "Dependencies" not in tags and "Conflicts" not in tags:
                own.setdefault(element.get("id"), element.get("value"))
            if element.tag == "attribute" and element.get("id") == "UUID" and "Dependencies" in tags and "Conflicts" not in tags:
                needs.append(element.get("value"))
        for need in needs or [None]:
            yield path, own.get("Folder"), own.get("UUID"), need

    return _parse(files, each, "path string, folder string, uuid string, depends_on string")


def story_domain(family, constructor=None, category=None, field=None, path=None):
    """The domain of an occurrence by its source family, then by what its node, category, field or path says."""
    said = lambda c, pattern: F.coalesce(c, F.lit("")).rlike("(?i)" + pattern) if c is not None else F.lit(False)
    dialog = (
        F.when(said(path, "cinematic") | said(category, "cinematic"), "CinematicSubtitle")
        .when(said(constructor, "narrat"), "Narration")
        .when(said(constructor, "question|player"), "PlayerDialogueOption")
        .when(said(category, "bark"), "AmbientDialogue")
        .otherwise("NPCDialogue")
    )
    quest = F.when(said(field, "title"), "QuestTitle").when(said(field, "description|objective"), "QuestDescription").otherwise("JournalEntry")
    book = F.when(said(field, "title|displayname"), "BookTitle").otherwise("ReadableWorldText")
    return (
        F.when(family.isin("DialogsRaw", "DialogsBinary", "Dialog"), dialog)
        .when(family == "Cinematics", "CinematicSubtitle")
        .when(family == "JournalQuest", quest)
        .when(family == "ReadableLocalizationRegistry", book)
        .when(family.isin("TagsCharacters", "RootTemplates", "LocalizationRegistry"), "StoryRelatedTerm")
        .when(family.isin("StoryGoals", "LevelResources"), "ContextSupportOnly")
        .otherwise("Unknown")
    )
