"""Input of batches: which groups a record may join, by what its category trusts, and the order of records in a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from .sets import require_unique

#: Sources of groups by category, in the order in which they are asked.
CHAINS = {
    "dialogue_general": ("story",),
    "quest": ("research", "evidence"),
    "skill_spell": ("research", "ui", "evidence"),
    "item": ("ui", "research", "evidence"),
    "ui": ("ui", "research", "evidence"),
    "tutorial": ("ui", "research", "evidence"),
    "book_lore": ("story", "evidence"),
    "character_world": ("story", "evidence"),
}
#: Fixed value: the order for all other categories, which take no subkeys.
OTHERWISE = ("evidence", "story")
#: Families whose occurrences are grouped by dialog, and a status that is left out.
DIALOGS, COMMENT_ONLY = ("DialogsRaw", "DialogsBinary"), "ExcludedCommentOnly"


def dialog_group(path: Column) -> Column:
    """dialog:path below the dialog folders, without the suffix of a resource file."""
    p = normalize_key(path)
    inner = F.regexp_extract(p, r"/story/(?:dialogsbinary|dialogs)/(.*)$", 1)
    binary = F.regexp_extract(p, r"^.*?/story/dialogsbinary/(.*)$", 1)
    relative = F.when(p.contains("/story/dialogsbinary/"), binary).when(p.contains("/story/dialogs/"), inner).otherwise(F.regexp_replace(p, "^/+", ""))
    return F.concat(F.lit("dialog:"), F.regexp_replace(relative, r"(?<=[^/])\.(lsf|lsj)$", ""))


def _groups(rows: DataFrame, candidate: Column, subkey: Column) -> DataFrame:
    """content_uid, candidates, subkeys as sorted sets; null is none."""
    return rows.select("content_uid", candidate.alias("_c"), subkey.alias("_s")).groupBy("content_uid").agg(
        F.array_sort(F.collect_set("_c")).alias("candidates"), F.array_sort(F.collect_set("_s")).alias("subkeys")
    )


def _said(column: str) -> Column:
    """The text without blanks at its ends; null where nothing is left."""
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def story_groups(ledger: DataFrame) -> DataFrame:
    """Groups of story occurrences (content_uid, internal_path, family, node_id, attribute_role): the dialog, else path and node, else the path."""
    rows = ledger.where("content_uid <> '' AND internal_path <> ''")
    node, role, path = F.lower(_said("node_id")), F.lower(_said("attribute_role")), normalize_key(F.col("internal_path"))
    candidate = F.when(F.col("family").isin(*DIALOGS), dialog_group(F.col("internal_path"))).when(node.isNotNull(), F.concat(F.lit("story:"), path, F.lit("|"), node)).otherwise(F.concat(F.lit("path:"), path))
    subkey = F.when(node.isNotNull() | role.isNotNull(), F.concat(F.coalesce(node, F.lit("")), F.lit("|"), F.coalesce(role, F.lit(""))))
    return _groups(rows, candidate, subkey)


def ui_groups(universe: DataFrame) -> DataFrame:
    """Groups of interface occurrences (content_uid, status, provider, entity_type, entity_name, internal_path, field_name): the entity, else the path."""
    rows = universe.where((F.col("content_uid") != "") & (F.coalesce("status", F.lit("")) != COMMENT_ONLY))
    entity = F.concat_ws("|", *[F.lower(_said(c)) for c in ("provider", "entity_type", "entity_name")])
    candidate = F.when(entity != "", F.concat(F.lit("entity:"), entity)).when(_said("internal_path").isNotNull(), F.concat(F.lit("path:"), normalize_key(F.col("internal_path"))))
    return _groups(rows, candidate, F.lower(_said("field_name")))


def research_groups(mappings: DataFrame) -> DataFrame:
    """Groups of mappings, one row for each piece of evidence (content_uid, mapping_type, resource_path, entry_name, field_name, entity_id, element_index, field_role)."""
    rows = mappings.where("content_uid <> ''")
    path = normalize_key(F.coalesce("resource_path", F.lit("")))
    stat, quest = F.col("mapping_type") == "stat-reference", F.col("mapping_type") == "quest-journal"
    candidate = (
        F.when(stat & _said("entry_name").isNotNull(), F.concat(F.lit("stat:"), path, F.lit("|"), F.lower(_said("entry_name"))))
        .when(quest & _said("entity_id").isNotNull(), F.concat(F.lit("quest:"), path, F.lit("|"), F.lower(_said("entity_id"))))
        .when(quest & _said("element_index").isNotNull(), F.concat(F.lit("quest:"), path, F.lit("|element:"), _said("element_index")))
    )
    return _groups(rows, candidate, F.when(stat, F.lower(_said("field_name"))).when(quest, F.lower(_said("field_role"))))


def evidence_groups(paths: Column) -> Column:
    """path:... for each evidence path of a classification, sorted, each once."""
    named = F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.transform(named, lambda p: F.concat(F.lit("path:"), normalize_key(p)))))


def inputs(classification: DataFrame, source: DataFrame, story: DataFrame, ui: DataFrame, research: DataFrame) -> DataFrame:
    """content_uid, source_text, primary_category, classification_status, candidates, subkeys of each classified record.

    ``classification``: content_uid, primary_category, classification_status,
    evidence_paths; ``source``: content_uid, text; the rest as the functions above
    give them. A source is asked only where those before it gave no group; its
    subkeys count if it was asked. Keys that are null, empty or repeated, or that
    only one of the two tables holds, are an error.
    """
    require_unique(classification, "content_uid")
    require_unique(source, "content_uid")
    none = F.array().cast("array<string>")
    rows = classification.join(source.select("content_uid", F.col("text").alias("source_text"), F.lit(True).alias("_known")), "content_uid", "full")
    for name, groups in {"story": story, "ui": ui, "research": research}.items():
        rows = rows.join(groups.select("content_uid", F.struct("candidates", "subkeys").alias(f"_{name}")), "content_uid", "left")
    rows = rows.withColumn("_evidence", F.struct(evidence_groups(F.col("evidence_paths")).alias("candidates"), none.alias("subkeys")))
    odd = rows.where(F.col("_known").isNull() | F.col("primary_category").isNull()).select("content_uid", "_known").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].content_uid}: {'absent from the classification' if odd[0]._known else 'absent from the source'}")
    part = lambda name, field: F.coalesce(F.col(f"_{name}")[field], none)

    def chain(names: tuple[str, ...], take: str) -> Column:
        out = none
        for name in reversed(names):
            out = F.when(F.size(part(name, "candidates")) > 0, part(name, take)).otherwise(out if take == "candidates" else F.array_union(part(name, take), out))
        return out

    def by_category(take: str) -> Column:
        out = F.when(F.lit(False), none)
        for category, names in CHAINS.items():
            out = out.when(F.col("primary_category") == category, chain(names, take))
        return out.otherwise(chain(OTHERWISE, take) if take == "candidates" else none)

    return rows.select("content_uid", "source_text", "primary_category", "classification_status", by_category("candidates").alias("candidates"), F.array_sort(by_category("subkeys")).alias("subkeys"))


def group_of(candidates: Column, uid: Column) -> Column:
    """The least candidate by its normalised text, or the record itself."""
    keys = F.array_sort(F.filter(F.transform(candidates, normalize_key), lambda c: c != ""))
    return F.coalesce(F.get(keys, F.lit(0)), F.concat(F.lit("uid:"), F.lower(uid)))


def stable_order(subkeys: Column, uid: Column) -> list[Column]:
    """Sort columns of records in a group: their sorted subkeys, then the uid, whatever its case."""
    return [F.array_sort(F.transform(F.filter(subkeys, lambda s: s != ""), normalize_key)), F.lower(uid)]
