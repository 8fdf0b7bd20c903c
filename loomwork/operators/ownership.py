"""Which category a record's mappings speak for: structural rules, as column expressions.

``mappings``: key, mapping_type, classification, domain (of the mapping) and
evidence: array<struct<evidence_type, rule_id, resource_path, source_role,
properties: map<string,string>>>. Nulls count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key, stem
from .classify import CONFIDENCE, PRECEDENCE

#: Entry types and file stems that speak for a category.
SKILL_ENTRIES = ("spelldata", "passivedata", "statusdata", "interruptdata")
ITEM_ENTRIES = ("object", "objectdata", "weapon", "weapondata", "armor", "armordata", "item", "itemdata")
SKILL_STEMS = ("spells", "spell", "passives", "passive", "statuses", "status", "interrupts", "interrupt")
ITEM_STEMS = ("weapons", "weapon", "armor", "armors", "items", "item", "objects", "object")
#: Provider domains and workstreams by category.
UI_DOMAINS = {"AbilityOrSkill": "skill_spell", "ItemsAndEquipment": "item", "UserInterface": "ui"}
WORKSTREAMS = {"ItemsEquipment": "item", "AbilitySkill": "skill_spell", "UserInterface": "ui"}
#: World registries, and registries of gameplay texts by stem and by beginning.
WORLD_STEMS = ("levels", "waypointshrines", "waypointshrines2", "subregions")
GAMEPLAY = ("stats", "status", "shout", "target")
#: Families and domains of spoken lines.
DIALOG_FAMILIES = ("DialogsRaw", "DialogsBinary", "Cinematics")
DIALOG_DOMAINS = ("NPCDialogue", "PlayerDialogueOption", "AmbientDialogue", "CinematicSubtitle", "Narration")
HIT = "struct<category:string,confidence:string,reason:string,rule_id:string,resource_path:string,source_role:string>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _by(values: dict[str, str], c: Column) -> Column:
    """The category of a value, null for other values."""
    out = F.when(F.lit(False), "")
    for value, category in values.items():
        out = out.when(c == value, category)
    return out


def _hit(category: Column, confidence: str | Column, reason: str | Column, ev: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    part = lambda name: _text(ev[name]) if ev is not None else F.lit("")
    reason = lit(reason)
    rule = F.when(ev.isNotNull(), _text(ev["rule_id"])).otherwise(reason) if ev is not None else reason
    return F.when(category.isNotNull(), F.struct(category.alias("category"), lit(confidence).alias("confidence"), reason.alias("reason"), rule.alias("rule_id"), part("resource_path").alias("resource_path"), part("source_role").alias("source_role")))


def hits(mapping_type: Column, domain: Column, evidence: Column) -> Column:
    """array of HIT: every rule that a mapping meets, with the evidence that met it, in the order of the rules."""
    kind, evidence = _text(mapping_type), F.coalesce(evidence, F.array())
    has = lambda name: F.exists(evidence, lambda e: e["evidence_type"] == name)
    first = lambda name: F.get(F.filter(evidence, lambda e: e["evidence_type"] == name), F.lit(0))
    only = lambda c, category: F.when(c, F.lit(category))

    def stats(e: Column) -> Column:
        entry, name = F.lower(_text(e["properties"]["entryType"])), _text(stem(e["resource_path"]))
        meant = (kind == "stat-reference") | e["evidence_type"].isin("StatsDefinition", "PassiveContext")
        by_entry = F.when(entry.isin(*SKILL_ENTRIES), "skill_spell").when(entry.isin(*ITEM_ENTRIES), "item")
        by_path = F.when(name.isin(*SKILL_STEMS), "skill_spell").when(name.isin(*ITEM_STEMS), "item")
        return F.when(F.coalesce(meant, F.lit(False)), F.coalesce(_hit(by_entry, "high", "stat-entry-type", e), _hit(by_path, "medium", "stat-resource-path", e)))

    def provider(e: Column) -> Column:
        return F.when(e["evidence_type"] == "UiSkillProvider", _hit(_by(UI_DOMAINS, _text(e["properties"]["domain"])), "high", "ui-skill-provider", e))

    def story(e: Column) -> Column:
        p = lambda name: _text(e["properties"][name])
        name, parts = _text(stem(e["resource_path"])), F.split(_text(normalize_key(e["resource_path"])), "/+")
        at = F.array_position(parts, "localization").cast("int")
        under_stats = (at > 0) & (F.coalesce(F.get(parts, at), F.lit("")) == "stats")
        gameplay = name.isin(*GAMEPLAY) | under_stats
        for word in GAMEPLAY:
            gameplay = gameplay | name.startswith(f"{word}_")
        registry = (
            F.when(name.isin(*WORLD_STEMS) | name.endswith("_subregions"), F.struct(F.lit("character_world").alias("c"), F.lit("world-registry-structure").alias("r")))
            .when(name == "readychecks_descriptions", F.struct(F.lit("system_message").alias("c"), F.lit("ready-check-registry-structure").alias("r")))
            .when(name == "itemcombinations", F.struct(F.lit("item").alias("c"), F.lit("item-combination-registry-structure").alias("r")))
            .when(gameplay, F.struct(F.lit("skill_spell").alias("c"), F.lit("gameplay-registry-structure").alias("r")))
        )
        family, area, role = p("resourceFamily"), p("storyDomain"), p("attributeRole")
        found = (
            F.when((family == "ReadableLocalizationRegistry") & (area == "ReadableWorldText") & (role == "Content"), F.struct(F.lit("book_lore").alias("c"), F.lit("readable-registry-structure").alias("r")))
            .when((family == "TagsCharacters") & (area == "StoryRelatedTerm"), F.struct(F.lit("character_world").alias("c"), F.lit("tags-characters-structure").alias("r")))
            .when((family == "LocalizationRegistry") & (area == "StoryRelatedTerm") & (role == "Content"), registry)
            .when(family.isin(*DIALOG_FAMILIES) & area.isin(*DIALOG_DOMAINS), F.struct(F.lit("dialogue_general").alias("c"), F.lit("story-dialog-structure").alias("r")))
        )
        meant = (kind == "story-occurrence") & (e["evidence_type"] == "StoryOccurrence") & ~F.lower(p("isOldText")).isin("true", "1")
        return F.when(F.coalesce(meant, F.lit(False)), _hit(found["c"], "high", found["r"], e))

    def universe(e: Column) -> Column:
        p = lambda name: _text(e["properties"][name])
        stream = p("workstream")
        resource = (stream == "AQResourceReferencedReview") & (p("domains") == "Ability.Unknown") & (p("entityType") == "ActionResourceDefinition") & (p("fieldName") == "DisplayName")
        found = F.coalesce(
            _hit(_by(WORKSTREAMS, stream), "high", "ui-skill-workstream", e),
            _hit(only((stream == "TutorialSystem") & (p("domains") == "UI.Tutorial"), "tutorial"), "high", "tutorial-workstream-domain", e),
            _hit(only(resource, "skill_spell"), "high", "action-resource-definition", e),
        )
        meant = (kind == "ui-skill-universe") & (e["evidence_type"] == "UiSkillUniverse") & (p("status") != "ExcludedCommentOnly")
        return F.when(F.coalesce(meant, F.lit(False)), found)

    whole = F.array(
        _hit(only((kind == "bark-speaker") | has("BarkSpeakerStructure"), "bark"), "high", "bark-structural-mapping", first("BarkSpeakerStructure")),
        _hit(only((kind == "quest-journal") | has("QuestJournal"), "quest"), "high", "quest-journal-mapping", first("QuestJournal")),
        _hit(F.when(kind == "ui-skill-candidate", _by(UI_DOMAINS, _text(domain))), "high", "ui-skill-domain", first("UiSkillProvider")),
    ).cast(f"array<{HIT}>")
    each = F.flatten(F.transform(evidence, lambda e: F.array(stats(e), provider(e)).cast(f"array<{HIT}>")))
    later = F.flatten(F.transform(evidence, lambda e: F.array(story(e), universe(e)).cast(f"array<{HIT}>")))
    dialog = F.array(_hit(only((kind == "dialog-context") | has("DialogGraph"), "dialogue_general"), "high", "dialog-context", first("DialogGraph"))).cast(f"array<{HIT}>")
    return F.array_compact(F.concat(whole, each, later, dialog))


def candidates(mappings: DataFrame, key: str) -> DataFrame:
    """key, category, confidence, reason, rule_id, resource_path, source_role: a row for each rule that a mapping meets."""
    return mappings.select(key, F.inline(hits(F.col("mapping_type"), F.col("domain"), F.col("evidence"))))


def functional(keys: DataFrame, mappings: DataFrame, key: str) -> DataFrame:
    """key, primary_category, confidence, tags, status, n_evidence: one row per distinct key.

    The strongest confidence wins, then the least precedence; losing categories
    follow as tags in that order. Without a candidate: other, low, unclassified.
    Hits combine by category before the shuffle, so a key with many mappings is no
    hot group.
    """
    lookup = lambda values, c: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[c]
    by_category = candidates(mappings, key).groupBy(key, "category").agg(F.min(lookup(CONFIDENCE, F.col("confidence"))).alias("c"), F.count(F.lit(1)).alias("n"))
    ranked = by_category.select(key, "n", F.struct("c", lookup(PRECEDENCE, F.col("category")).alias("p"), "category").alias("r"))
    owned = ranked.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("ranked"), F.sum("n").alias("n"))  # at most a struct for each category
    names = F.element_at(F.col("ranked"), 1)
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), names["c"] + 1)
    tags = F.array_join(F.transform(F.slice("ranked", 2, 100), lambda r: F.concat(F.lit("also:"), r["category"])), ";")
    joined = keys.select(key).distinct().join(owned, key, "left")
    return joined.select(
        key,
        F.coalesce(names["category"], F.lit("other")).alias("primary_category"),
        F.coalesce(confidence, F.lit("low")).alias("confidence"),
        F.coalesce(tags, F.lit("")).alias("tags"),
        F.when(names.isNull(), "unclassified").otherwise("classified").alias("status"),
        F.coalesce("n", F.lit(0)).alias("n_evidence"),
    )
