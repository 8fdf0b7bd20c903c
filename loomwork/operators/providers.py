"""Interface providers: which files count, what they are, the role they play, and the universe of keys found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import first_rule

#: File families as name, pattern, subfamily, domains.
FAMILIES = [
    ("SpellData", r"/Stats/Generated/Data/Spell_[^/]+\.txt$", "Spell", ["Ability.Spell", "Ability.Cantrip", "Ability.ClassAction", "Ability.WeaponAction"]),
    ("PassiveData", r"/Stats/Generated/Data/Passive\.txt$", "Passive", ["Ability.Passive", "Ability.ClassFeature"]),
    ("StatusData", r"/Stats/Generated/Data/Status_[^/]+\.txt$", "Status", ["Ability.Status", "Ability.Condition"]),
    ("InterruptData", r"/Stats/Generated/Data/Interrupt\.txt$", "InterruptReaction", ["Ability.Interrupt", "Ability.Reaction"]),
    ("Progressions", r"(^|/)[^/]*Progression[^/]*\.(lsx|lsf|txt)$", "Progression", ["Ability.Progression", "UI.LevelUp"]),
    ("ClassDescriptions", r"(^|/)ClassDescriptions?\.(lsx|lsf|txt)$", "Class", ["Ability.ClassFeature", "UI.CharacterCreation", "UI.LevelUp"]),
    ("FeatDescriptions", r"(^|/)(FeatDescriptions?|Feats)\.(lsx|lsf|txt)$", "Feat", ["Ability.Feat", "UI.LevelUp"]),
    ("ActionResourceDefinitions", r"(^|/)[^/]*ActionResource[^/]*\.(lsx|lsf|txt|xaml)$", "ActionResource", ["Ability.ActionResource", "UI.HUD", "UI.CombatInterface"]),
    ("Weapon/Armor/Object Stats", r"/Stats/Generated/Data/(Weapon|Armor|Object)\.txt$", "WeaponArmorObject", ["Item.Unknown", "Ability.WeaponAction", "UI.Tooltip"]),
    ("Root Templates", r"/RootTemplates/[^/]+\.(lsf|lsx)$", "RootTemplate", ["Item.Unknown", "Ability.Unknown", "UI.Tooltip"]),
    ("UI/GUI definitions", r"\.xaml$", "Xaml", ["UI.Unknown"]),
    ("Tutorial definitions", r"Tutorial[^/]*\.(xaml|lsx|lsf|txt)$", "Tutorial", ["UI.Tutorial"]),
    ("System message definitions", r"(SystemMessage|MessageBox|Notification)[^/]*\.(xaml|lsx|lsf|txt)$", "SystemMessage", ["UI.SystemPrompt", "UI.ErrorMessage"]),
]
#: Domain by the first keyword that a path holds.
KEYWORDS = [
    ("AbilityOrSkill", "ability|spell|status|passive"),
    ("ItemsAndEquipment", "item|armor|weapon"),
    ("TutorialAndSystem", "tutorial|system"),
    ("UserInterface", "ui|hud|tooltip"),
]
#: Workstream by the first pattern that the evidence meets.
WORKSTREAMS = [
    ("AbilitySkill", r"(?i)Ability\.|SpellData|StatusData|PassiveData|InterruptData|Progression|ActionResource|ClassFeature|Feat"),
    ("ItemsEquipment", r"(?i)Root Templates|GameObjects|Weapon|Armor|\bItem\b|Template"),
    ("TutorialSystem", r"(?i)Tutorial definitions|UnifiedTutorial|ModalTutorial|Tutorials/|SystemMessage"),
    ("UserInterface", r"(?i)UI\.Other|UI/GUI definitions|XAML|MainUI/GUI|\bGUI\b"),
]
#: Packages in scope, modules that count as families of their own, and the family of engine screens.
PACKAGES = ("Game.pak", "Gustav.pak", "GustavX.pak", "Patch8_HotFix9.pak", "Shared.pak")
MODULES, SCREENS = ("Shared", "SharedDev", "Gustav", "GustavDev", "GustavX"), "Engine/Game UI projection"
#: Roles of a provider.
CANDIDATE, CONTEXT, PROVENANCE = "CandidateEvidence", "ContextEvidenceOnly", "ContextEvidenceAndCollisionProvenance"


def path_domain(path: Column) -> Column:
    """The domain of a file by keywords in its path."""
    return first_rule(KEYWORDS, F.lower(path), "GenericUiSkill")


def resource_format(path: Column) -> Column:
    """The format of a file by its name; text files count as stats below a stats folder."""
    p = F.lower(path)
    return F.when(p.endswith(".xaml"), "XAML").when(p.endswith(".lsx"), "LSX").when(p.endswith(".lsf"), "LSF").when(p.endswith(".txt") & p.contains("/stats/"), "StatsTXT").when(p.endswith(".txt"), "OtherTXT").otherwise("Unknown")


def role(package: Column, path: Column, module: Column, families: Column, format_name: Column) -> Column:
    """What a provider's evidence counts for: candidates, context only, or context that also explains collisions."""
    p = F.lower(F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")))
    stats = p.contains("/stats/generated/data/")
    shared = (package == "Shared.pak") & (stats | p.contains("/story/rawfiles/goals/"))
    other = (package == "GustavX.pak") & (format_name == "StatsTXT") & stats
    passive = (package == "Gustav.pak") & p.endswith("/passive.txt")
    projectile = (package == "Gustav.pak") & (module == "Honour") & F.array_contains(families, "SpellData") & p.endswith("/spell_projectile.txt")
    boost = shared & module.isin("Shared", "SharedDev") & F.array_contains(families, "StatusData") & p.endswith("/status_boost.txt")
    return F.when(boost, PROVENANCE).when(shared | other | passive | projectile, CONTEXT).otherwise(CANDIDATE)


def discover(entries: DataFrame, families: list[tuple[str, str, str, list[str]]] = FAMILIES, packages: tuple[str, ...] = PACKAGES) -> DataFrame:
    """Entries (package, internal_path) of the packages in scope and of a known family, with format, module, families, subfamilies, domains, role and collision.

    Unsafe paths are left out. Rules are expressions of the scan, so nothing is
    joined; a collision is one normalised path in several packages.
    """
    path = F.regexp_replace(F.replace(F.col("internal_path"), F.lit("\\"), F.lit("/")), "^/+", "")
    rows = entries.where(F.col("package").isin(*packages)).withColumn("internal_path", path).where(~F.col("internal_path").rlike(r"^$|:|\x00|[*?\[\]]|(^|/)\.\.(/|$)"))
    probe = F.concat(F.lit("/"), F.col("internal_path"))
    met = F.array_compact(F.array(*[F.when(probe.rlike("(?i)" + pattern), F.struct(F.lit(name).alias("n"), F.lit(sub).alias("s"), F.array(*[F.lit(d) for d in domains]).alias("d"))) for name, pattern, sub, domains in families]))
    rows = rows.withColumn("_met", met).where(F.size("_met") > 0)
    found = F.regexp_extract("internal_path", "(?i)^(Public|Mods)/([^/]+)/", 2)
    rows = rows.withColumn("resource_format", resource_format(F.col("internal_path"))).withColumn("module", F.when(found != "", found).otherwise("Unresolved"))
    screen = (F.col("resource_format") == "XAML") & ((F.col("module") == "Game") | probe.contains("/GUI/"))
    more = F.array_compact(F.array(F.when(F.col("module").isin(*MODULES), F.concat("module", F.lit(" module projection"))), F.when(screen, SCREENS)))
    named = rows.select(
        "package",
        "internal_path",
        "resource_format",
        "module",
        F.array_sort(F.array_union(F.transform("_met", lambda m: m["n"]), more)).alias("families"),
        F.array_sort(F.array_distinct(F.transform("_met", lambda m: m["s"]))).alias("subfamilies"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_met", lambda m: m["d"])))).alias("domains"),
    )
    same = Window.partitionBy(F.lower("internal_path"))
    collides = F.min("package").over(same) != F.max("package").over(same)
    return named.withColumn("role", role(F.col("package"), F.col("internal_path"), F.col("module"), F.col("families"), F.col("resource_format"))).withColumn("collision", collides)


def provider_domains(path: Column, families: Column, otherwise: Column) -> Column:
    """Domains of a provider by its families, those of the interface by its path."""
    said = F.array_join(families, " ")
    screen = F.when(path.rlike("(?i)Tutorial"), "UI.Tutorial").when(path.rlike("(?i)Error|Message|Notification"), "UI.SystemPrompt").when(path.rlike("(?i)Inventory|Equipment"), "UI.Inventory").when(path.rlike("(?i)HUD|Hotbar|ActionResource"), "UI.HUD").otherwise("UI.Unknown")
    return (
        F.when(said.rlike("(?i)UI|Tutorial|System"), F.array(screen))
        .when(said.rlike("(?i)Spell|Passive|Status|Interrupt|Progression|Class|Feat|ActionResource"), F.array(F.lit("Ability.Unknown")))
        .when(said.rlike("(?i)Weapon|Armor|Object|Template"), F.array(F.lit("Item.Unknown")))
        .when(F.size(otherwise) > 0, otherwise)
        .otherwise(F.array(F.lit("Unknown")))
    )


def universe(occurrences: DataFrame, held: DataFrame, referenced: DataFrame) -> DataFrame:
    """content_uid, status, workstream, n_rows of each key.

    ``occurrences``: content_uid, domains, families (arrays), entity_type, provider,
    comment_only. Rows outside comments count; where there is none, all do. Each row
    is tested by itself and only flags are combined, so a hot key costs a few bits.
    """
    text = F.concat_ws(" ", F.array_join("domains", " "), F.array_join("families", " "), "entity_type", "provider")
    flags = occurrences.select("content_uid", "comment_only", *[text.rlike(p).alias(f"_w{i}") for i, (_, p) in enumerate(WORKSTREAMS)])
    spoken = ~F.col("comment_only")
    per = flags.groupBy("content_uid").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(spoken).alias("_any"), *[x for i in range(len(WORKSTREAMS)) for x in (F.bool_or(F.col(f"_w{i}") & spoken).alias(f"_a{i}"), F.bool_or(f"_w{i}").alias(f"_b{i}"))])
    stream = F.when(F.col("_r").isNotNull(), "AQResourceReferencedReview")
    for i, (name, _) in enumerate(WORKSTREAMS):
        stream = stream.when(F.when(F.col("_any"), F.col(f"_a{i}")).otherwise(F.col(f"_b{i}")), name)
    marked = per.join(held.select("content_uid").distinct().withColumn("_h", F.lit(True)), "content_uid", "left").join(referenced.select("content_uid").distinct().withColumn("_r", F.lit(True)), "content_uid", "left")
    return marked.select("content_uid", F.when(F.col("_h").isNotNull(), "Hold").otherwise("Eligible").alias("status"), stream.otherwise("OtherMultiDomain").alias("workstream"), "n_rows")


def layer_holds(occurrences: DataFrame, path: str, package: str, key: str, first: str, second: str) -> DataFrame:
    """path, key: keys that only one of two packages has at a path, where both have some."""
    rows = occurrences.where(F.col(package).isin(first, second))
    per = rows.groupBy(F.lower(path).alias(path), key).agg(F.bool_or(F.col(package) == first).alias("_a"), F.bool_or(F.col(package) == second).alias("_b"))
    both = per.groupBy(path).agg(F.bool_or("_a").alias("_x"), F.bool_or("_b").alias("_y")).where("_x AND _y").select(path)
    return per.where("_a <> _b").join(both, path, "left_semi").select(path, key)
