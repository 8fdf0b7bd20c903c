"""Recursive closures as loops of joins that stop when nothing is new.

Each round's frontier is a distributed join; only its size comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled


def closure(edges: DataFrame, src: str, dst: str, levels: int = 100) -> DataFrame:
    """start, node, depth: every node reachable from start and the least number of steps; start itself is left out."""
    steps = settled(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct())
    frontier = steps.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).alias("depth"))
    reached = settled(frontier)
    for depth in range(2, levels + 1):
        near = reached.where(F.col("depth") == depth - 1)
        step = near.join(steps, near["node"] == steps["a"]).where("start <> b").select("start", F.col("b").alias("node")).distinct()
        new = step.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        new = settled(new)
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
    raise ValueError(f"deeper than {levels} levels")


def parent_candidates(children: DataFrame, definitions: DataFrame) -> DataFrame:
    """Children with the definitions they may inherit from: same name as ``using``, compatible type, not themselves."""
    c, d = children.alias("c"), definitions.alias("d")
    fits = (F.col("c.using") == F.col("d.name")) & (F.col("c.entity_type").isNull() | F.col("d.entity_type").isNull() | (F.col("c.entity_type") == F.col("d.entity_type"))) & (F.col("c.id") != F.col("d.id"))
    return c.join(d, fits).select(F.col("c.id").alias("child_id"), F.col("d.id").alias("parent_id"))


def unique_parents(candidates: DataFrame) -> DataFrame:
    """Children with exactly one candidate, and it."""
    return candidates.groupBy("child_id").agg(F.count_distinct("parent_id").alias("n"), F.min("parent_id").alias("parent_id")).where("n = 1").drop("n")


def precedence(candidates: DataFrame, direct: DataFrame, transitive: DataFrame) -> DataFrame:
    """How a child's candidates resolve over module dependencies: direct, transitive, ambiguous or unproven.

    ``candidates``: child, module of the child, candidate, module of the candidate.
    """
    near = direct.select(F.col("a").alias("child_module"), F.col("b").alias("candidate_module"), F.lit(1).alias("d")).distinct()
    far = transitive.select(F.col("start").alias("child_module"), F.col("node").alias("candidate_module"), F.lit(1).alias("t")).distinct()
    joined = candidates.join(near, ["child_module", "candidate_module"], "left").join(far, ["child_module", "candidate_module"], "left")
    counts = joined.groupBy("child").agg(F.count(F.lit(1)).alias("n_candidates"), F.count("d").alias("n_direct"), F.count("t").alias("n_transitive"))
    status = F.when(F.col("n_direct") == 1, "direct").when((F.col("n_direct") == 0) & (F.col("n_transitive") == 1), "transitive").when(F.col("n_direct") + F.col("n_transitive") > 0, "ambiguous").otherwise("unproven")
    return counts.withColumn("status", status)


def signature(definition: dict[str, str]) -> Column:
    """Hash of a definition's type, parent and fields in the order of their names; ``definition`` names the three columns."""
    fields = F.array_sort(F.transform(F.map_entries(definition["fields"]), lambda e: F.array(e["key"], e["value"])))
    return F.sha2(F.to_json(F.struct(F.coalesce(definition["entity_type"], F.lit("")).alias("type"), F.coalesce(definition["using"], F.lit("")).alias("using"), fields.alias("fields"))), 256)


def equivalent(definitions: DataFrame, *keys: str) -> DataFrame:
    """keys, n_definitions, n_signatures, is_equivalent: whether all definitions of a key say the same."""
    rows = definitions.select(*keys, signature({"entity_type": "entity_type", "using": "using", "fields": "fields"}).alias("_s"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_definitions"), F.count_distinct("_s").alias("n_signatures")).withColumn("is_equivalent", F.col("n_signatures") <= 1)


def _fits(a: str, b: str) -> Column:
    """Whether two entity types agree or one is unknown."""
    a, b = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    return (a == "") | (b == "") | (a == b)


def lineage_uids(occurrences: DataFrame, definitions: DataFrame, contains, levels: int = 100) -> DataFrame:
    """edge_id, content_uid: the keys that meet an unresolved parent on the way up from where they stand.

    ``occurrences``: content_uid, provider, entity_name, entity_type, field_name;
    ``definitions``: id, provider, name, entity_type, using, fields (map).
    ``contains(value, uid)`` says whether a field holds a key. An occurrence starts
    at the one definition of its provider, name and type, or at the one of several
    whose field holds it; others start nowhere. A parent is the one definition of the
    same provider that bears the name, the definition's own name included. An edge is
    unresolved where the parent bears the definition's own name or there is no single one.
    """
    d = definitions.select(F.col("id").alias("child_id"), "provider", F.col("name").alias("_own"), F.col("entity_type").alias("_t"), F.nullif("using", F.lit("")).alias("_up"))
    p = definitions.select("provider", F.col("name").alias("_up"), F.col("id").alias("parent_id"), F.col("entity_type").alias("_pt"))
    one = unique_parents(d.join(p, ["provider", "_up"]).where(F.col("child_id") != F.col("parent_id")).where(_fits("_t", "_pt")))
    edges = settled(d.where("_up IS NOT NULL").join(one, "child_id", "left").select(F.col("child_id").alias("id"), "parent_id", ((F.col("_own") == F.col("_up")) | F.col("parent_id").isNull()).alias("open")))
    o = occurrences.select("content_uid", "provider", F.col("entity_name").alias("name"), F.when(F.col("entity_type") != "StatsRecord", F.col("entity_type")).alias("_ot"), "field_name").distinct()
    met = o.join(definitions.select("id", "provider", "name", "entity_type", "fields"), ["provider", "name"]).where(_fits("_ot", "entity_type"))
    held = F.coalesce(contains(F.col("fields")[F.col("field_name")], F.col("content_uid")), F.lit(False))
    place = met.groupBy("content_uid", "provider", "name", "_ot", "field_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("h"), F.min("id").alias("only"), F.min(F.when(held, F.col("id"))).alias("exact"))
    at = settled(place.select("content_uid", F.when(F.col("n") == 1, F.col("only")).when(F.col("h") == 1, F.col("exact")).alias("id")).where("id IS NOT NULL").distinct())
    reached = at
    for _ in range(levels):
        up = at.join(edges.where("parent_id IS NOT NULL"), "id").select("content_uid", F.col("parent_id").alias("id")).distinct()
        at = settled(up.join(reached, ["content_uid", "id"], "left_anti"))
        if at.isEmpty():
            return reached.join(edges.where("open"), "id").select(F.col("id").alias("edge_id"), "content_uid")
        reached = reached.unionByName(at)
    raise ValueError(f"deeper than {levels} levels")
