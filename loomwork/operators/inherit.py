"""Layered definitions, inheritance and its reconciliation.

Chains are followed by doubling: after round k a node knows what lies within 2 ** k steps,
so a chain of thousands takes a dozen joins, and a cycle is what has not ended when the
steps outnumber the nodes. First values are aggregates of structs: rows combine before
the shuffle, and no group is ever held as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .graph import signature


def layered_fields(layers: DataFrame, key: str, order: list[str], using: str, fields: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What layered definitions come to: a row for each key, and a row for each of its fields.

    ``layers``: key, columns of ``order`` (the greatest comes first), ``using`` (the
    definition it builds on, its own name to build on the next layer), ``fields`` (a map)
    and columns to ``keep``. Layers are walked in order; the first value of a field holds,
    a null among them; the first layer that uses another name is the last one walked.

    The first table: key, n_layers, using (of the layer that ended the walk, empty if none
    did), and the columns kept of the first layer. The second: key, field, value and those
    columns of the layer that brings it. Layers that agree in all of ``order`` follow
    each other in the order of their other columns.
    """
    place = F.struct(*order, F.coalesce(F.col(using), F.lit("")).alias("_using"), *[F.col(c) for c in keep if c not in order])
    rows = layers.select(key, place.alias("_at"), F.coalesce(F.col(using), F.lit("")).alias("_using"), F.col(fields).alias("_fields"))
    ends = F.when(F.col("_using") != F.col(key).cast("string"), F.col("_at"))
    heads = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_layers"), F.max("_at").alias("_first"), F.max(ends).alias("_last"))
    brought = rows.select(key, "_at", F.explode("_fields").alias("field", "value")).groupBy(key, "field").agg(F.max(F.struct("_at", "value")).alias("_won"))
    walked = brought.join(heads.select(F.col(key).alias("_key"), "_last"), F.col(key) == F.col("_key")).where(F.col("_last").isNull() | (F.col("_won._at") >= F.col("_last")))
    top = heads.select(key, "n_layers", F.coalesce(F.col("_last._using"), F.lit("")).alias("using"), *[F.col(f"_first.{c}").alias(c) for c in keep])
    return top, walked.select(key, "field", F.col("_won.value").alias("value"), *[F.col(f"_won._at.{c}").alias(c) for c in keep])


def _rounds(n: int) -> int:
    """Doublings after which more steps are taken than there are nodes."""
    return max(1, n).bit_length() + 1


def nearest(nodes: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """key, depth, owner, value, ends: the nearest node on the way up, itself first, that has a value.

    ``ends`` says how the way ended: value, root (no parent, or itself), missing (a parent
    that is no node; it counts as a step) or cycle (null depth). Keys must be unique and
    not null.
    """
    links = nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_up"), F.col(value).alias("_v"))
    known = links.select(F.col("_k").alias("_p"))
    met = links.join(known, F.col("_up") == F.col("_p"), "left")
    here, top = F.col("_v").isNotNull(), F.col("_up").isNull() | (F.col("_up") == F.col("_k"))
    ends = F.when(here, "value").when(top, "root").when(F.col("_p").isNull(), "missing")
    state = settled(met.select("_k", F.when(here | top, F.col("_k")).otherwise(F.col("_up")).alias("to"), F.when(here | top, 0).otherwise(1).cast("long").alias("depth"), ends.alias("ends")))
    for _ in range(_rounds(state.count())):
        going = state.where("ends IS NULL")
        if going.isEmpty():
            break
        ahead = state.select(F.col("_k").alias("_a"), F.col("to").alias("_to"), F.col("depth").alias("_more"), F.col("ends").alias("_ends"))
        moved = going.join(ahead, F.col("to") == F.col("_a")).select("_k", F.col("_to").alias("to"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_ends").alias("ends"))
        state = settled(state.where("ends IS NOT NULL").unionByName(moved))
    owner = F.when(F.col("ends") == "value", F.col("to"))
    found = state.select(F.col("_k").alias(key), F.when(F.col("ends").isNotNull(), F.col("depth")).alias("depth"), owner.alias("owner"), F.coalesce("ends", F.lit("cycle")).alias("ends"))
    values = links.where("_v IS NOT NULL").select(F.col("_k").alias("_o"), F.col("_v").alias("value"))
    return found.join(values, F.col("owner") == F.col("_o"), "left").select(key, "depth", "owner", "value", "ends")


def _jumps(entities: DataFrame, key: str, using: str) -> DataFrame:
    """_k, _p (the node a jump leads to, null at the end of a way), steps and ends, for jumps of one step."""
    up = F.when(F.coalesce(F.col(using), F.lit("")) != "", F.col(using))
    links = entities.select(F.col(key).alias("_k"), up.alias("_up"))
    met = links.join(links.select(F.col("_k").alias("_p")), F.col("_up") == F.col("_p"), "left")
    return met.select("_k", "_p", F.lit(1).cast("long").alias("steps"), F.when(F.col("_up").isNull(), "root").when(F.col("_p").isNull(), "missing").alias("ends"))


def _doubled(going: DataFrame, jump: DataFrame) -> DataFrame:
    ahead = jump.select(F.col("_k").alias("_a"), F.col("_p").alias("_q"), F.col("steps").alias("_more"), F.col("ends").alias("_ends"))
    return going.join(ahead, F.col("_p") == F.col("_a")).select("_k", F.col("_q").alias("_p"), (F.col("steps") + F.col("_more")).alias("steps"), F.col("_ends").alias("ends"))


def inheritance_end(entities: DataFrame, key: str, using: str) -> DataFrame:
    """key, ends (root, missing or cycle): how the way up of each entity ends, without anything that it inherits.

    While a way has an end ahead, some node stands at every distance from that end, so
    each round ends some way; a round that ends none leaves cycles alone. Ways that ended
    are written once, when they do; only those that go on are carried from round to round.
    """
    state = settled(_jumps(entities, key, using))
    done, going = state.where("_p IS NULL").select("_k", "ends"), state.where("_p IS NOT NULL")
    left = going.count()
    while left:
        # A jump that leads to a node whose way has ended takes over its end.
        moved = _doubled(going, going.unionByName(done.withColumn("_p", F.lit(None).cast(going.schema["_p"].dataType)).withColumn("steps", F.lit(0).cast("long"))))
        state = settled(moved.coalesce(_parts(entities)))
        done, going = done.unionByName(state.where("_p IS NULL").select("_k", "ends")), state.where("_p IS NOT NULL")
        before, left = left, going.count()
        if left == before:
            break
    return done.unionByName(going.select("_k", F.lit("cycle").alias("ends"))).select(F.col("_k").alias(key), "ends")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def inherited(entities: DataFrame, fields: DataFrame, key: str, using: str, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every field that an entity has or inherits, and how its way up ends.

    ``entities``: key and ``using`` (empty or null for none); ``fields``: key, field and
    what else belongs to a value. The nearest definition of a field shadows those further
    up; a way that comes back to a node it has met ends there.

    The first table: key, field, owner, depth (0: its own), then the columns of ``fields``.
    The second: key, ends (root, missing or cycle), as a row for each entity.

    Of the nodes between one and the owner of what it inherits, each inherits the same: a
    round that ends no way and brings no field leaves nothing to come, cycles or not.
    """
    rest = [c for c in fields.columns if c not in (key, "field")]
    own = fields.select(F.col(key).alias("_k"), "field", F.struct(F.lit(0).cast("long").alias("depth"), F.col(key).cast("string").alias("owner"), *rest).alias("_at"))
    jump = settled(_jumps(entities, key, using))
    values = settled(own.groupBy("_k", "field").agg(F.min("_at").alias("_at")))
    before = None
    while True:
        going = jump.where("_p IS NOT NULL")
        after = going.count(), values.count()
        if not after[0] or after == before:
            break
        before = after
        far = values.select(F.col("_k").alias("_p"), "field", F.col("_at"))
        at = F.struct((F.col("_at.depth") + F.col("steps")).alias("depth"), F.col("_at.owner").alias("owner"), *[F.col(f"_at.{c}").alias(c) for c in rest])
        brought = going.join(far, "_p").select("_k", "field", at.alias("_at"))
        values = settled(values.unionByName(brought).groupBy("_k", "field").agg(F.min("_at").alias("_at")))
        # Partitions must not add up from round to round.
        jump = settled(jump.where("_p IS NULL").unionByName(_doubled(going, jump)).coalesce(_parts(entities)))
    table = values.select(F.col("_k").alias(key), "field", F.col("_at.owner").alias("owner"), F.col("_at.depth").alias("depth"), *[F.col(f"_at.{c}").alias(c) for c in rest])
    return table, jump.select(F.col("_k").alias(key), F.coalesce("ends", F.lit("cycle")).alias("ends"))


def inheritance_counts(ends: DataFrame, table: DataFrame) -> DataFrame:
    """One row: own and inherited relations, entities whose way ends at a missing parent, and in a cycle."""
    found = table.agg(F.count_if(F.col("depth") == 0).alias("explicit_relations"), F.count_if(F.col("depth") > 0).alias("inherited_relations"))
    return found.join(ends.agg(F.count(F.lit(1)).alias("effective_entities"), F.count_if(F.col("ends") == "missing").alias("missing_parents"), F.count_if(F.col("ends") == "cycle").alias("cycles_detected")), F.lit(True))


# Reconciliation of parents -----------------------------------------------------------------


def _compatible(a: str, b: str) -> Column:
    a, b = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    return (a == "") | (b == "") | (a == b)


def module_of(path: Column) -> Column:
    """The folder under Public or Mods that a path lies in, else empty."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:Public|Mods)/([^/]*)(?:/|$)", 1)


def reconcile(candidates: DataFrame, support: DataFrame, modules: DataFrame, direct: DataFrame, transitive: DataFrame) -> DataFrame:
    """child_id, status, n_candidates, selected_id: how each definition's parent is settled.

    ``candidates`` and ``support``: id, name, entity_type, using, fields (map), provider,
    internal_path; of definitions with one id the candidate's holds. ``modules``: folder,
    uuid, one row for each folder; ``direct`` (a, b) and ``transitive`` (start, node):
    modules on which a module depends. A row for each candidate that uses something.

    By order: a single definition of the same provider; a single compatible one; equal
    ones; several (ambiguous). A definition that uses its own name is settled by its module's
    dependencies: one direct, else one transitive, several, equal ones with itself,
    else unproven, or not covered where a module is not known.

    Definitions of one name meet as classes (type, provider, module, content), with counts:
    many equal definitions are one row.
    """
    rows = candidates.select("id", "name", "entity_type", "using", "fields", "provider", "internal_path", F.lit(0).alias("_r")).unionByName(support.select("id", "name", "entity_type", "using", "fields", "provider", "internal_path", F.lit(1).alias("_r")))
    columns = ["name", "entity_type", "using", "fields", "provider", "internal_path", "_r"]
    # The first of an id; a map cannot be compared, so its entries in order stand for it until it is chosen.
    entries = F.array_sort(F.map_entries("fields"))
    one = rows.withColumn("fields", entries).groupBy("id").agg(F.min(F.struct("_r", *[c for c in columns if c != "_r"])).alias("w")).select("id", *[F.col(f"w.{c}").alias(c) for c in columns])
    one = one.withColumn("fields", F.map_from_entries("fields"))
    known = modules.select(F.col("folder").alias("_folder"), F.col("uuid").alias("module"))
    signed = one.select("id", "name", "entity_type", F.coalesce("using", F.lit("")).alias("using"), "provider", "_r", signature({"entity_type": "entity_type", "using": "using", "fields": "fields"}).alias("says"), module_of(F.col("internal_path")).alias("_folder"))
    signed = settled(signed.join(known, "_folder", "left").drop("_folder"))
    classes = signed.groupBy("name", "entity_type", "provider", "module", "says").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    child = signed.where((F.col("_r") == 0) & (F.col("using") != "")).select(F.col("id").alias("child_id"), F.col("name").alias("c_name"), F.col("entity_type").alias("c_type"), "using", F.col("provider").alias("c_provider"), F.col("module").alias("c_module"), F.col("says").alias("c_says"))
    own = (F.col("c_name") == F.col("name")) & F.col("entity_type").eqNullSafe(F.col("c_type")) & F.col("provider").eqNullSafe(F.col("c_provider")) & F.col("module").eqNullSafe(F.col("c_module")) & (F.col("says") == F.col("c_says"))
    others = F.col("n") - F.when(own, 1).otherwise(0)
    other_id = F.when(own & (F.col("low") == F.col("child_id")), F.col("high")).otherwise(F.col("low"))
    met = child.join(classes, (F.col("using") == F.col("name")) & _compatible("c_type", "entity_type")).withColumn("others", others).where("others > 0").withColumn("other_id", other_id)
    near, far = direct.select(F.col("a").alias("c_module"), F.col("b").alias("module"), F.lit(True).alias("near")).distinct(), transitive.select(F.col("start").alias("c_module"), F.col("node").alias("module"), F.lit(True).alias("far")).distinct()
    met = met.join(near, ["c_module", "module"], "left").join(far, ["c_module", "module"], "left")
    is_near, is_far = F.coalesce("near", F.lit(False)), F.coalesce("far", F.lit(False)) & F.col("near").isNull()
    same = F.col("provider").eqNullSafe(F.col("c_provider"))
    count = lambda c: F.sum(F.when(c, F.col("others")).otherwise(0))
    first = lambda c: F.min(F.when(c, F.col("other_id")))
    parts = met.groupBy("child_id").agg(
        F.sum("others").alias("n_candidates"),
        count(same).alias("n_same"),
        count(is_near).alias("n_direct"),
        count(is_far).alias("n_transitive"),
        F.count_distinct("says").alias("n_says"),
        F.count_distinct(F.when(F.col("says") != F.col("c_says"), F.col("says"))).alias("n_differ"),
        F.bool_or(F.col("module").isNull()).alias("uncovered"),
        first(F.lit(True)).alias("any_id"),
        first(same).alias("same_id"),
        first(is_near).alias("direct_id"),
        first(is_far).alias("transitive_id"),
    )
    got = child.join(parts, "child_id", "left")
    itself = F.col("c_name") == F.col("using")
    status = (
        F.when(F.col("n_candidates").isNull(), "InheritedReferenceMissingParent")
        .when(~itself & (F.col("n_same") == 1), "ResolvedSameProviderDefinition")
        .when(~itself & (F.col("n_candidates") == 1), "ResolvedUniqueCompatibleDefinition")
        .when(~itself & (F.col("n_says") == 1), "EquivalentProviderDefinition")
        .when(~itself, "AmbiguousMultipleDefinitions")
        .when(F.col("c_module").isNull(), "MetadataDoesNotCoverProvider")
        .when(F.col("n_direct") == 1, "ResolvedByDirectModuleDependency")
        .when((F.col("n_direct") == 0) & (F.col("n_transitive") == 1), "ResolvedByTransitiveModuleDependency")
        .when(F.col("n_direct") + F.col("n_transitive") > 0, "AmbiguousMultiplePriorProviders")
        .when(F.col("n_differ") == 0, "EquivalentProviderDefinition")
        .when(F.col("uncovered"), "MetadataDoesNotCoverProvider")
        .otherwise("SupportedButRuntimeWinnerUnproven")
    )
    selected = F.when(F.col("status") == "ResolvedSameProviderDefinition", F.col("same_id")).when(F.col("status") == "ResolvedUniqueCompatibleDefinition", F.col("any_id")).when(F.col("status") == "ResolvedByDirectModuleDependency", F.col("direct_id")).when(F.col("status") == "ResolvedByTransitiveModuleDependency", F.col("transitive_id"))
    return got.withColumn("status", status).select("child_id", itself.alias("itself"), "status", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), selected.alias("selected_id"))


#: Statuses of a definition that uses its own name which leave the keys that meet it in doubt.
DOUBTFUL = ("SupportedButRuntimeWinnerUnproven", "MetadataDoesNotCoverProvider", "AmbiguousMultiplePriorProviders")


def outcome(edges: DataFrame, related: DataFrame, targets: DataFrame, layer_holds: DataFrame) -> DataFrame:
    """content_uid, verdict: keys to hold (an ambiguous parent, or ``layer_holds``) and keys to warn of; a key held is not warned of.

    ``edges`` from :func:`reconcile`; ``related``: edge_id, content_uid, from ``graph.lineage_uids``.
    """
    bad = F.when((F.col("status") == "AmbiguousMultipleDefinitions") & ~F.col("itself"), "hold").when(F.col("itself") & F.col("status").isin(*DOUBTFUL), "warning")
    met = edges.select(F.col("child_id").alias("edge_id"), bad.alias("verdict")).where("verdict IS NOT NULL").join(related, "edge_id").select("content_uid", "verdict")
    every = met.unionByName(layer_holds.select("content_uid", F.lit("hold").alias("verdict")))
    return every.join(targets.select("content_uid").distinct(), "content_uid", "left_semi").groupBy("content_uid").agg(F.min("verdict").alias("verdict"))


def outcome_counts(edges: DataFrame) -> DataFrame:
    """One row: ambiguous edges, warned ones that use their own name, equivalent ones, and those that a dependency settles."""
    status = F.col("status")
    return edges.agg(
        F.count_if((status == "AmbiguousMultipleDefinitions") & ~F.col("itself")).alias("ambiguous_edge_count"),
        F.count_if(F.col("itself") & status.isin(*DOUBTFUL)).alias("self_name_warning_edge_count"),
        F.count_if(status == "EquivalentProviderDefinition").alias("equivalent_edge_count"),
        F.count_if(status == "ResolvedByDirectModuleDependency").alias("direct_dependency_resolved_count"),
        F.count_if(status == "ResolvedByTransitiveModuleDependency").alias("transitive_dependency_resolved_count"),
    )
