"""Group keys, oversize splits and next-fit batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_key

#: Records in a batch by category.
LIMITS = {
    "dialogue_general": 1000,
    "bark": 750,
    "quest": 500,
    "skill_spell": 500,
    "item": 500,
    "ui": 500,
    "tutorial": 400,
    "system_message": 400,
    "book_lore": 250,
    "character_world": 500,
}


def group_key(candidates: Column, uid: Column) -> Column:
    """The least normalized candidate, or the row's own key where it has none."""
    clean = F.filter(F.transform(candidates, lambda x: F.lower(F.trim(F.replace(x, F.lit("\\"), F.lit("/"))))), lambda x: x != "")
    return F.coalesce(F.array_min(clean), F.concat(F.lit("uid:"), F.lower(uid)))


def limit_of(limits: dict[str, int], category: Column, otherwise: int = 500) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[category], F.lit(otherwise))


def record_key(subkeys: Column, uid: Column) -> Column:
    """What orders records within a group: their subkeys, normalized and sorted, then the uid in lower case."""
    clean = F.transform(F.filter(subkeys, lambda x: x != ""), normalize_key)
    return F.struct(F.array_sort(clean).alias("subkeys"), F.lower(uid).alias("uid"))


def sort_out(rows: DataFrame, status: str = "status", category: str = "primary_category") -> DataFrame:
    """Rows with ``lane``: excluded, unresolved (not classified, or of no category), or eligible for batches."""
    resolved = (F.col(status) == "classified") & (F.col(category) != "other")
    return rows.withColumn("lane", F.when(F.col(status) == "excluded", "excluded").when(F.coalesce(resolved, F.lit(False)), "eligible").otherwise("unresolved"))


def units(rows: DataFrame, category: str, group: str, limits: dict[str, int]) -> DataFrame:
    """category, group, part, unit, unit_size, is_split: a group, or the parts of at most the category's limit of a larger one.

    Sizes follow from the groups' counts by arithmetic; no row is numbered for it.
    """
    counted = rows.groupBy(category, group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_most", limit_of(limits, F.col(category)))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.col("_most")).cast("int"))))
    split, name = F.col("_n") > F.col("_most"), F.col(group).cast("string")
    unit = F.when(split, F.concat(name, F.format_string("#part-%04d", F.col("part") + 1))).otherwise(name)
    return parts.select(category, group, "part", unit.alias("unit"), F.least(F.col("_most"), F.col("_n") - F.col("part") * F.col("_most")).cast("int").alias("unit_size"), split.alias("is_split"))


def next_fit(sized: DataFrame, category: str, order: list[str], size: str, limits: dict[str, int]) -> DataFrame:
    """Units with their batch number within the category: a unit that does not fit opens the next batch, and none is reopened.

    Each batch depends on the one before, so a category is one ordered stream; it
    is read as such, a block at a time, and nothing of it is held in memory. Units
    are aggregates, far fewer than rows.
    """
    kept = sized.repartition(category).sortWithinPartitions(category, *order)
    schema = sized.schema.add("batch_number", "integer")

    def run(frames):
        name, number, filled = None, 0, 0
        for frame in frames:
            numbers = []
            for c, n in zip(frame[category], frame[size], strict=True):
                if c != name:
                    name, number, filled = c, 1, 0
                if filled and filled + n > limits.get(c, 500):
                    number, filled = number + 1, 0
                filled += n
                numbers.append(number)
            frame["batch_number"] = numbers
            frame["batch_number"] = frame["batch_number"].astype("int32")
            yield frame

    return kept.mapInPandas(run, schema)


def plan(rows: DataFrame, category: str, group: str, order: list, limits: dict[str, int]) -> DataFrame:
    """Rows with part, unit and batch id (category-0001 and so on).

    Only rows of split groups are numbered; all others meet their group.
    """
    numbered = next_fit(units(rows, category, group, limits), category, [group, "part"], "unit_size", limits)
    named = numbered.select(category, group, "part", "unit", "is_split", F.concat_ws("-", F.col(category), F.format_string("%04d", "batch_number")).alias("batch_id"))
    whole = rows.join(named.where("NOT is_split"), [category, group])
    large = rows.join(named.where("is_split AND part = 0").select(category, group), [category, group], "left_semi")
    place = F.row_number().over(Window.partitionBy(category, group).orderBy(*order)) - 1
    large = large.withColumn("part", F.floor(place / limit_of(limits, F.col(category))).cast("int")).join(named.where("is_split"), [category, group, "part"])
    return whole.unionByName(large).drop("is_split")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with a chunk number of ``size`` rows by order.

    Ranges first, then offsets of ranges: no window runs over the whole table.
    """
    # A given number of ranges, which adaptive execution leaves alone: partition ids mean the same in every branch.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_range").withColumn("chunk", F.floor((F.col("_n") + F.col("_before")) / size).cast("int")).drop("_range", "_n", "_before")
