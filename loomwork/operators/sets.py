"""Set algebra over keys and ordered, disjoint partitions of a universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a boolean per set, by one aggregation instead of a join per set."""
    tagged = [df.select(key, F.lit(name).alias("_set")) for name, df in sets.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*[F.bool_or(F.col("_set") == n).alias(f"in_{n}") for n in sets])


def overlap_matrix(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """left, right, n_left, n_right, n_both, n_union, disjoint for each pair of sets."""
    names = list(sets)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    has = lambda n: F.col(f"in_{n}")
    counts = membership(sets, key).agg(*[F.count_if(has(n)).alias(f"n_{n}") for n in names], *[F.count_if(has(a) & has(b)).alias(f"b_{a}_{b}") for a, b in pairs])
    row = lambda a, b: F.struct(F.lit(a).alias("left_set"), F.lit(b).alias("right_set"), F.col(f"n_{a}").alias("n_left"), F.col(f"n_{b}").alias("n_right"), F.col(f"b_{a}_{b}").alias("n_both"))
    out = counts.select(F.inline(F.array(*[row(a, b) for a, b in pairs])))
    return out.withColumn("n_union", F.col("n_left") + F.col("n_right") - F.col("n_both")).withColumn("disjoint", F.col("n_both") == 0)


def algebra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with the relations it is in: both, only one, and so the symmetric difference."""
    both = membership({"a": a, "b": b}, key)
    return both.select(key, F.when(F.col("in_a") & F.col("in_b"), "intersect").when(F.col("in_a"), "left-only").otherwise("right-only").alias("relation"))


def boundary(conflicts: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Conflicts without the accepted keys; accepted keys outside the conflicts are an error."""
    foreign = accepted.select(key).join(conflicts.select(key), key, "left_anti")
    if not foreign.isEmpty():
        raise ValueError("accepted keys outside the conflicts")
    return conflicts.select(key).distinct().join(accepted.select(key), key, "left_anti")


def first_class(classes: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds: an ordered, disjoint partition."""
    out = F.when(F.lit(False), "")
    for condition, name in classes:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(otherwise)


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, or an error where a key is null, empty or repeated."""
    bad = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys]))
    if not bad.isEmpty():
        raise ValueError(f"{', '.join(keys)}: null, empty or repeated")
    return rows


def require_equal_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error that names how many keys are missing or foreign on either side."""
    counts = algebra(left, right, key).groupBy("relation").count().where("relation <> 'intersect'").collect()  # two rows at most
    if counts:
        raise ValueError("; ".join(f"{r.relation}: {r['count']}" for r in counts))


def union_keys(sets: list[DataFrame], key: str) -> DataFrame:
    """Keys in any of the sets, each once."""
    return reduce(DataFrame.unionByName, [s.select(key) for s in sets]).distinct()


def shared_beyond(a: DataFrame, b: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Keys in both sets that the existing ones lack, by one aggregation."""
    rows = membership({"a": a, "b": b, **({"existing": existing} if existing is not None else {})}, key)
    return rows.where("in_a AND in_b" + (" AND NOT in_existing" if existing is not None else "")).select(key)
