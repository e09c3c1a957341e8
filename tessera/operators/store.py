"""Keyed tables: upserts, merges, deletes with their children, scopes, families, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import written


def upsert(old: DataFrame, new: DataFrame, key: str, fill: list[str], bump: list[str]) -> DataFrame:
    """``new`` into ``old``: known keys get missing ``fill`` values and the later of ``bump``, other keys are added.

    Of several new rows of a key the first by ``bump`` counts.
    """
    w = Window.partitionBy(key).orderBy(*bump)
    new = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in old.columns if c != key])
    out = old.withColumn("__old", F.lit(True)).join(n, key, "full")
    value = lambda c: F.greatest(c, f"__{c}") if c in bump else F.coalesce(c, f"__{c}") if c in fill else F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}"))
    return out.select(key, *[value(c).alias(c) for c in old.columns if c != key])


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def link_once(links: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first link of each pair wins."""
    return keep_latest(links, keys, order)


def delete_with_children(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents and children without the deleted keys."""
    out = {"parents": parents.join(gone, key, "left_anti")}
    for name, (rows, own) in children.items():
        out[name] = rows.join(gone.select(F.col(key).alias("__gone")), rows[own] == F.col("__gone"), "left_anti")
    return out


def scoped(rows: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """No scope: everything. An empty scope: nothing. The two are never the same."""
    return rows if scope is None else rows.join(scope, key, "left_semi")


def beyond(allowed: DataFrame, own: DataFrame, key: str) -> DataFrame:
    return allowed.join(own, key, "left_anti")


#: What a file name may carry besides its subject: versions, states, dates. Fixed by what counts as one family.
VERSION_WORD = r"^(v?\d+|final|draft|copy|revised?|rev|version|signed|clean|new|old|latest|\d{4}|\d{1,2})$"


def family_key(name: Column) -> Column:
    """The subject of a file name: its stem's words without version words; the stem itself if nothing is left."""
    words = F.filter(F.split(F.lower(T.file_stem(name)), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 0) & ~w.rlike(VERSION_WORD))
    key = F.array_join(words, " ")
    return F.when(key == "", F.lower(T.file_stem(name))).otherwise(key)


def families(files: DataFrame, key: str, name: str, created: str) -> DataFrame:
    """family, position (by creation, then key), total, is_latest; only families of two or more.

    Rows are ordered once over all tasks; a family's place in each range of the order is counted, and positions start
    from the counts of the ranges before, so a name that a third of all files have is no single task.
    """
    f = files.withColumn("family", family_key(F.col(name)))
    total = f.groupBy("family").agg(F.count("*").alias("total")).where("total > 1")
    ranged = written(f.join(total, "family").repartitionByRange("family", created, key).withColumn("range", F.spark_partition_id()), "families")
    counts = ranged.groupBy("family", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("family").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("family", "range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("family", "range").orderBy(created, key))
    f = ranged.withColumn("place", place).join(counts, ["family", "range"]).withColumn("position", (F.col("before") + F.col("place")).cast("int"))
    return f.drop("range", "place", "before").withColumn("is_latest", F.col("position") == F.col("total"))


def descendants(edges: DataFrame, root: Column, most: int = 1000) -> DataFrame:
    """All nodes below the roots, with their depth, level by level; a node that was seen is not followed again.

    Each level is written, so the plan of a deep tree stays as short as that of a flat one. A tree deeper than ``most``
    levels is an error.
    """
    level = written(edges.where(root).select(F.col("id").alias("node"), F.lit(0).alias("depth")), "tree")
    found = level
    for depth in range(1, most + 1):
        below = edges.join(level, edges["parent_id"] == level["node"]).select("id").distinct().join(found, F.col("id") == F.col("node"), "left_anti")
        level = written(below.select(F.col("id").alias("node"), F.lit(depth).alias("depth")), "tree")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise RuntimeError(f"the tree goes on below {most} levels")
