"""Fusion of ranked lists, gates and floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written

#: The constant of reciprocal-rank fusion.
DAMPING = 60


def ranked(scored: DataFrame, group: str, key: str, score: str = "score", k: int | None = None) -> DataFrame:
    """group, key, rank (from 1)."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).select(group, key, "rank")
    return out if k is None else out.where(F.col("rank") <= k)


def fused(lists: list[DataFrame], group: str, key: str) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (60 + rank) over the lists, rounded at 1e-9 before it orders."""
    union = lists[0]
    for x in lists[1:]:
        union = union.unionByName(x)
    return union.groupBy(group, key).agg(F.round(F.sum(1 / (DAMPING + F.col("rank"))), 9).alias("score"))


def above_floor(scored: DataFrame, group: str, share: float = 0.4, score: str = "score") -> DataFrame:
    """Rows that reach a share of their group's best score; the best itself always stays."""
    best = scored.withColumn("__best", F.max(score).over(Window.partitionBy(group)))
    return best.where(F.col(score) >= share * F.col("__best")).drop("__best")


def gated(candidates: DataFrame, similar: DataFrame, key: list[str]) -> DataFrame:
    """Only candidates that the similarity list has as well."""
    return candidates.join(similar, key, "left_semi")


def hybrid(keyword: DataFrame, group: str, key: str, near: DataFrame | None, gate: float | None, words: DataFrame | None) -> DataFrame:
    """group, key, score: the keyword list (with rank) and the vector list (with score) fused.

    ``gate`` is for material that nobody asked for: with vectors only what is as similar as that stays; without them
    a question needs two content words (``words``: group, words), and no more than four of its documents stay.
    """
    if near is None:
        out = fused([keyword], group, key)
        if gate is None:
            return out
        enough = words.where(F.col("words") >= 2).select(group)
        top = ranked(out, group, key, k=4).select(group, key)
        return out.join(enough, group, "left_semi").join(top, [group, key], "left_semi")
    if gate is not None:
        near = written(near, "near")  # the fusion and the gate read it
    out = fused([keyword, ranked(near, group, key)], group, key)
    return out if gate is None else gated(out, near.where(F.col("score") >= gate), [group, key])


def within_budget(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows in order as long as their sizes' running sum fits; stops at the first that does not."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def fitting(sizes: list[int], budget: int) -> list[int]:
    """Positions of a short ordered list that fit when one that does not is skipped."""
    left, out = budget, []
    for i, n in enumerate(sizes):
        if n <= left:
            left -= n
            out.append(i)
    return out
