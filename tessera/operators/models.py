"""A registry of models: which fit a machine and a use, and in what order they are recommended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GB = 1024**3
# Factors of a score. Memory counts one and a half times a model's size.
MEMORY, TOO_LARGE, TIGHT, NO_GPU, TIGHT_GPU, FORMAT = 1.5, 0.3, 0.7, 0.2, 0.5, 1.2
# For each use the tags that speak for a model, with their factors; the first that holds counts.
USES = {
    "chat": [(("chat", "instruction"), 1.3), (("general",), 1.1)],
    "code": [(("code", "programming"), 1.4)],
    "creative": [(("creative", "story"), 1.3), (("text-generation",), 1.1)],
    "research": [(("research", "analysis"), 1.3)],
    "translation": [(("translation", "multilingual"), 1.4)],
}
# Factors of small, medium and large models for those who want quality, or speed.
WANTED = {"quality": (0.8, 1.1, 1.3), "speed": (1.3, 1.0, 0.6)}


def memory_factor(size: Column, free: Column, total: Column) -> Column:
    """``size`` in bytes; ``free`` and ``total`` in GB."""
    needed = size / GB * MEMORY
    return F.when(needed > free, TOO_LARGE).when(needed > total * 0.8, TIGHT).otherwise(1.0)


def gpu_factor(size: Column, tags: Column, form: Column, has_gpu: Column, video: Column) -> Column:
    """What a model that needs a GPU loses without one, or with one of too little memory (in GB, null if unknown)."""
    needs = F.array_contains(tags, "gpu") | (F.lower(form) == "tensorrt")
    least = F.when(size < 5 * GB, 6.0).when(size < 10 * GB, 12.0).otherwise(24.0)
    return F.when(needs & ~has_gpu, NO_GPU).when(needs & (video < least * 0.8), TIGHT_GPU).otherwise(1.0)


def use_factor(tags: Column, use: Column) -> Column:
    out = F.lit(1.0)
    for name, rules in USES.items():
        factor = F.lit(1.0)
        for wanted, value in reversed(rules):
            factor = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), value).otherwise(factor)
        out = F.when(use == name, factor).otherwise(out)
    return out


def wish_factor(size: Column, wish: Column) -> Column:
    out = F.lit(1.0)
    for name, (small, medium, large) in WANTED.items():
        out = F.when(wish == name, F.when(size < 3 * GB, small).when(size < 10 * GB, medium).otherwise(large)).otherwise(out)
    return out


def compatibility(size: Column, tags: Column, form: Column, free: Column, total: Column, has_gpu: Column, video: Column, formats: Column, use: Column, wish: Column) -> Column:
    """The product of all factors, held between 0 and 1. No tags: none of those that a use asks for."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    preferred = F.when(F.exists(formats, lambda f: F.lower(f) == F.lower(form)), FORMAT).otherwise(1.0)
    score = memory_factor(size, free, total) * gpu_factor(size, tags, form, has_gpu, video) * preferred * use_factor(tags, use) * wish_factor(size, wish)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def recommended(scored: DataFrame, group: str, key: str, score: str, most: int) -> DataFrame:
    """The ``most`` best models of each group, without a score as 0; ties to the smaller key; rank from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def of_category(models: DataFrame, tags: str, category: Column) -> DataFrame:
    """Models with a tag that contains the category, whatever its case."""
    return models.where(F.exists(tags, lambda t: F.contains(F.lower(t), F.lower(category))))


def of_status(models: DataFrame, status: str, wanted: str) -> DataFrame:
    return models.where(F.col(status) == wanted)
