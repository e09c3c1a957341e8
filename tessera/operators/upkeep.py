"""Upkeep of stored state: index and vectors of documents, keyed entries with prefixes, draft versions, retention in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


def repaired(documents: DataFrame, chunks: DataFrame, fixed: DataFrame, new_chunks: DataFrame, key: str) -> dict[str, DataFrame]:
    """Documents with the text, status and size of ``fixed`` (key, text, status), and chunks with theirs made anew from ``new_chunks``."""
    f = fixed.select(key, F.col("text").alias("__text"), F.col("status").alias("__status"), F.lit(True).alias("__is"))
    d = documents.join(f, key, "left")
    value = {"text": F.when(F.col("__is"), F.col("__text")).otherwise(F.col("text")), "status": F.when(F.col("__is"), F.col("__status")).otherwise(F.col("status"))}
    value["char_count"] = F.when(F.col("__is"), F.length(F.coalesce("__text", F.lit(""))).cast("long")).otherwise(F.col("char_count"))
    out = d.select(*[value.get(c, F.col(c)).alias(c) for c in documents.columns])
    return {"documents": out, "chunks": chunks.join(fixed.select(key), key, "left_anti").unionByName(new_chunks.join(fixed.select(key), key, "left_semi"))}


def cleared_index(chunks: DataFrame, states: DataFrame, gone: DataFrame, key: str, error: str) -> dict[str, DataFrame]:
    """Chunks without those of ``gone``; the state of these documents is failed, with the reason, known before or not."""
    failed = gone.select(key).distinct().withColumn("status", F.lit("failed")).withColumn("error", F.lit(error))
    return {"chunks": chunks.join(gone, key, "left_anti"), "states": states.join(gone, key, "left_anti").unionByName(failed)}


def without_vectors(states: DataFrame) -> DataFrame:
    """States when all vectors are dropped: what was embedded is only chunked."""
    return states.withColumn("status", F.when(F.col("status") == "embedded", "chunked").otherwise(F.col("status")))


def put_entries(entries: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries replace those of their key, with all rows (prefixes) that belong to it."""
    return entries.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def touched_entries(entries: DataFrame, used: DataFrame, key: str, at: str) -> DataFrame:
    """The later of an entry's last use and the newest in ``used`` (key, at)."""
    u = used.groupBy(key).agg(F.max(at).alias("__at"))
    return entries.join(u, key, "left").withColumn(at, F.greatest(at, "__at")).drop("__at")


def enough(items: DataFrame, order: list[Column], size: str, needed: float | DataFrame, tier: str) -> DataFrame:
    """The items that go until ``needed`` bytes are free: tier by tier, in order inside a tier, the last one wholly.

    Totals of tiers come first. Only the tier in which the need is met is ordered: in ranges, whose totals come first as
    well, so that a task sums within its own range. ``needed`` may be one row with a column of that name.
    """
    spark = items.sparkSession
    want = needed.select(F.col("needed").cast("double").alias("__needed")) if isinstance(needed, DataFrame) else spark.range(1).select(F.lit(float(needed)).alias("__needed"))
    tiers = items.groupBy(tier).agg(F.sum(size).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiers = tiers.withColumn("__before", before).crossJoin(F.broadcast(want)).where(F.col("__before") < F.col("__needed"))  # one row
    rows = items.join(F.broadcast(tiers), tier)  # one row for each kind of item
    whole = rows.where(F.col("__before") + F.col("__total") <= F.col("__needed"))
    edge = rows.where(F.col("__before") + F.col("__total") > F.col("__needed")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    edge = written(edge, "edge")  # the number of a range must not change between its two readers
    parts = edge.groupBy("__part").agg(F.sum(size).alias("__sum"))
    above = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.join(F.broadcast(parts.select("__part", above.alias("__above"))), "__part")  # one row for each range
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("__used", inside + F.col("__above") + F.col("__before")).where(F.col("__used") < F.col("__needed"))
    return whole.select(*items.columns).unionByName(edge.select(*items.columns))


def current_versions(versions: DataFrame, key: str, number: str) -> DataFrame:
    """The row of the newest version of each draft."""
    last = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), F.col(number)).alias("__v"))
    return last.select("__v.*")


def restored(versions: DataFrame, wanted: DataFrame, key: str, number: str) -> DataFrame:
    """History with old versions (key, number) written again as the newest; history itself never changes."""
    newest = versions.groupBy(key).agg(F.max(number).alias("__newest"))
    again = versions.join(wanted, [key, number]).join(newest, key).withColumn(number, (F.col("__newest") + 1).cast(versions.schema[number].dataType)).drop("__newest")
    return versions.unionByName(again)


def superseded(versions: DataFrame, key: str, number: str) -> DataFrame:
    """All versions but the newest of each draft."""
    newest = versions.groupBy(key).agg(F.max(number).alias("__newest"))
    return versions.join(newest, key).where(F.col(number) < F.col("__newest")).drop("__newest")


def covers_most(text: Column, terms: Column) -> Column:
    """At least two terms, and six tenths of them, occur; fewer than one term: false."""
    n = F.size(terms)
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))
    return (n > 0) & (hits >= F.greatest(F.lit(2), F.ceil(n * 0.6)))


def named_by(name: Column, question: Column) -> Column:
    """Some word of four characters or more of the question stands in the name."""
    words = F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4)
    return F.exists(words, lambda w: F.contains(F.lower(name), w))


def keywords(text: Column, stop: list[str]) -> Column:
    """Words between white space of more than three bytes, in lower case, without stop words."""
    words = F.transform(F.split(F.trim(text), r"\s+"), F.lower)
    return F.filter(words, lambda w: (F.octet_length(w) > 3) & ~F.array_contains(F.array(*map(F.lit, stop)), w))


def embedding_input(name: Column, section: Column, body: Column) -> Column:
    """The file's stem as words, the section's path, and the body, a line each; what is missing leaves no line."""
    stem = F.trim(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))
    none = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", none(stem), none(section), body)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def message_parts(text: Column, most: int, parts: int = 7) -> Column:
    """A text in up to ``parts`` pieces of at most ``most`` characters, cut at the last white space of a piece's last fifth, if there is one."""

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        tail = F.substring(F.substring(rest, 1, most), most - most // 5 + 1, most)
        back = F.length(F.regexp_extract(tail, r"\S*\z", 0))
        cut = F.when(F.length(rest) <= most, F.length(rest)).when(back < F.length(tail), F.lit(most) - back).otherwise(F.lit(most))
        piece = _stripped(F.substring(rest, F.lit(1), cut))
        found = F.when(F.length(rest) == 0, state["found"]).otherwise(F.concat(state["found"], F.array(piece)))
        return F.struct(found.alias("found"), F.regexp_replace(F.substring(rest, cut + 1, F.length(rest)), r"^\s+", "").alias("rest"))

    start = F.struct(F.array().cast("array<string>").alias("found"), _stripped(text).alias("rest"))
    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(parts)), start, step, lambda s: s["found"]), lambda p: F.length(p) > 0)
