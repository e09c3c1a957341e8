"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A source's documents stand in shuffled order (a hash of doc_id and text); a copy of a document has the virtual finish
time (words of its source up to and with it) / (weight of its source), the copies of a further epoch following those
of the one before. All copies are ordered by finish time over all sources and the order is cut where the budget, the
words of the whole table, is used up. A source that has given all its epochs drops out of the order, so what it
leaves goes to the others by weight without a special case.

Running sums are made in two steps, so that a source with a third of all rows is no single task: totals of equal
hash ranges of a source, whose running sums are offsets, then a running sum inside each range. The cut, too, is
found by ranges of finish time: their totals show the range in which the budget ends, that one is divided again, and
only the part in which the budget ends is ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import carried, columns, materialise, unpacked

#: Copies of one document at most.
EPOCHS = 3
#: Hash ranges of each source, and ranges of finish time.
RANGES = 2048
#: How often the range in which the budget ends is divided before its copies are ordered.
LEVELS = 2
#: A word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (place in the shuffle), written once: the texts are read a single time."""
    return materialise(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit("mix"), "doc_id", "text").alias("h")), "mixing-sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, weight, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn. A level of virtual time V gives each source
    min(epochs * size, weight * V); the V that spends all words is found by running sums over the sources in the
    order in which they reach their ceiling.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    full = Window.partitionBy(F.lit(0)).orderBy((epochs * F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(everything))
    per = per.withColumn("spent", F.coalesce(F.sum(epochs * F.col("source_size")).over(before), F.lit(0)))
    per = per.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level if this source and all that come later are below their ceilings
    per = per.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left_weight"))
    open_ = F.col("weight") * F.col("level") <= epochs * F.col("source_size")
    per = per.withColumn("final", F.min(F.when(open_, F.struct(F.col("spent").alias("o"), F.col("level").alias("level")))).over(everything)["level"])
    return per.select("source", "weight", F.col("source_size"), F.least((epochs * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * F.col("final"), F.lit(0.0))).alias("target"))


def finish_times(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` with weight, source_size, target and done (words of the source up to and with the document)."""
    span = F.shiftright(F.col("h"), 64 - (RANGES.bit_length() - 1))
    rows = rows.withColumn("span", span)
    spans = rows.groupBy("source", "span").agg(F.sum("size").alias("span_size"))
    ahead = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("ahead", F.coalesce(F.sum("span_size").over(ahead), F.lit(0))).drop("span_size")
    spans = spans.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = Window.partitionBy("source", "span").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).withColumnRenamed("source", "s").withColumnRenamed("span", "p")
    return rows.join(spans, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("span"))).withColumn("done", F.col("ahead") + F.col("inside")).drop("s", "p", "span", "ahead", "inside")


def finish(e: int) -> Column:
    """Virtual finish time of the copy of epoch ``e``."""
    return (e * F.col("source_size") + F.col("done")) / F.col("weight")


def cut(rows: DataFrame, per: DataFrame, epochs: int = EPOCHS) -> Callable[[Column], Column] | None:
    """The condition, for an epoch, under which a copy lies before the cut; None where the budget covers all copies.

    The range of finish time in which the budget ends is found among RANGES, then its part among RANGES parts of it,
    and only the copies of that part are ordered. Copies that tie in finish time go together. Only one row of scalars
    comes to the driver at a time.
    """
    budget, last = per.agg(F.sum("source_size"), F.max(epochs * F.col("source_size") / F.col("weight"))).first()
    if not budget:
        return None
    here = rows.where("size > 0").select("size", F.explode(F.array(*[finish(e) for e in range(epochs)])).alias("finish"))
    low, high, spent, chosen = 0.0, float(last), 0, []

    def places(low: float, high: float) -> Callable[[Column], Column]:
        return lambda time: F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((time - F.lit(low)) / F.lit(high - low) * RANGES).cast("int")))

    for _ in range(LEVELS):
        place = places(low, high)
        ranged = here.withColumn("range", place(F.col("finish")))
        totals = ranged.groupBy("range").agg(F.sum("size").alias("total")).withColumn("upto", F.sum("total").over(Window.orderBy("range")))
        at = totals.where(F.col("upto") > budget - spent).orderBy("range").first()
        if at is None:
            return None
        spent += at["upto"] - at["total"]
        chosen.append((place, at["range"]))
        here = ranged.where(F.col("range") == at["range"])
        low, high = low + (high - low) * at["range"] / RANGES, low + (high - low) * (at["range"] + 1) / RANGES
        if not high > low:
            break
    running = F.sum("size").over(Window.partitionBy("range").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0))
    inside = here.withColumn("running", running).where(F.col("running") <= budget - spent).agg(F.max("finish")).first()[0]

    def before(time: Column) -> Column:
        out = (time <= inside) if inside is not None else F.lit(False)
        for place, number in reversed(chosen):
            out = (place(time) < number) | ((place(time) == number) & out)
        return out

    return before


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, h, source, size, source_size, weight, target, done, copies."""
    rows = sized(columns(docs, doc_id=doc_id, text=text, source=source))
    per = targets(rows, weights, epochs)
    rows = materialise(finish_times(rows, per), "mixing-times")
    before = cut(rows, per, epochs)
    reached = F.lit(epochs if before is None else 0)
    for e in range(epochs if before is not None else 0):
        reached = reached + F.when(before(finish(e)), 1).otherwise(0)
    return rows.withColumn("copies", F.when(F.col("size") > 0, reached).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    A null text has size 0 and is taken 0 words; rows that repeat are taken one by one; a table without words takes
    none and has targets of 0; an empty table gives no rows. Reruns agree: the shuffle is a hash of doc_id and text.
    """
    out = mixed(docs, weights, epochs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def sample_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """The rows that the mix takes, with all their columns, as often as it takes them.

    Rows tied in doc_id and text share one place in the shuffle; the copies taken of them are dealt among them one by
    one, so their number is exact. Documents without words are left out.
    """
    taken = mixed(docs, weights, epochs).groupBy("h").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    body = carried(docs, key=F.xxhash64(F.lit("mix"), docs["doc_id"], docs["text"])).join(taken, F.col("key") == F.col("h"))
    single = body.where("rows = 1").withColumn("mine", F.col("copies"))
    tied = body.where("rows > 1")
    if not tied.isEmpty():
        # number the rows of a key in two steps, so that a key with most of the table is no single task
        tied = materialise(tied.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.shiftright("n", 33)), "mixing-tied")
        before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = tied.groupBy("key", "part").agg(F.count("*").alias("c")).select("key", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
        at = F.col("first") + F.row_number().over(Window.partitionBy("key", "part").orderBy("n")) - 1
        tied = tied.join(parts, ["key", "part"]).withColumn("at", at)
        mine = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("at") < F.col("copies") % F.col("rows"), 1).otherwise(0)
        single = single.unionByName(tied.withColumn("mine", mine).select(*single.columns))
    out = single.where("mine > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("mine").cast("int"))))
    return unpacked(out, docs)
