"""A workspace in short: counts and recent rows of each kind, and what matches a question, in equal shares of a budget.

Blocks are folded into messages at marked places, so that a later block never changes the text before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Rows of a section, the inventory's part of the budget in hundredths, characters of an excerpt, least room for matches.
ROWS, INVENTORY_PART, EXCERPT, LEAST = 12, 55, 200, 200
NONE = "- (none)\n"
FOOT = "Answer from this list and the matches given with the question; what is not listed cannot be seen."


def section(rows: DataFrame, owner: str, order: list[Column], line: Column, budget: Column | int, title: str) -> DataFrame:
    """owner, text: the first ROWS rows of each owner, a line each, until one does not fit; ``budget`` in bytes, the title's included."""
    room = F.lit(budget) if isinstance(budget, int) else budget
    w = Window.partitionBy(owner).orderBy(*order)
    r = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= ROWS).withColumn("__line", F.concat(line, F.lit("\n")))
    r = r.withColumn("__used", F.sum(F.octet_length("__line")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + len(title.encode()) + 1)
    # once a line does not fit, none after it is shown
    r = r.where(F.col("__used") <= room)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "")
    return r.groupBy(owner).agg(F.concat(F.lit(f"{title}\n"), text).alias("text"))


def inventory(owners: DataFrame, owner: str, kinds: dict[str, tuple[DataFrame, list[Column], Column]], budget: int, today: Column) -> DataFrame:
    """owner, inventory: a first line with the counts, then a section for each kind, then how to use it.

    ``kinds``: title to (rows with the owner, order, line). Each section gets an equal share of what the first line leaves of
    the inventory's part of ``budget``, so a long list never pushes out another one. Kinds without rows say so.
    """
    out, counts = owners.select(owner).distinct(), []
    for i, (title, (rows, _, _)) in enumerate(kinds.items()):
        out = out.join(rows.groupBy(owner).agg(F.count("*").alias(f"n{i}")), owner, "left")
        counts.append(F.concat(F.coalesce(f"n{i}", F.lit(0)).cast("string"), F.lit(f" {title.lower()}")))
    first = F.concat(F.lit("WORKSPACE (today is "), today.cast("string"), F.lit("): "), F.concat_ws(", ", *counts), F.lit(".\n"))
    out = out.select(owner, first.alias("first"))
    share = F.floor(F.greatest(F.lit(budget * INVENTORY_PART // 100) - F.octet_length("first"), F.lit(0)) / len(kinds))
    parts = [F.col("first")]
    for i, (title, (rows, order, line)) in enumerate(kinds.items()):
        shown = section(rows.join(out.select(owner, share.alias("__share")), owner), owner, order, line, F.col("__share"), f"{title}:")
        listed = rows.select(owner, F.lit(True).alias(f"any{i}")).distinct()
        out = out.join(shown.withColumnRenamed("text", f"s{i}"), owner, "left").join(listed, owner, "left")
        parts.append(F.coalesce(f"s{i}", F.when(F.col(f"any{i}"), F.lit(f"{title}:\n")).otherwise(F.lit(f"{title}:\n{NONE}"))))
    return out.select(owner, F.concat(*parts, F.lit(FOOT)).alias("inventory"))


def excerpt(text: Column) -> Column:
    """One line of at most EXCERPT characters, without the marks of hits."""
    flat = T.collapse(F.translate(text, "\u0002\u0003", "  "))
    return F.when(F.length(flat) > EXCERPT, F.concat(F.substring(flat, 1, EXCERPT), F.lit("…"))).otherwise(flat)


def matches(hits: DataFrame, key: str, rank: str, kind: str, line: str, budget: Column | int) -> DataFrame:
    """key, matches: lines of all kinds in order of kind and rank within ``budget`` bytes; each kind stops at its first line that does not fit.

    ``hits``: key, kind (a number), rank, line. Less room than LEAST, or no line that fits: no row.
    """
    head = "[Matches in the workspace]\n"
    room = F.lit(budget) if isinstance(budget, int) else budget
    size = F.octet_length(line) + 1
    rows = hits.where(room >= LEAST).select(key, F.col(kind).alias("kind"), F.col(rank).alias("rank"), F.col(line).alias("line"), size.alias("size"), room.alias("room"))
    each = rows.groupBy(key).agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("kind", "rank", "line", "size"))).alias("l"))

    def step(state: Column, x: Column) -> Column:
        stopped = (state["stopped"] == x["kind"]) | (state["used"] + x["size"] > F.col("room"))
        take = ~stopped
        return F.struct(
            F.when(take, state["used"] + x["size"]).otherwise(state["used"]).alias("used"),
            F.when(take, F.concat(state["text"], x["line"], F.lit("\n"))).otherwise(state["text"]).alias("text"),
            F.when(stopped, x["kind"]).otherwise(state["stopped"]).alias("stopped"),
        )

    start = F.struct(F.lit(len(head)).alias("used"), F.lit(head).alias("text"), F.lit(-1).alias("stopped"))
    text = F.aggregate("l", start, step, lambda s: s["text"])
    return each.select(key, text.alias("matches")).where(F.col("matches") != head)


def folded(message: Column, block: Column, mark: str, before: bool = True) -> Column:
    """A block before (or after) a message's own text, with a mark between them; an empty block changes nothing."""
    joined = F.concat(block, F.lit(mark), message) if before else F.concat(message, F.lit(mark), block)
    return F.when(F.trim(F.coalesce(block, F.lit(""))) == "", message).otherwise(F.when(F.coalesce(message, F.lit("")) == "", block).otherwise(joined))


def unfolded(message: Column, mark: str) -> Column:
    """What a message says behind the last mark; all of it without one."""
    return F.when(F.contains(message, F.lit(mark)), F.substring_index(message, mark, -1)).otherwise(message)


def folded_into_system(messages: DataFrame, blocks: DataFrame, key: str, mark: str = "\n\n") -> DataFrame:
    """Messages (key, message_index, role, content) with each block (key, block) in the first message if that is a system
    message, else in a new one before it. No other message changes, and none is added anywhere else."""
    b = blocks.where(F.trim(F.coalesce("block", F.lit(""))) != "")
    first = messages.groupBy(key).agg(F.min_by("role", "message_index").alias("__role"), F.min("message_index").alias("__first"))
    m = messages.join(first, key, "left").join(b, key, "left")
    here = (F.col("message_index") == F.col("__first")) & (F.col("__role") == "system") & F.col("block").isNotNull()
    out = m.withColumn("content", F.when(here, folded(F.col("content"), F.col("block"), mark, before=False)).otherwise(F.col("content"))).select(*messages.columns)
    new = b.join(first, key, "left").where(F.coalesce("__role", F.lit("")) != "system")
    kind = messages.schema["message_index"].dataType
    return out.unionByName(new.select(key, (F.coalesce("__first", F.lit(0)) - 1).cast(kind).alias("message_index"), F.lit("system").alias("role"), F.col("block").alias("content")))


def first_then_contains(messages: DataFrame, key: str, wanted: Column, most: int, looked_at: int = 1000) -> DataFrame:
    """Of the first ``looked_at`` messages of each session those that contain ``wanted``, whatever its case, ``most`` at most."""
    w = Window.partitionBy(key).orderBy("message_index")
    seen = messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= looked_at)
    found = seen.where(F.contains(F.lower("content"), F.lower(wanted)))
    return found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__n", "__k")
