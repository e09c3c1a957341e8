"""Sharing a budget among documents, and what of them goes into a prompt.

All sizes are bytes of UTF-8, and no cut falls inside a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least share of a document, and what full inclusion leaves beside the texts.
FLOOR, BESIDE = 400, 4_000
# Parts of a budget in hundredths, with their least and greatest bytes.
FULL_PART, EVIDENCE_PART, MATTER_PART = 20, (35, 4_800, 48_000), (15, 2_000, 16_000)
#: Bytes of a token.
TOKEN_BYTES = 4


def fair_shares(rows: DataFrame, group: str, size: str, budget: str, order: str, floor: int = FLOOR) -> DataFrame:
    """Adds ``share``: max-min fair parts of the group's budget (a column, one value in a group).

    Whoever needs less than an equal part of what is left gets what it needs, and the rest is shared on. In order of
    size the nth of m rows is full if it fits (budget - all smaller ones) / (m - n); from the first that does not fit on,
    all get that part. So it is two running sums over the sorted sizes. No share is below ``floor`` (or the
    row's size, if that is less), even where the floors exceed the budget together.
    """
    w = Window.partitionBy(group).orderBy(size, order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.count("*").over(Window.partitionBy(group)) - F.row_number().over(w) + 1
    level = F.floor(F.greatest(F.col(budget) - before, F.lit(0)) / rest)
    r = rows.withColumn("__level", level)
    # the level at the first row that does not fit is that of all after it
    r = r.withColumn("__cut", F.first(F.when(F.col(size) > F.col("__level"), F.col("__level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("__cut").isNull(), F.col(size)).otherwise(F.least(F.col(size), F.col("__cut")))
    return r.withColumn("share", F.least(F.col(size), F.greatest(share, F.lit(floor))).cast("long")).drop("__level", "__cut")


def equal_shares(rows: DataFrame, group: str, budget: str, floor: int = FLOOR) -> DataFrame:
    """Adds ``share``: the same part of the budget for each row, ``floor`` at least."""
    n = F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("share", F.greatest(F.floor(F.greatest(F.col(budget), F.lit(0)) / n), F.lit(floor)).cast("long"))


def head(text: Column, most: Column) -> Column:
    """The first ``most`` bytes, on to the end of the character that they cut."""
    raw = F.encode(text, "UTF-8")
    # at most three bytes that continue a character follow the cut
    tail = F.hex(F.substring(raw, most.cast("int") + 1, F.lit(3)))
    more = (F.length(F.regexp_extract(tail, "^((?:[89AB].)*)", 1)) / 2).cast("int")
    return F.decode(F.substring(raw, F.lit(1), most.cast("int") + more), "UTF-8")


def session_blocks(docs: DataFrame, session: str, doc: str, name: str, status: str, text: str, error: str, attached: str, budget: int, fair: bool = False) -> DataFrame:
    """session, block, complete: the attached documents of each session as one text within ``budget`` bytes.

    Documents that cannot be read are named with the reason. If all texts fit beside the head of the block, they stand
    in full, oldest first, so that a later file changes nothing before it; else each gets its part (``fair``: what small ones leave goes to
    the others) and the opening of a longer one is marked PARTIAL with both sizes. The last line of the head says
    which of the three holds.
    """
    ok = (F.col(status) == "ok") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    kind = F.upper(F.regexp_extract(F.col(name), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(kind == "", "FILE").otherwise(kind)
    d = docs.select(F.col(session).alias("s"), F.col(doc).alias("d"), F.col(name).alias("name"), kind.alias("kind"), ok.alias("ok"), F.when(ok, F.col(text)).alias("text"), F.coalesce(error, F.lit("no reason recorded")).alias("error"), F.col(attached).alias("at"))
    d = d.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # failed ones first, then the readable ones, each oldest first
    place = F.struct(F.col("ok").alias("ok"), F.col("at").alias("at"), F.col("d").alias("d"))
    listed = F.concat(F.lit("  - "), "name", F.lit(" ("), "kind", F.lit(")\n"))
    failed = F.concat(F.lit("[Could not read '"), "name", F.lit("' ("), "kind", F.lit("): "), "error", F.lit("]\n"))
    heads = d.groupBy("s").agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("good"),
        F.sum("size").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), listed.alias("x")))), lambda y: y["x"]), "").alias("list"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(place.alias("p"), failed.alias("x"))))), lambda y: y["x"]), "").alias("failed"),
    )
    top = F.concat(F.when(F.col("n") > 1, F.concat(F.lit("Attached files:\n"), "list")).otherwise(""), "failed")
    heads = heads.select("s", "n", "good", "total", top.alias("head")).withColumn("left", F.greatest(F.lit(budget) - F.octet_length("head"), F.lit(0)).cast("long"))
    good = d.where("ok").join(heads.select("s", "left", "total"), "s")
    shared = fair_shares(good, "s", "size", "left", "d") if fair else equal_shares(good, "s", "left")
    whole = (F.col("total") <= F.col("left")) | (F.col("size") <= F.col("share"))
    full = F.concat(F.lit("\n--- "), "name", F.lit(" ["), "kind", F.lit("] ---\n"), "text", F.lit("\n--- end ---\n"))
    opening = head(F.col("text"), F.col("share"))
    part = F.concat(F.lit("\n--- "), "name", F.lit(" ["), "kind", F.lit("] (PARTIAL: the first "), F.octet_length(opening), F.lit(" of "), "size", F.lit(" bytes) ---\n"), opening, F.lit("\n--- end ---\n"))
    body = shared.select("s", place.alias("p"), whole.alias("whole"), F.when(whole, full).otherwise(part).alias("x"))
    body = body.groupBy("s").agg(F.min("whole").alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda y: y["x"]), "").alias("body"))
    out = heads.join(body, "s", "left")
    says = (
        F.when(F.col("good") == 0, "Nothing could be read.\n")
        .when(~F.col("whole"), "Of documents marked PARTIAL only the opening is shown.\n")
        .when(F.col("good") < F.col("n"), "All readable documents are shown in full; those that could not be read are missing.\n")
        .otherwise("All documents are shown in full.\n")
    )
    return out.select(F.col("s").alias(session), F.concat("head", says, F.coalesce("body", F.lit(""))).alias("block"), (F.coalesce("whole", F.lit(False)) & (F.col("good") == F.col("n"))).alias("complete"))


def part(budget: Column, rule: tuple[int, int, int]) -> Column:
    percent, least, most = rule
    return F.least(F.greatest(F.floor(budget * percent / 100), F.lit(least)), F.lit(most)).cast("long")


def plan(sessions: DataFrame, budget_tokens: str, attached: str, total: str, intent: str, matter_allowed: str, words: str, pool: str) -> DataFrame:
    """Adds ``mode``, ``evidence``, ``least_similarity``, ``note``: what a prompt is made of.

    ``attached``: documents attached; ``total``: bytes of those that can be read; ``intent``: about, unclear or unrelated;
    ``matter_allowed``: whether the matter's other documents may be offered; ``words``: content words of the question;
    ``pool``: searchable documents of the matter.

    Attached documents stand in full if they fit a fifth of the budget; else the question is searched in them, with an
    absolute floor of similarity where it is unclear whether they are meant, and not at all where they are not.
    Without attached documents the matter's are offered to questions of two content words or more.
    """
    b = F.col(budget_tokens).cast("long") * TOKEN_BYTES
    full = (F.col(attached) > 0) & (F.col(total) + BESIDE <= F.floor(b * FULL_PART / 100))
    large = (F.col(attached) > 0) & ~full
    related = F.col(intent) != "unrelated"
    matter = (F.col(attached) == 0) & F.col(matter_allowed) & (F.col(words) >= 2) & (F.col(pool) > 0)
    mode = F.when(full, "full").when(large & related, "search").when(large, "listed").when(matter, "matter").otherwise("none")
    evidence = F.when(large & related, F.least(part(b, EVIDENCE_PART), F.greatest(b, F.lit(EVIDENCE_PART[1])))).when(matter, part(b, MATTER_PART)).otherwise(0).cast("long")
    floor = F.when(large & (F.col(intent) == "unclear"), 0.45).when(matter, 0.55)
    note = F.when((F.col(attached) > 0) & ~related, "unrelated")
    return sessions.withColumn("mode", mode).withColumn("evidence", evidence).withColumn("least_similarity", floor).withColumn("note", note)
