"""Recall of dropped turns, excerpts, sources, summary entries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T
from tessera.operators import memory, ranking, search

#: Characters of each side of an exchange, candidates of each list, exchanges of a block, characters kept for its heading.
SIDE, CANDIDATES, EXCHANGES, HEADING = 700, 30, 15, 320
#: Entries of a stored summary that keep their points.
ENTRIES = 400
GAP = "…"

# What counts as a citation and as a file name in an answer.
CITED = r"\[[^\[\]\n]{2,120}\]"
FILE = r"(?i)\b[\p{L}\p{N}_][\p{L}\p{N}_\-. ]{0,80}?\.(?:pdf|docx?|xlsx?|pptx?|txt|png|jpe?g)\b"


def flat(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with a mark where something is missing."""
    line = T.collapse(text)
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit(GAP))).otherwise(line)


def _cut(line: str, most: int) -> str:
    return line if len(line) <= most else line[:most].rstrip() + GAP


def excerpted(text: str, parts: list[str], terms: list[str], most: int) -> str:
    """The sentences of ``parts`` with the most query words that fit, in their order, gaps marked; else the beginning."""
    line = " ".join(text.split())
    hits = {i: n for i, p in enumerate(parts) if (n := sum(t[:5] in p.lower() for t in terms))}
    if len(line) <= most or not hits:
        return _cut(line, most)
    left, chosen = most, []
    for i in sorted(hits, key=lambda i: (-hits[i], i)):
        size = len(parts[i]) + 2
        if size <= left:
            chosen.append(i)
            left -= size
        elif not chosen:
            return _cut(parts[i], most)
    out, last = [], -1
    for i in sorted(chosen):
        if i > last + 1:
            out.append(GAP)
        out.append(parts[i])
        last = i
    return " ".join([*out, *([GAP] if last + 1 < len(parts) else [])])


def excerpt(text: Column, terms: Column, most: int = SIDE) -> Column:
    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, parts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else excerpted(t, list(p), list(w), most) for t, p, w in zip(texts, parts, wanted, strict=True)])

    return cut(text, T.sentences(text), terms)


def sources(text: Column, most: int = 3) -> Column:
    """Citations that name a file, a page, a section or a sheet, then file names that none of them holds."""
    names = lambda t: t.rlike(FILE) | F.contains(t, F.lit("p.")) | F.contains(t, F.lit("Section")) | F.contains(t, F.lit("Sheet:"))
    cited = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(CITED), F.lit(0)), names))
    files = F.transform(F.regexp_extract_all(text, F.lit(FILE), F.lit(0)), F.trim)
    more = lambda held, x: F.when(F.exists(held, lambda h: F.contains(h, x)), held).otherwise(F.concat(held, F.array(x)))
    return F.slice(F.aggregate(files, cited, more), 1, most)


def entries(messages: DataFrame) -> DataFrame:
    """session_id, turn, question, points, sources of each exchange."""
    e = memory.exchanges(messages).join(memory.turn_numbers(messages).select("session_id", F.col("message_index").alias("question_index"), F.col("turn_number").alias("turn")), ["session_id", "question_index"])
    p = memory.key_points(e.select("session_id", "turn", F.coalesce("answer", F.lit("")).alias("answer")), ["session_id", "turn"], "answer", 2)
    p = p.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", flat(F.col("sentence"), 220).alias("s")))).alias("l"))
    points = F.coalesce(F.transform("l", lambda x: x["s"]), F.array().cast("array<string>"))
    e = e.join(p, ["session_id", "turn"], "left")
    return e.select("session_id", "turn", flat(F.col("question"), 200).alias("question"), points.alias("points"), F.coalesce(sources(F.col("answer")), F.array().cast("array<string>")).alias("sources"))


def merged_entries(stored: DataFrame, new: DataFrame, most: int = ENTRIES) -> DataFrame:
    """What is stored stays, new turns are added; of the oldest, beyond ``most``, only the questions stay."""
    both = stored.unionByName(new.join(stored.select("session_id", "turn"), ["session_id", "turn"], "left_anti"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    keep = lambda c: F.when(F.col("back") <= most, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c)
    return both.withColumn("back", back).select("session_id", "turn", "question", keep("points"), keep("sources"))


def entry_line(points: bool = True) -> Column:
    line = F.concat(F.lit("- Turn "), F.col("turn").cast("string"), F.lit(": You asked: "), "question")
    if not points:
        return line
    more = F.when(F.size("points") > 0, F.concat(F.lit(" | Key points: "), F.array_join("points", " "))).otherwise("")
    return F.concat(line, more, F.when(F.size("sources") > 0, F.concat(F.lit(" | Sources: "), F.array_join("sources", ", "))).otherwise(""))


def rendered_summary(listed: DataFrame, most: int) -> DataFrame:
    """session_id, summary: a line for each entry within ``most`` characters; the oldest lose their points first, then their lines.

    What fits follows from running sums: with ``p`` entries reduced the lines need (short lines of the first p) + (full
    lines of the others); the least p that fits is taken, and where even p = all but the last does not, lines go.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    e = listed.withColumns({"full": entry_line(), "short": entry_line(False)}).withColumn("n", F.row_number().over(w)).withColumn("of", F.count("*").over(Window.partitionBy("session_id")))
    size = lambda c: (F.octet_length(c) + 1).cast("long")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("reduced", F.sum(size("short")).over(upto) + F.coalesce(F.sum(size("full")).over(after), F.lit(0)))
    e = e.withColumn("rest", F.coalesce(F.sum(F.when(F.col("n") < F.col("of"), size("short")).otherwise(size("full"))).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0)))
    whole = F.sum(size("full")).over(Window.partitionBy("session_id"))
    least = F.min(F.when((F.col("reduced") <= most) & (F.col("n") < F.col("of")), F.col("n"))).over(Window.partitionBy("session_id"))
    first = F.coalesce(F.min(F.when(F.col("rest") <= most, F.col("n"))).over(Window.partitionBy("session_id")), F.col("of"))
    e = e.withColumn("points_from", F.when(whole <= most, 1).otherwise(F.coalesce(least + 1, F.col("of")))).withColumn("from", F.when((whole <= most) | least.isNotNull(), 1).otherwise(first))
    line = F.when(F.col("n") >= F.col("points_from"), F.col("full")).otherwise(F.col("short"))
    shown = e.where(F.col("n") >= F.col("from")).groupBy("session_id", (F.col("from") - 1).alias("missing")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    head = F.when(F.col("missing") > 0, F.concat(F.lit("- ("), F.col("missing").cast("string"), F.lit(" earliest turns not listed here; ask about them to retrieve them)\n"))).otherwise("")
    return shown.select("session_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("summary"))


def round_keys(messages: DataFrame) -> DataFrame:
    """session_id, question_index, key: the text that stands for an exchange in a vector index."""
    e = memory.exchanges(messages).where("answer IS NOT NULL")
    p = memory.key_points(e, ["session_id", "question_index"], "answer", 3)
    p = p.groupBy("session_id", "question_index").agg(F.array_sort(F.collect_list(F.struct("pos", flat(F.col("sentence"), 220).alias("s")))).alias("l"))
    e = e.join(p, ["session_id", "question_index"], "left")
    tail = F.when(F.size("l") > 0, F.concat(F.lit("\nKey points: "), F.array_join(F.transform("l", lambda x: x["s"]), " "))).otherwise(F.concat(F.lit("\nAnswer: "), flat(F.col("answer"), 400)))
    return e.select("session_id", "question_index", F.concat(F.lit("Question: "), flat(F.col("question"), 600), tail).alias("key"))


def completed(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """ask_id, session_id, question_index, rank, question, answer: hits (ask_id, session_id, message_index, role, rank) as exchanges, each once."""
    at = F.when(F.col("role") == "user", F.col("message_index")).otherwise(F.col("message_index") - 1)
    pairs = hits.groupBy("ask_id", "session_id", at.alias("question_index")).agg(F.min("rank").alias("rank"))
    side = lambda role, shift, name: messages.where(F.col("role") == role).select("session_id", (F.col("message_index") - shift).alias("question_index"), F.col("content").alias(name))
    out = pairs.join(side("user", 0, "question"), ["session_id", "question_index"], "left").join(side("assistant", 1, "answer"), ["session_id", "question_index"], "left")
    return out.where("question IS NOT NULL OR answer IS NOT NULL")


def dropped_turns(messages: DataFrame, asked: DataFrame, budget: int, near: DataFrame | None = None) -> DataFrame:
    """ask_id, turn, question_index, entry: earlier exchanges of the same conversation that are no longer in view, oldest first by question_index.

    ``asked``: ask_id, session_id, question, cutoff (messages before it have left the prompt), current_index. First
    comes the exchange that an ordinal question names, then BM25 and the vector list ``near`` (ask_id, message_index,
    score) fused. Entries are taken while they fit into ``budget`` characters; a smaller one further down may still fit.
    """
    room = budget - HEADING
    terms = asked.select("ask_id", "session_id", F.explode(T.query_tokens(F.col("question"))).alias("term"))
    said = messages.where("role IN ('user', 'assistant')").withColumn("place", F.struct("session_id", "message_index"))
    scored = search.bm25(said, "place", "content", terms, "ask_id", within="session_id")
    scored = scored.select("ask_id", F.col("place.message_index").alias("message_index"), "score").join(asked.select("ask_id", "cutoff"), "ask_id").where("message_index < cutoff AND cutoff > 1")
    lists = [ranking.ranked(scored, "ask_id", "message_index", k=CANDIDATES)]
    if near is not None:
        lists.append(ranking.ranked(near.join(asked.select("ask_id", "cutoff"), "ask_id").where("message_index < cutoff AND cutoff > 1"), "ask_id", "message_index", k=CANDIDATES))
    found = ranking.ranked(ranking.fused(lists, "ask_id", "message_index"), "ask_id", "message_index")
    earlier = messages.join(asked.select("ask_id", "session_id", "current_index"), "session_id").where("message_index < current_index").drop("session_id").withColumnRenamed("ask_id", "session_id")
    wanted = asked.select(F.col("ask_id").alias("session_id"), memory.detected_ordinal(F.col("question")).alias("ordinal")).where("ordinal IS NOT NULL")
    target = memory.resolved_ordinal(earlier, wanted).select(F.col("session_id").alias("ask_id"), "message_index", F.lit(0).alias("rank"))
    target = target.join(asked.select("ask_id", "cutoff"), "ask_id").where("message_index < cutoff").drop("cutoff")
    hits = found.select("ask_id", "message_index", "rank").unionByName(target).join(asked.select("ask_id", "session_id"), "ask_id").join(messages.select("session_id", "message_index", "role"), ["session_id", "message_index"])
    turns = memory.turn_numbers(messages).where("role = 'user'").select("session_id", F.col("message_index").alias("question_index"), F.col("turn_number").alias("turn"))
    pairs = completed(hits, messages).join(turns, ["session_id", "question_index"], "left").join(asked.select("ask_id", T.query_tokens(F.col("question")).alias("terms")), "ask_id")
    nth = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" (your "), T.ordinal(F.col("turn")), F.lit(" question"), F.when(F.col("rank") == 0, ", the one asked about)").otherwise(")"))
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), excerpt(F.col(c), F.col("terms")), F.lit("\n"))).otherwise("")
    entry = F.concat(F.lit("--- ["), F.coalesce(nth, F.lit("An earlier turn")), F.lit("] ---\n"), part("You asked", "question"), part("Answer", "answer"))
    pairs = pairs.select("ask_id", "turn", "question_index", "rank", entry.alias("entry"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        """At most 2 * CANDIDATES + 1 entries of one question."""
        rows, left = [], room
        for r in group.sort_values("rank").to_dict("records"):
            size = len(r["entry"].encode())
            if size > left and rows:
                continue
            rows.append(r | {"entry": r["entry"][:left] if size > left else r["entry"]})
            left -= size
            if left < 0 or len(rows) == EXCHANGES:
                break
        return pd.DataFrame(rows, columns=["ask_id", "turn", "question_index", "entry"]).astype({"turn": "Int64"})

    return pairs.groupBy("ask_id").applyInPandas(fit, "ask_id long, turn long, question_index long, entry string")


def block(entries_of: DataFrame) -> DataFrame:
    """ask_id, block: the entries of a question, oldest first."""
    g = entries_of.groupBy("ask_id").agg(F.array_sort(F.collect_list(F.struct("question_index", "entry"))).alias("l"))
    return g.select("ask_id", F.array_join(F.transform("l", lambda x: x["entry"]), "").alias("block"))
