"""Material of earlier conversations as one block: files that a question names, documents that match it, exchanges.

Search and fusion are joins and windows over all questions at once. Only the last step, fitting excerpts into a budget, depends on
the lengths of what was fitted before; it is a small function over the at most ``DOCUMENTS`` documents and ``MESSAGES``
exchanges of one question.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ranking
from tessera.sources.shared import written

# Documents and exchanges of a block, matching chunks of a document, the documents' part of the budget in hundredths,
# the least budget that is of use, what a heading leaves at least, and what the mark of an excerpt takes.
DOCUMENTS, MESSAGES, CHUNKS, DOCUMENT_PART, LEAST, AFTER_HEADING, MARK = 3, 6, 12, 50, 400, 120, 80
INTRO = "[Material from earlier, found because the question refers back to it]\n"
COMPLETE = "The documents below are complete.\n"
EXCERPTED = "Some documents below are excerpts; attach the file to see all of it.\n"


def found_documents(asked: DataFrame, key: str, question: str, named: DataFrame, files: DataFrame, scope: DataFrame | str, hits: DataFrame, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """key, doc, rank (1 to DOCUMENTS), named: named files before ranked ones, each document once.

    ``named``: key, file (names in the question); ``files``: doc, name, text, ok, day; ``scope``: key, doc that the question
    may see beyond its own attachments, or a column of both ``asked`` and ``files``: a question sees the files that share its value
    (no pair of a question and a file is made for that); ``hits``: key, doc, score of chunks. A named file is taken by its whole name or the name
    inside another, newest first. Of the others the best chunk of each document counts; it must lie in the question's time range
    (``first`` to ``last``, each may be null) and its document must have half of the question's words.
    """
    readable = files.where("ok AND trim(text) <> ''")
    same = [scope] if isinstance(scope, str) else []

    def seen(rows: DataFrame) -> DataFrame:
        return rows.join(asked.select(key, *same), [key, *same]) if same else rows.join(scope.select(key, "doc"), [key, "doc"])

    # a name may stand anywhere in another: names meet the files that hold their first three characters somewhere
    wanted = named.select(key, F.lower("file").alias("file")).where("file <> ''").distinct().withColumn("gram", F.substring("file", 1, 3))
    low = F.lower("name")
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.substring(low, i, F.least(F.lit(3), F.length("name") - i + 1)))))
    wanted = written(wanted, "named-files")  # so small tables are known to be small
    met = readable.select("doc", "name", "day", *same, grams.alias("gram")).join(wanted, "gram")
    by_name = seen(met.where(F.contains(low, F.col("file"))).select(key, "doc", "day", *same).distinct())
    by_name = by_name.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("day"), "doc"))).where(F.col("place") <= DOCUMENTS)
    best = hits.groupBy(key, "doc").agg(F.max("score").alias("score")).join(by_name.select(key, "doc"), [key, "doc"], "left_anti")
    terms = asked.select(key, T.query_tokens(F.col(question)).alias("terms"), F.col(first).alias("first"), F.col(last).alias("last"))
    best = seen(best.join(terms, key).join(readable.select("doc", "text", "day", *same), "doc"))
    in_time = (F.col("first").isNull() | (F.col("day") >= F.col("first"))) & (F.col("last").isNull() | (F.col("day") <= F.col("last")))
    best = best.where(in_time & T.covers_enough(F.col("text"), F.col("terms"))).select(key, "doc", "score")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "doc"))).where(F.col("place") <= DOCUMENTS)
    both = by_name.select(key, "doc", "place", F.lit(True).alias("named")).unionByName(best.select(key, "doc", "place", F.lit(False).alias("named")))
    order = Window.partitionBy(key).orderBy(F.desc("named"), "place")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCUMENTS).select(key, "doc", "rank", "named")


def fused_messages(keyword: DataFrame, near: DataFrame, key: str, message: str, own: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """key, message, rank: both ranked lists (key, message, session, score) fused, MESSAGES at most.

    Messages of the question's own session (``own``: key, session) and of sessions outside ``allowed`` (key, session) are none.
    """

    def ranked(rows: DataFrame) -> DataFrame:
        return ranking.ranked(rows, key, message)

    sessions = keyword.select(message, "session").union(near.select(message, "session")).distinct()
    both = ranking.fused([ranked(keyword), ranked(near)], key, message).join(sessions, message).join(own, [key, "session"], "left_anti")
    if allowed is not None:
        both = both.join(allowed.select(key, "session"), [key, "session"], "left_semi")
    return ranking.ranked(both, key, message, k=MESSAGES)


def _size(text: str) -> int:
    return len(text.encode())


def beginning(text: str, most: int) -> tuple[str, bool]:
    """The whole text if it fits ``most`` bytes, else its beginning with a mark, the mark inside the budget; whether it was cut."""
    text = text.strip()
    if _size(text) <= most:
        return f"{text}\n", False
    shown = text.encode()[: max(0, most - MARK)].decode(errors="ignore")
    return f"{shown}\n[... excerpt ends here; {_size(shown)} of {_size(text)} bytes shown ...]\n", True


def relevant(text: str, chunks: list[tuple[int, str, str]], most: int) -> tuple[str, bool]:
    """The whole text if it fits, else those of the matching chunks (ord, citation, text; best first) that fit, in the text's order."""
    if _size(text.strip()) <= most or not chunks:
        return beginning(text, most)
    left, picked = max(0, most - MARK), []
    for ord_, cited, body in chunks:
        line = f"{cited} {body}\n"
        if _size(line) <= left:
            left -= _size(line)
            picked.append((ord_, line))
    if not picked:
        return beginning(text, most)
    return "".join(line for _, line in sorted(picked)) + f"[... matching passages of {_size(text.strip())} bytes ...]\n", True


def fitted(documents: list[tuple], lines: list[str], budget: int) -> tuple[str | None, int, int]:
    """The block of one question, and how many documents and exchanges are in it; None if nothing fits.

    ``documents``: (name, day, text, chunks) in order. They may take half of what the head leaves; exchanges get what is left then.
    """
    usable = budget - _size(INTRO) - max(_size(COMPLETE), _size(EXCERPTED))
    if usable < LEAST:
        return None, 0, 0
    body, used, docs, cut = [], 0, 0, False
    for name, day, text, chunks in documents:
        head = f"\n--- From document '{name}' ({day}) ---\n"
        left = usable * DOCUMENT_PART // 100 - used
        if left <= _size(head) + AFTER_HEADING:
            break
        shown, part = relevant(text, chunks, left - _size(head))
        cut |= part
        used += _size(head) + _size(shown)
        body += [head, shown]
        docs += 1
    head, said = "\n--- From earlier conversations ---\n", 0
    left = usable - used - _size(head)
    if lines and left > AFTER_HEADING:
        body.append(head)
        for line in lines:
            if _size(line) > left:
                break
            left -= _size(line)
            body.append(line)
            said += 1
        if not said:
            body.pop()
    if not docs and not said:
        return None, 0, 0
    return INTRO + (EXCERPTED if cut else COMPLETE) + "".join(body), docs, said


def past_context(asked: DataFrame, key: str, refers: Column, budget: str, documents: DataFrame, files: DataFrame, chunks: DataFrame, hits: DataFrame, lines: DataFrame) -> DataFrame:
    """key, block, documents, messages, reason of each question.

    ``documents``: key, doc, rank (``found_documents``); ``files``: doc, name, day, text; ``hits``: key, doc, ord, score;
    ``chunks``: doc, ord, citation, text; ``lines``: key, rank, line (exchanges as they are shown). A question that does not refer
    to the past, or has no useful budget, or finds nothing, has a null block and says why.
    """
    top = Window.partitionBy(key, "doc").orderBy(F.desc("score"), "ord")
    matching = hits.join(documents.select(key, "doc"), [key, "doc"], "left_semi").withColumn("n", F.row_number().over(top)).where(F.col("n") <= CHUNKS)
    matching = matching.join(chunks.select("doc", "ord", "citation", F.col("text").alias("body")), ["doc", "ord"])
    matching = matching.groupBy(key, "doc").agg(F.array_sort(F.collect_list(F.struct("n", "ord", "citation", "body"))).alias("chunks"))  # CHUNKS at most
    d = documents.join(files.select("doc", "name", F.col("day").cast("string").alias("day"), "text"), "doc").join(matching, [key, "doc"], "left")
    d = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "day", "text", "chunks"))).alias("documents"))  # DOCUMENTS at most
    m = lines.where(F.col("rank") <= MESSAGES).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    q = asked.select(key, refers.alias("refers"), F.col(budget).cast("long").alias("budget")).join(d, key, "left").join(m, key, "left")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, refers_, most, docs, said in zip(f[key], f["refers"], f["budget"], f["documents"], f["lines"], strict=True):
                none = lambda x: x is None or (isinstance(x, float) and x != x)
                docs = [] if none(docs) else [(r["name"], r["day"], r["text"], [] if none(r["chunks"]) else [(c["ord"], c["citation"] or "", c["body"]) for c in r["chunks"]]) for r in docs]
                said = [] if none(said) else [r["line"] for r in said]
                block, n, m = (None, 0, 0) if not refers_ or most < LEAST else fitted(docs, said, int(most))
                why = "no reference to the past" if not refers_ else "too little room" if most < LEAST else "nothing matched" if not docs and not said else "nothing fitted" if block is None else f"{n} documents and {m} messages"
                out.append((k, block, n, m, why))
            yield pd.DataFrame(out, columns=[key, "block", "documents", "messages", "reason"])

    return q.mapInPandas(task, f"{key} {asked.schema[key].dataType.simpleString()}, block string, documents int, messages int, reason string")
