"""Assembly of passages: neighbour merge, relative floor, extension, byte budget, citation, versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, FLOOR, SPAN, SHORT_BYTES, MARK = 12, 0.4, 2, 700, " […]"
#: With fewer bytes left no further passage is begun.
LEAST_LEFT = 200


def options(budget: Column) -> tuple[Column, Column]:
    """Passages (3 to 10) and bytes of one (1200 to 4000) for a budget in bytes."""
    clamp = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return clamp(F.floor(budget / 1500), 3, 10).cast("int"), clamp(F.floor(budget / 3), 1200, 4000).cast("int")


def cut_bytes(text: str, most: int) -> str:
    """At most ``most`` UTF-8 bytes, never inside a character, with a mark where something is missing."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: max(0, most - len(MARK.encode()))].decode(errors="ignore") + MARK


def _group(hits: pd.DataFrame) -> pd.DataFrame:
    """One query's hits (query_id, doc_id, ord, section, score, text, neighbours as before and after) to its passages."""
    budget, most = int(hits["budget"].iloc[0]), int(hits["most_bytes"].iloc[0])
    rows = hits.sort_values(["score", "doc_id", "ord"], ascending=[False, True, True]).head(CANDIDATES).to_dict("records")
    groups: list[dict] = []
    for r in rows:
        for g in groups:
            if g["doc_id"] == r["doc_id"] and g["section"] == r["section"] and min(abs(r["ord"] - x) for x in g["parts"]) == 1 and max([*g["parts"], r["ord"]]) - min([*g["parts"], r["ord"]]) <= SPAN:
                g["parts"][r["ord"]] = r["text"]
                break
        else:
            groups.append({"doc_id": r["doc_id"], "section": r["section"], "score": r["score"], "parts": {r["ord"]: r["text"]}, "before": r["before"], "after": r["after"]})
    out, used = [], 0
    for g in groups:
        left = budget - used
        if left <= 0 or len(out) >= int(hits["most_passages"].iloc[0]) or (out and left < LEAST_LEFT):
            break
        if out and g["score"] < FLOOR * groups[0]["score"]:
            continue
        text = "\n".join(g["parts"][k] for k in sorted(g["parts"]))
        if len(g["parts"]) == 1 and len(text.encode()) <= SHORT_BYTES:
            text = "\n".join(x for x in (g["before"], text, g["after"]) if x)
        # what is too long for the rest of the budget is cut, so a first hit always shows
        text = cut_bytes(text, max(min(left, max(most, 2 * LEAST_LEFT)), LEAST_LEFT))
        used += len(text.encode())
        out.append((hits["query_id"].iloc[0], len(out) + 1, g["doc_id"], min(g["parts"]), max(g["parts"]), g["score"], text))
    return pd.DataFrame(out, columns=["query_id", "rank", "doc_id", "first_ord", "last_ord", "score", "text"])


def assembled(hits: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """Passages of each query within ``budget`` bytes. ``hits``: query_id, doc_id, ord, score; ``chunks``: doc_id, ord, section, text.

    Only the best CANDIDATES of a query reach its group, so a group is a dozen rows.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    near = lambda shift: F.when((shift("section").over(w) == F.col("section")), shift("text").over(w))
    c = chunks.withColumn("before", near(F.lag)).withColumn("after", near(F.lead))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord")
    h = hits.withColumn("place", F.row_number().over(top)).where(F.col("place") <= CANDIDATES).drop("place")
    passages, most = options(F.lit(budget))
    h = h.join(c, ["doc_id", "ord"]).withColumn("budget", F.lit(budget)).withColumn("most_passages", passages).withColumn("most_bytes", most)
    return h.groupBy("query_id").applyInPandas(_group, "query_id long, rank int, doc_id long, first_ord int, last_ord int, score double, text string")


def prompt_block(passages: DataFrame, query: str = "query_id") -> DataFrame:
    """One text per query: the passages in rank order, each under its source."""
    line = F.format_string("[%d] document %d\n%s", F.col("rank"), F.col("doc_id"), F.col("text"))
    return passages.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))


def about_documents(named: Column, referenced: Column, similarity: Column, keyword_hits: Column, small_talk: Column) -> Column:
    """retrieve, unrelated or unclear: an explicit file or reference decides, then small talk, then similarity, then words."""
    return (
        F.when(named | referenced, "retrieve")
        .when(small_talk, "unrelated")
        .when(similarity >= 0.55, "retrieve")
        .when(similarity < 0.25, "unrelated")
        .when(keyword_hits >= 2, "retrieve")
        .otherwise("unclear")
    )
