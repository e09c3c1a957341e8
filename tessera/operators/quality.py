"""Verification of answers, comparison of texts, evaluation of rankings, retention under a budget."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T

CITED = r"\[([^\[\]]*?(?:\bpp?\.\s*\d+(?:\s*-\s*\d+)?|\.(?:pdf|docx|xlsx|txt))[^\[\]]*?)\](?!\()"


def citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, file, page_from, page_to of each bracketed citation that is no link."""
    c = answers.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(CITED), F.lit(1))).alias("n", "cite"))
    a, b = F.regexp_extract("cite", r"\bpp?\.\s*(\d+)(?:\s*-\s*(\d+))?", 1), F.regexp_extract("cite", r"\bpp?\.\s*(\d+)(?:\s*-\s*(\d+))?", 2)
    file = F.regexp_extract(F.lower("cite"), r"([\p{L}\p{N}_\-]+\.(?:pdf|docx|xlsx|txt))", 1)
    start = a.try_cast("int")
    return c.select(key, "n", file.alias("file"), start.alias("page_from"), F.coalesce(b.try_cast("int"), start).alias("page_to"))


def verified_pages(cited: DataFrame, shown: DataFrame) -> DataFrame:
    """Whether a passage that was shown covers the cited pages: file equal, ranges overlap."""
    s = shown.select(F.col("file").alias("s_file"), F.col("page_from").alias("s_from"), F.col("page_to").alias("s_to")).distinct()
    return cited.join(s, (F.col("file") == F.col("s_file")) & (F.col("s_from") <= F.col("page_to")) & (F.col("s_to") >= F.col("page_from")), "left_semi")


def quotes(answers: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """Quotations of at least ``least`` words in the form in which they are compared."""
    q = answers.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit('["“]([^"”“]+)["”]'), F.lit(1))).alias("n", "quote"))
    return q.select(key, "n", T.quoted_form(F.col("quote")).alias("quote")).where(F.size(F.split("quote", " ")) >= least)


def verified_quotes(answers: DataFrame, key: str, text: str, shown: DataFrame, least: int = 4) -> DataFrame:
    """key, n (place among the answer's quotations), quote, file, page_from, page_to, found.

    A quotation belongs to the next citation after it; found is whether it stands, in the form in which quotations are
    compared, in what ``shown`` (key, file, page_from, page_to, text) has of the cited file and pages for the answer.
    Without a citation it may stand on any page that was shown.
    """
    marks = F.regexp_extract_all(F.col(text), F.lit('["“][^"”“]+["”]|' + CITED), F.lit(0))
    m = answers.select(F.col(key).alias("key"), F.posexplode(marks).alias("at", "mark")).withColumn("cited", F.when(F.col("mark").startswith("["), F.col("mark")))
    w = Window.partitionBy("key").orderBy("at")
    m = m.withColumn("next", F.first("cited", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    m = m.where("cited IS NULL").withColumn("n", F.row_number().over(w) - 1).withColumn("quote", T.quoted_form(F.col("mark"))).where(F.size(F.split("quote", " ")) >= least)
    m = m.withColumn("id", F.struct("key", "n"))
    c = citations(m.where("next IS NOT NULL"), "id", "next").select("id", F.nullif("file", F.lit("")).alias("file"), "page_from", "page_to")
    q = m.select("id", "key", "n", "quote").join(c, "id", "left")
    s = shown.select(F.col(key).alias("s_key"), F.lower("file").alias("s_file"), F.col("page_from").alias("s_from"), F.col("page_to").alias("s_to"), F.col("text").alias("s_text"))
    there = F.coalesce(F.col("file") == F.col("s_file"), F.col("file").isNull()) & F.coalesce((F.col("s_from") <= F.col("page_to")) & (F.col("s_to") >= F.col("page_from")), F.col("page_from").isNull())
    # pages in order, so that a quotation may go on from one to the next
    pages = q.select("id", "key", "file", "page_from", "page_to").join(s, (F.col("key") == F.col("s_key")) & there).groupBy("id", "s_file").agg(F.array_sort(F.collect_list(F.struct("s_from", "s_to", "s_text"))).alias("l"))
    pages = pages.select(F.col("id").alias("p_id"), T.quoted_form(F.array_join(F.col("l.s_text"), " ")).alias("page"))
    found = q.select("id", "quote").join(pages, (F.col("id") == F.col("p_id")) & F.contains(F.col("page"), F.col("quote")), "left_semi").select(F.col("id").alias("f_id"))
    return q.join(found, F.col("id") == F.col("f_id"), "left").select(F.col("key").alias(key), "n", "quote", "file", "page_from", "page_to", F.col("f_id").isNotNull().alias("found"))


_SCAFFOLD = re.compile(r"^\s*(\[\[?(?:context|sources?|passages?|documents?|instructions?)\b.*|={3,}.*|-{3,}|#+\s*(?:context|sources?|passages?|instructions?)\b.*)$", re.IGNORECASE)


def stripped(answer: str) -> str:
    """Without reprinted prompt blocks: a scaffold line and what follows up to a blank line go."""
    kept, skipping = [], False
    for line in answer.split("\n"):
        if _SCAFFOLD.match(line):
            skipping = True
        elif not line.strip():
            skipping = False
            kept.append(line)
        elif not skipping:
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


@F.pandas_udf(StringType())
def strip_scaffold(answers: pd.Series) -> pd.Series:
    return answers.map(lambda x: None if x is None else stripped(x))


#: Rounds of ``myers`` between two states that it keeps.
ROUNDS = 64


def _round(v: list[int], a: list, b: list, d: int, middle: int) -> bool:
    """Furthest points with ``d`` edits from those with one less, in place; whether the end is reached."""
    n, m = len(a), len(b)
    for k in range(-d, d + 1, 2):
        x = v[middle + k + 1] if k == -d or (k != d and v[middle + k - 1] < v[middle + k + 1]) else v[middle + k - 1] + 1
        while x < n and x - k < m and a[x] == b[x - k]:
            x += 1
        v[middle + k] = x
        if x >= n and x - k >= m:
            return True
    return False


def myers(a: list, b: list) -> list[tuple[str, int, int]]:
    """Shortest edit script (Myers 1986): (op, index in a, index in b), op one of equal, delete, insert.

    Of the D rounds every ROUNDS-th state is kept, and those between are made again on the way back, so D edits need
    memory for D * (D / ROUNDS + ROUNDS) small numbers and not for the square of D.
    """
    n, m = len(a), len(b)
    middle = n + m + 1
    v = [-1] * (2 * middle + 1)
    v[middle + 1] = 0
    state = lambda d: array("q", v[middle - d - 1 : middle + d + 2])
    kept, d = [], 0
    while True:
        if d % ROUNDS == 0:
            kept.append(state(d))
        if _round(v, a, b, d, middle):
            break
        d += 1
    out, x, y, last = [], n, m, d
    for first in range(last - last % ROUNDS, -1, -ROUNDS):
        v[middle - first - 1 : middle + first + 2] = kept.pop()
        trace = []
        for d in range(first, min(first + ROUNDS - 1, last) + 1):
            trace.append(state(d))
            if d < last:
                _round(v, a, b, d, middle)
        for d in range(first + len(trace) - 1, first - 1, -1):
            t, k = trace.pop(), x - y
            at = d + 1 + k
            before = k + 1 if k == -d or (k != d and t[at - 1] < t[at + 1]) else k - 1
            px = t[d + 1 + before]
            py = px - before
            while x > px and y > py and x > 0 and y > 0:
                x, y = x - 1, y - 1
                out.append(("equal", x, y))
            if d:
                if x == px:
                    y -= 1
                    out.append(("insert", x, y))
                else:
                    x -= 1
                    out.append(("delete", x, y))
    return out[::-1]


def differences(left: list[str], right: list[str], fold=lambda s: " ".join(s.lower().split())) -> list[tuple[str, str | None, str | None]]:
    """Paragraph operations; a deleted and an inserted paragraph that share half of their words are one change."""
    ops = myers([fold(x) for x in left], [fold(x) for x in right])
    out: list[tuple[str, str | None, str | None]] = []
    i = 0
    while i < len(ops):
        if ops[i][0] == "equal":
            out.append(("equal", left[ops[i][1]], right[ops[i][2]]))
            i += 1
            continue
        j = i
        while j < len(ops) and ops[j][0] != "equal":
            j += 1
        gone = [left[x] for op, x, _ in ops[i:j] if op == "delete"]
        new = [right[y] for op, _, y in ops[i:j] if op == "insert"]
        for k in range(max(len(gone), len(new))):
            a, b = (gone[k] if k < len(gone) else None), (new[k] if k < len(new) else None)
            if a is not None and b is not None:
                wa, wb = fold(a).split(), fold(b).split()
                same = sum(op == "equal" for op, _, _ in myers(wa, wb))
                if 2 * same >= 0.5 * (len(wa) + len(wb)):
                    out.append(("change", a, b))
                    continue
            if a is not None:
                out.append(("delete", a, None))
            if b is not None:
                out.append(("insert", None, b))
        i = j
    return out


#: Pairs that are compared before their rows are handed on, and rows that are handed on at once.
PAIRS, OPERATIONS = 64, 4096


def compared(pairs: DataFrame, key: str) -> DataFrame:
    """(key, left_text, right_text) to one row per paragraph operation: key, n, op, left, right.

    Texts leave Arrow a few pairs at a time, and so do the rows, so a task holds little besides the batch that it reads.
    """
    cut = lambda t: [x for x in re.split(r"\n+", t or "") if x.strip()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(key), ("n", pa.int32()), ("op", pa.string()), ("left", pa.string()), ("right", pa.string())])
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                rows = []
                for k, a, b in zip(part.column(key).to_pylist(), part.column("left_text").to_pylist(), part.column("right_text").to_pylist(), strict=True):
                    rows += [(k, n, *op) for n, op in enumerate(differences(cut(a), cut(b)))]
                for i in range(0, len(rows), OPERATIONS):
                    columns = zip(*rows[i : i + OPERATIONS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pairs.select(key, "left_text", "right_text").mapInArrow(task, f"{key} {pairs.schema[key].dataType.simpleString()}, n int, op string, left string, right string")


def summary(ops: DataFrame, key: str) -> DataFrame:
    n = lambda op: F.count_if(F.col("op") == op).alias(f"{op}s")
    return ops.groupBy(key).agg(n("insert"), n("delete"), n("change"), n("equal"), (F.count_if(F.col("op") != "equal") == 0).alias("identical"))


def hits(ranked: DataFrame, relevant: DataFrame, query: str, doc: str) -> DataFrame:
    """The rank of each query's first relevant result, null without one."""
    good = ranked.join(relevant.select(query, doc).distinct(), [query, doc], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))
    return ranked.select(query).distinct().join(good, query, "left")


def retrieval_metrics(first: DataFrame, *by: str) -> DataFrame:
    """questions, hit@1, hit@5 and the mean reciprocal rank."""
    share = lambda k: F.round(F.avg((F.coalesce("first", F.lit(10**9)) <= k).cast("double")), 6)
    return first.groupBy(*by).agg(F.count("*").alias("questions"), share(1).alias("hit1"), share(5).alias("hit5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def nearest_rank(rows: DataFrame, group: str, value: str, *percents: int) -> DataFrame:
    """Percentiles as values that occur: of the sorted values number round(p / 100 * (n - 1)), from 0.

    Only counts of distinct values are ordered, so a group with many rows is no single list in memory.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) / 100 * (F.col("n") - 1) + 0.5), F.col(value))).alias(f"p{p}")
    return c.groupBy(group).agg(*[at(p) for p in percents])


def running_total(rows: DataFrame, order: str, value: str, name: str, ranges: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over all rows with an ``order`` (a long) at least as high; rows that tie share it.

    In two steps, so that no task orders the whole table: totals of ranges of the order, of which only those few are
    summed in one place, and a running sum inside each range.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    width = (high - low) // ranges + 1
    rows = rows.withColumn("__range", F.floor((F.col(order) - low) / width).cast("int"))
    totals = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    above = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", F.coalesce(F.sum("__sum").over(above), F.lit(0)).alias("__above"))
    inside = Window.partitionBy("__range").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__inside", F.sum(value).over(inside)).join(F.broadcast(totals), "__range")  # at most ``ranges`` rows
    return out.withColumn(name, F.col("__inside") + F.col("__above")).drop("__range", "__inside", "__above")


def evicted(entries: DataFrame, size: str, recency: Column, budget: int, per_session: int | None = None, session: str | None = None) -> DataFrame:
    """Entries that go: beyond ``per_session`` of their session, then the least recent until the rest fits ``budget``."""
    e = entries.withColumn("__r", recency.cast("long")).withColumn("__over", F.lit(False))
    if per_session is not None:
        e = e.withColumn("__over", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("__r"))) > per_session)
    kept = running_total(e.where("NOT __over"), "__r", size, "__used")
    gone = kept.where(F.col("__used") > budget).select(*entries.columns)
    return gone.unionByName(e.where("__over").select(*entries.columns))


def ewma(rows: DataFrame, group: str, order: str, value: str, keep: float = 0.7) -> DataFrame:
    """The last value of r = keep * r + (1 - keep) * x, seeded with the first x.

    As a sum: x_n weighs (1 - keep) * keep ** (N - n), the first one keep ** (N - 1); so it is one window and one
    aggregate, and values far back weigh nothing.
    """
    w = Window.partitionBy(group)
    r = rows.withColumn("__n", F.row_number().over(w.orderBy(order)))
    total = r.groupBy(group).agg(F.max("__n").alias("__total"))
    r = r.join(total, group)
    weight = F.pow(F.lit(keep), (F.col("__total") - F.col("__n")).cast("double")) * F.when(F.col("__n") == 1, 1.0).otherwise(1 - keep)
    return r.groupBy(group).agg(F.round(F.sum(F.col(value) * weight), 6).alias("rate"))


def restore_pays(tokens: Column, token_bytes: Column | float, disk_rate: float, compute_rate: float, least: int = 64) -> Column:
    """Reading back what ``tokens`` have left on disk (``token_bytes`` each, ``disk_rate`` bytes in a millisecond) takes less time
    than computing them again (``compute_rate`` tokens in a second), from ``least`` tokens on."""
    return (tokens >= least) & (tokens * token_bytes / disk_rate < tokens / compute_rate * 1000)


def hits_on_pages(ranked: DataFrame, relevant: DataFrame, query: str, doc: str) -> DataFrame:
    """The rank of each query's first relevant passage, null without one; queries without passages count as well.

    ``ranked``: query, doc, rank, page_from, page_to (null where a passage has no pages); ``relevant``: query, doc, page. A
    passage of the right document is relevant if it holds the page, or if no page is asked for.
    """
    r = relevant.select(query, doc, "page").distinct()
    on = F.col("page").isNull() | F.col("page").between(F.col("page_from"), F.coalesce("page_to", "page_from"))
    good = ranked.join(r, [query, doc]).where(on).groupBy(query).agg(F.min("rank").alias("first"))
    return r.select(query).distinct().join(good, query, "left")


def resolved_citations(cited: DataFrame, key: str, known: DataFrame, shown: DataFrame) -> DataFrame:
    """key, n, doc, verdict of citations (key, n, file, page_from, page_to; file null or empty, pages null where none is named).

    ``known``: key, doc, place (order of the documents of an answer), name, pages (how many, null if unknown), full (shown as a
    whole); ``shown``: key, doc, page_from, page_to of passages. A file is the one of that name, else the first whose name holds
    its stem; without a file it is the only known document, or the only one that showed the pages. Verdicts: ok, not provided,
    ambiguous, no such page, page not shown.
    """
    c = cited.select(key, "n", F.lower(F.nullif("file", F.lit(""))).alias("file"), "page_from", "page_to")
    k = known.select(key, "doc", "place", F.lower("name").alias("name"), "pages", "full")
    covering = c.where("page_from IS NOT NULL").select(key, "n", "page_from", "page_to").join(shown.select(key, "doc", F.col("page_from").alias("s_from"), F.coalesce("page_to", "page_from").alias("s_to")), key)
    covering = covering.where((F.col("s_from") <= F.col("page_from")) & (F.col("s_to") >= F.col("page_to"))).select(key, "n", "doc").distinct().withColumn("covers", F.lit(True))
    met = c.join(k, key, "left").join(covering, [key, "n", "doc"], "left").withColumn("has", F.coalesce("covers", F.lit(False)) | (F.coalesce("full", F.lit(False)) & F.col("page_from").isNotNull()))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    fit = F.when(F.col("file") == F.col("name"), 1).when(F.contains(F.col("name"), stem), 2)
    best = met.groupBy(key, "n", "file", "page_from", "page_to").agg(
        F.count("doc").alias("known"),
        F.count_if("has").alias("with_pages"),
        F.min_by(F.struct("doc", "pages", "has"), F.when(fit.isNotNull(), F.struct(fit, "place"))).alias("named"),
        F.first(F.when(F.col("doc").isNotNull(), F.struct("doc", "pages", "has")), ignorenulls=True).alias("any"),
        F.max(F.when(F.col("has"), F.struct("doc", "pages", "has"))).alias("paged"),
    )
    x = F.when(F.col("file").isNotNull(), F.col("named")).when(F.col("known") == 1, F.col("any")).when(F.col("with_pages") == 1, F.col("paged"))
    best = best.withColumn("x", x)
    verdict = (
        F.when(F.col("x").isNull() & F.col("file").isNull() & (F.col("known") > 1), "ambiguous")
        .when(F.col("x").isNull(), "not provided")
        .when(F.col("page_to") > F.col("x.pages"), "no such page")
        .when(F.col("page_from").isNotNull() & ~F.col("x.has"), "page not shown")
        .otherwise("ok")
    )
    return best.select(key, "n", F.col("x.doc").alias("doc"), verdict.alias("verdict"))
