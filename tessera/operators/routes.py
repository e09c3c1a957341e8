"""Retrieval routes that answer from the structure of documents: pages, definitions, sheet rows, other versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import store, structure
from tessera.sources.shared import written

#: Documents that a route looks at, chunks of a definition, and the bytes below which nothing more is begun.
DOCUMENTS, DEFINITIONS, LEAST_LEFT = 12, 6, 200
#: Versions of a family whose sizes are summed together.
POSITIONS = 1024
ROW = r"\brows?\s+(?:no\.?\s*|number\s+|#)?([0-9]{1,6})\b"
MARK = " […]"


def hinted(asked: DataFrame, hint: str, files: DataFrame, name: str) -> DataFrame:
    """``asked`` with the files that its hint names: the whole name, or its stem inside the name. No hint: none.

    A hint may stand anywhere in a name, so hints meet the names that hold the first three characters of their stem
    (or the whole of a shorter one), and what is met is compared.
    """
    hints = asked.select(F.lower(hint).alias("hint")).where("hint <> ''").distinct().withColumn("stem", F.regexp_replace("hint", r"\.[^.]*$", ""))
    hints = hints.withColumn("gram", F.substring("stem", 1, 3))
    n, low = F.length(name), F.lower(name)
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.array(*[F.substring(low, i, F.lit(k)) for k in (1, 2, 3)]))
    each = files.withColumn("gram", F.explode(F.array_append(F.array_distinct(F.flatten(F.when(n > 0, grams).otherwise(F.array().cast("array<array<string>>")))), "")))
    found = each.join(hints, "gram").where((low == F.col("hint")) | F.contains(low, F.col("stem"))).drop("gram", "stem")
    return asked.join(found, F.lower(asked[hint]) == F.col("hint")).drop("hint") if hint != "hint" else asked.join(found, "hint")


def within_bytes(rows: DataFrame, group: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Texts in order, cut where a group's budget ends; none is begun with fewer than LEAST_LEFT bytes left."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.octet_length(text)).over(w), F.lit(0))
    rows = rows.withColumn("left", left).where(F.col("left") >= LEAST_LEFT)
    fits = F.octet_length(text) <= F.col("left")
    # a cut inside a character drops the beginning of it: a lead byte without all that follow it
    head = F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.col("left").cast("int")))
    whole = F.regexp_replace(head, "^((?:..)*?)(?:F.(?:[89AB].){0,2}|E.(?:[89AB].)?|[CD].)$", "$1")
    cut = F.concat(F.rtrim(F.decode(F.unhex(whole), "UTF-8")), F.lit(MARK))
    return rows.withColumn("truncated", ~fits).withColumn(text, F.when(fits, F.col(text)).otherwise(cut)).drop("left")


def pages(asked: DataFrame, key: str, lines: DataFrame, doc: str) -> DataFrame:
    """key, doc, first, last, text: the asked pages (key, doc, first, last) of documents that have the first of them.

    Every page of a range is looked up by itself, so pages and lines meet on equal numbers.
    """
    wanted = asked.select(key, doc, "first", "last", F.explode(F.sequence("first", "last")).alias("page"))
    found = wanted.join(lines, [doc, "page"]).groupBy(key, doc, "first", "last").agg(F.min("page").alias("has"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return found.where((F.col("has") == F.col("first"))).select(key, doc, "first", "last", text.alias("text")).where("text <> ''")


def page_route(asked: DataFrame, key: str, scope: DataFrame, lines: DataFrame, doc: str, budget: int) -> DataFrame:
    """The asked pages (key, first, last) of the newest DOCUMENTS documents of each question's scope (key, doc), within a budget in bytes."""
    newest = Window.partitionBy(key).orderBy(F.desc(doc))
    some = scope.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= DOCUMENTS).drop("n")
    return within_bytes(pages(asked.join(some, key), key, lines, doc), key, [F.desc(doc)], "text", budget)


def definition_route(asked: DataFrame, key: str, term: str, terms: DataFrame, doc: str) -> DataFrame:
    """key, doc, place, rank, score: the first DEFINITIONS places that define the asked term, whatever its case; the nth scores 1 / n."""
    found = asked.select(key, F.lower(term).alias("wanted")).join(terms.select(doc, "place", F.lower("term").alias("wanted")), "wanted")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(doc, "place"))).where(F.col("rank") <= DEFINITIONS)
    return found.select(key, doc, "place", "rank", (1 / F.col("rank")).alias("score"))


def sheet_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, sheet, row (from 1, the header), line: the rows of marker-tagged workbooks; blank lines are none."""
    rows = structure.lines(docs, doc, text)
    name = F.regexp_extract("line", r"^\[\[sheet:([^\]]*)\]\]$", 1)
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sheet", F.last(F.when(name != "", name), ignorenulls=True).over(w)).where((name == "") & (F.trim("line") != "") & F.col("sheet").isNotNull())
    return rows.select(doc, "sheet", F.row_number().over(Window.partitionBy(doc, "sheet").orderBy("line_no")).alias("row"), "line")


def asked_row(question: Column) -> Column:
    """The row that a question asks for, or null."""
    return F.regexp_extract(F.lower(question), ROW, 1).try_cast("int")


def named_sheets(asked: DataFrame, key: str, question: str, scope: DataFrame, rows: DataFrame, doc: str) -> DataFrame:
    """key, doc, sheet: the sheets of each question's documents (``scope``: key, doc) that it names.

    A name of two characters or more counts where no letter or digit stands beside it. Questions about a named sheet
    that ask for no row are searched in these sheets only.
    """
    sheets = scope.select(key, doc).distinct().join(rows.select(doc, "sheet").distinct(), doc)
    spoken = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(F.col(c)), " "), F.lit(" "))
    met = sheets.where(F.length(F.trim("sheet")) >= 2).join(asked.select(key, spoken(question).alias("said")), key)
    return met.where((F.trim(spoken("sheet")) != "") & F.contains("said", spoken("sheet"))).select(key, doc, "sheet")


def sheet_route(asked: DataFrame, key: str, question: str, scope: DataFrame, rows: DataFrame, doc: str) -> DataFrame:
    """key, doc, sheet, row, text: the asked row of the sheets that a question names, under the sheet's header.

    Only documents in the question's ``scope`` (key, doc) count; a question that names no sheet means the only one that
    they have, if there is one only.
    """
    wanted = asked.select(key, asked_row(F.col(question)).alias("row")).where("row IS NOT NULL")
    named = named_sheets(asked, key, question, scope, rows, doc)
    sheets = scope.select(key, doc).distinct().join(rows.select(doc, "sheet").distinct(), doc)
    single = sheets.groupBy(key).agg(F.count("*").alias("many"), F.first(doc).alias(doc), F.first("sheet").alias("sheet")).where("many = 1").drop("many")
    alone = single.join(named.select(key).distinct(), key, "left_anti")
    targets = named.unionByName(alone).join(wanted, key)
    head = rows.where("row = 1").select(doc, "sheet", F.col("line").alias("header"))
    out = targets.join(rows.withColumnRenamed("line", "own"), [doc, "sheet", "row"]).join(head, [doc, "sheet"])
    return out.select(key, doc, "sheet", "row", F.when(F.col("row") == 1, F.col("own")).otherwise(F.concat("header", F.lit("\n"), "own")).alias("text"))


def other_versions(shown: DataFrame, key: str, files: DataFrame, doc: str, name: str, created: str, lines: DataFrame, budget: int) -> DataFrame:
    """The pages that were shown (key, doc, first, last) in the other versions of their documents, within a quarter of the budget; each with its place among the versions.

    Questions that want the same pages of one family share its texts, which are read once. Of these only the first ones can be
    shown: those up to where the budget ends, whichever ones a question has seen already, so a question meets some versions
    of a family and never all of them.
    """
    room = budget // 4
    f = written(store.families(files, doc, name, created).select(doc, "family", "position", "total"), "versions")
    own = shown.join(f.select(doc, "family"), doc)
    # of several documents that a question has of a family the first one says which pages
    wanted = own.groupBy(key, "family").agg(F.min(F.struct(F.col(doc).alias("of"), "first", "last")).alias("x"), F.count_distinct(doc).alias("own")).select(key, "family", "x.first", "x.last", "own")
    pages_of = ["family", "first", "last"]
    asked = wanted.groupBy(*pages_of).agg(F.max("own").alias("own"))
    texts = pages(asked.join(f, "family").select(*pages_of, doc), "family", lines, doc).join(f.select(doc, "position", "total"), doc)
    # a text counts with what ends a budget at most; one for each seen document may have to be passed over
    most = room - LEAST_LEFT + 1
    texts = written(texts.withColumn("block", F.floor(F.col("position") / POSITIONS)).withColumn("size", F.least(F.octet_length("text"), F.lit(most))), "version-pages")
    blocks = texts.groupBy(*pages_of, "block").agg(F.sum("size").alias("size"))
    ahead = lambda *order: F.coalesce(F.sum("size").over(Window.partitionBy(*pages_of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = (F.lit(most) * (F.col("own") + 1)).cast("long")
    blocks = blocks.withColumn("ahead", ahead("block")).join(asked, pages_of).where(F.col("ahead") < limit).select(*pages_of, "block", "own")
    some = texts.join(blocks, [*pages_of, "block"]).withColumn("ahead", ahead("position", doc)).where(F.col("ahead") < limit)
    found = wanted.select(key, *pages_of).join(some.select(*pages_of, doc, "position", "total", "text"), pages_of).drop("family")
    found = found.join(shown.select(key, doc), [key, doc], "left_anti").select(key, doc, "first", "last", "text", "position", "total")
    return within_bytes(found, key, ["position", doc], "text", room)


#: Tokens of this many characters are searched by their beginning even without a known ending; synonyms of one query.
BARE_PREFIX, SYNONYMS = 6, 24


def clauses(questions: DataFrame, key: str, question: str, synonyms: DataFrame) -> DataFrame:
    """key, n, kind (exact, prefix, synonym), term: what a question is searched for, in order.

    Each token in its exact form, then its family by a prefix (without its ending, or a long token as it is), then its
    synonyms (word, syn; word may be two adjacent tokens), SYNONYMS at most for a question, each once, and none that
    is itself asked for before.
    """
    t = questions.select(key, F.posexplode(T.query_tokens(F.col(question))).alias("at", "token"))
    stem = F.coalesce(T.morphological_prefix(F.col("token")), F.when(F.length("token") >= BARE_PREFIX, F.col("token")))
    own = t.select(key, "at", F.lit(0).alias("step"), F.lit("exact").alias("kind"), F.col("token").alias("term"))
    prefix = t.select(key, "at", F.lit(1).alias("step"), F.lit("prefix").alias("kind"), stem.alias("term")).where("term IS NOT NULL")
    w = Window.partitionBy(key).orderBy("at")
    pairs = t.withColumn("token", F.concat_ws(" ", "token", F.lead("token").over(w))).withColumn("pair", F.lit(1))
    words = t.withColumn("pair", F.lit(0)).unionByName(pairs)
    same = words.join(synonyms, F.col("token") == F.col("word")).groupBy(key, F.col("syn").alias("term")).agg(F.min(F.struct("pair", "at", "syn")).alias("first"))
    said = t.groupBy(key, F.col("token").alias("term")).agg(F.min("at").alias("said"))
    same = same.join(said, [key, "term"], "left").where(F.col("said").isNull() | ((F.col("first.pair") == 0) & (F.col("said") > F.col("first.at")))).drop("said")
    same = same.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("first"))).where(F.col("n") <= SYNONYMS)
    same = same.select(key, F.when(F.col("first.pair") == 1, 1_000_000 + F.col("first.at")).otherwise(F.col("first.at")).alias("at"), (F.col("n") + 1).alias("step"), F.lit("synonym").alias("kind"), "term")
    every = own.unionByName(prefix).unionByName(same)
    return every.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at", "step"))).select(key, "n", "kind", "term")
