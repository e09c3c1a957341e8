"""Structure, routes and dates. Pages are made from documents: a marker line before every four sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import routing, structure
from tessera.registry import query
from tessera.sources.tables import table

_LINES = "l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM (SELECT doc_id, regexp_split_to_array({0}, '\\r?\\n') AS x FROM documents))".format
#: A page for each line of a document, with a running header and footer.
_PAGED = "array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: '[[page:' || i || ']]' || chr(10) || 'Report of ' || source || ' ' || i || chr(10) || s || chr(10) || 'page ' || i), chr(10))"


def paged_documents(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("[[page:"), i + 1, F.lit("]]\nReport of "), F.col("source"), F.lit(" "), i + 1, F.lit("\n"), s, F.lit("\npage "), i + 1))
    return table(spark, sf, "documents").select("doc_id", F.array_join(pages, "\n").alias("text"))


@query("chunk_lines", f"WITH {_LINES('text')} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, length(line) AS n FROM l")
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return structure.lines(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "line_no", F.length("line").cast("long").alias("n"))


_PAGE_ROWS = rf"""{_LINES(_PAGED)}, p AS (SELECT * FROM (SELECT *, last_value(CAST(nullif(regexp_extract(line, '^\[\[page:(\d+)\]\]$', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM l) WHERE NOT regexp_matches(line, '^\[\[page:\d+\]\]$'))"""


@query("chunk_boilerplate", rf"""WITH {_PAGE_ROWS}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS bottom FROM p WHERE trim(line) <> ''),
    n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM e GROUP BY doc_id),
    k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS line_key, count(DISTINCT page) AS on_pages FROM e WHERE (top <= 3 OR bottom <= 3) AND length(line) <= 80 GROUP BY ALL)
    SELECT doc_id, line_key, on_pages, pages FROM k JOIN n USING (doc_id) WHERE pages >= 3 AND on_pages >= greatest(3, ceil(pages / 2))""")
def chunk_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.paged(structure.lines(paged_documents(spark, sf), "doc_id", "text"), "doc_id")
    return structure.boilerplate(rows, "doc_id")


@query("chunk_page_text", rf"WITH {_PAGE_ROWS} SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM p WHERE page BETWEEN 1 AND 2 GROUP BY doc_id")
def chunk_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return structure.page_text(structure.paged(structure.lines(paged_documents(spark, sf), "doc_id", "text"), "doc_id"), "doc_id", 1, 2)


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return structure.chunks(paged_documents(spark, sf), "doc_id", "text")


@query("chunk_headings")
def chunk_headings(spark: SparkSession, sf: str) -> DataFrame:
    return structure.chunks(table(spark, sf, "documents"), "doc_id", "text").groupBy("section").agg(F.count("*").alias("n_chunks"))


@query("chunk_terms")
def chunk_terms(spark: SparkSession, sf: str) -> DataFrame:
    stated = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('"'), "source", F.lit('" means the origin ("'), "lang", F.lit('") of '), "text").alias("text"))
    return structure.defined_terms(stated, "doc_id", "text")


_TOC = "CASE doc_id % 3 WHEN 0 THEN 'Intro ..... 3' || chr(10) || 'Terms ..... 9' ELSE 'Intro ..... 3' || chr(10) || source END"


@query("chunk_toc_flag", rf"SELECT doc_id, len(regexp_extract_all({_TOC}, '(?m)\.{{3,}}\s*\d+\s*$')) >= 2 AS is_toc FROM documents")
def chunk_toc_flag(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('Intro ..... 3', chr(10), 'Terms ..... 9') ELSE concat('Intro ..... 3', chr(10), source) END")
    return table(spark, sf, "documents").select("doc_id", structure.is_contents(text).alias("is_toc"))


@query("chunk_citation", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN event_type WHEN user_id % 5 = 1 THEN 'p. ' || user_id || ', ' || event_type ELSE 'pp. ' || user_id || '-' || (user_id + 2) || ', ' || event_type END AS citation FROM events")
def chunk_citation(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END")
    end = F.expr("CASE WHEN user_id % 5 = 1 THEN user_id ELSE user_id + 2 END")
    return table(spark, sf, "events").select("event_id", structure.citation(start, end, F.col("event_type")).alias("citation"))


@query("chunk_neighbours", f"WITH {_LINES('text')} SELECT doc_id, CAST(line_no AS INTEGER) AS ord, CAST(min(line_no) OVER w AS INTEGER) AS first_ord, CAST(max(line_no) OVER w AS INTEGER) AS last_ord FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.lines(table(spark, sf, "documents"), "doc_id", "text").where("trim(line) <> ''").select("doc_id", F.col("line_no").alias("ord"))
    return structure.neighbours(rows, "doc_id")


@query("chunk_section_opening", f"""WITH {_LINES('text')}, c AS (SELECT doc_id, CAST(line_no AS INTEGER) AS ord, CASE WHEN length(line) > 200 THEN 'long' ELSE 'short' END AS section FROM l),
    i AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS island FROM c) SELECT doc_id, ord, section FROM i QUALIFY row_number() OVER (PARTITION BY doc_id, section, island ORDER BY ord) <= 2""")
def chunk_section_opening(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.lines(table(spark, sf, "documents"), "doc_id", "text")
    rows = rows.select("doc_id", F.col("line_no").alias("ord"), F.when(F.length("line") > 200, "long").otherwise("short").alias("section"))
    return structure.section_openings(rows, "doc_id", "section")


#: Questions of every route; literals, so that the routes are all exercised.
QUESTIONS = (
    "What is on page 12?", "Show pages 3-5 of report.pdf", "Pages 1-90 please", "What does section 4.2(b) say?", "Artikel 7 zusammenfassen", "definition of liability",
    "Compare across all documents", "How do refunds work?", "Was steht auf Seite 9 in vertrag_final.docx?", "第 12 页 的内容", "summarize all the memos", 'Where is "net profit" used?',
)
_VALUES = ", ".join("('" + q.replace("'", "''") + "')" for q in QUESTIONS)
_ROUTED = rf"""q AS (SELECT question, lower(question) AS low FROM (VALUES {_VALUES}) v(question) UNION ALL SELECT text, lower(text) FROM benchmark),
    r AS (SELECT *, regexp_extract(low, '{routing.PAGE}', 1) AS a, regexp_extract(low, '{routing.PAGE}', 2) AS b, regexp_extract(low, '{routing.SECTION}', 1) AS s FROM q),
    o AS (SELECT *, CASE WHEN (a <> '' AND (b = '' OR CAST(nullif(b, '') AS INTEGER) - CAST(nullif(a, '') AS INTEGER) BETWEEN 0 AND 9)) OR regexp_matches(low, '{routing.CJK_PAGE}') THEN 'page'
        WHEN regexp_matches(low, '{routing.SECTION}') THEN 'section' WHEN regexp_matches(low, '{routing.DEFINITION}') THEN 'definition' WHEN regexp_matches(low, '{routing.COVERAGE}') THEN 'coverage' ELSE 'semantic' END AS route FROM r)"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    literal = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    return literal.unionByName(table(spark, sf, "benchmark").select(F.col("text").alias("question")))


@query("route_classify", f"WITH {_ROUTED} SELECT question, route, CASE route WHEN 'page' THEN CASE WHEN a <> '' THEN a ELSE regexp_extract(low, '{routing.CJK_PAGE}', 1) END WHEN 'section' THEN s ELSE '' END AS route_key FROM o")
def route_classify(spark: SparkSession, sf: str) -> DataFrame:
    return routing.resolved_routes(_questions(spark, sf), "question").select("question", "route", "route_key")


@query("route_file_hint", f"WITH {_ROUTED} SELECT question, regexp_extract(low, '{routing.FILE}', 1) AS file_hint FROM q")
def route_file_hint(spark: SparkSession, sf: str) -> DataFrame:
    return routing.resolved_routes(_questions(spark, sf), "question").select("question", "file_hint")


_LABEL = "'Section ' || (doc_id % 40) || '.' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN ' (b)' ELSE '' END"


@query("route_section_key", rf"SELECT doc_id, k AS section_key, k = '3.3' OR starts_with(k, '3.3.') AS inside FROM (SELECT doc_id, CASE WHEN l = '' THEN n ELSE n || '.' || l END AS k FROM (SELECT doc_id, regexp_extract({_LABEL}, '(\d+(?:\.\d+)*)\s*((?:\([a-z0-9]+\))*)', 1) AS n, regexp_extract({_LABEL}, '(\d+(?:\.\d+)*)\s*((?:\([a-z0-9]+\))*)', 2) AS l FROM documents))")
def route_section_key(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("concat('Section ', doc_id % 40, '.', doc_id % 7, CASE WHEN doc_id % 2 = 0 THEN ' (b)' ELSE '' END)")
    k = structure.section_key(label)
    return table(spark, sf, "documents").select("doc_id", k.alias("section_key"), structure.in_section(k, "3.3").alias("inside"))


@query("date_windows", """SELECT event_id, phrase, CAST(CASE phrase WHEN 'yesterday' THEN d - 1 WHEN 'last week' THEN d - 14 WHEN '3 days ago' THEN d - 4 WHEN '2 months ago' THEN d - 75 ELSE d - ((((isodow(d) - 1) - 0 - 1 + 7) % 7) + 1) END AS VARCHAR) AS first_day,
    CAST(CASE phrase WHEN 'yesterday' THEN d - 1 WHEN 'last week' THEN d - 7 WHEN '3 days ago' THEN d - 2 WHEN '2 months ago' THEN d - 45 ELSE d - ((((isodow(d) - 1) - 0 - 1 + 7) % 7) + 1) END AS VARCHAR) AS last_day
    FROM (SELECT event_id, CAST(CAST(ts AS DATE) AS DATE) AS dd, phrase, CAST(ts AS DATE) AS d FROM events, (VALUES ('yesterday'), ('last week'), ('3 days ago'), ('2 months ago'), ('on monday')) p(phrase))""".replace("d - ((((isodow(d) - 1) - 0 - 1 + 7) % 7) + 1)", "d - CAST((((isodow(d) - 1) - 0 - 1 + 7) % 7) + 1 AS INTEGER)"))
def date_windows(spark: SparkSession, sf: str) -> DataFrame:
    phrases = F.array(*[F.lit(p) for p in ("yesterday", "last week", "3 days ago", "2 months ago", "on monday")])
    e = table(spark, sf, "events").select("event_id", "ts", F.explode(phrases).alias("phrase"))
    first, last = routing.date_window(F.col("phrase"), F.col("ts"))
    return e.select("event_id", "phrase", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))
