"""Routes by document structure, file hints, query clauses, and file readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stemming
from tessera.operators import positions, routes, structure
from tessera.plans.search import _prefix_case, query_tokens_sql
from tessera.plans.structure import _PAGE_ROWS, paged_documents
from tessera.registry import query
from tessera.sources.shared import written
from tessera.sources.tables import table

_FILES = "f AS (SELECT doc_id, source || '-' || lang || CASE WHEN doc_id % 3 = 0 THEN '_v2' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.DOCX' END AS name FROM documents)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr("concat(source, '-', lang, CASE WHEN doc_id % 3 = 0 THEN '_v2' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.DOCX' END)")
    return table(spark, sf, "documents").select("doc_id", name.alias("name"))


HINTS = ("web-en.pdf", "EN_V2.docx", "-de.pdf", "nothing.txt", "")


@query("route_docs_hint", f"WITH {_FILES}, h AS (SELECT lower(h) AS hint, regexp_replace(lower(h), '\\.[^.]*$', '') AS stem FROM (VALUES {', '.join(f"('{h}')" for h in HINTS)}) v(h) WHERE h <> '') SELECT hint, doc_id FROM f, h WHERE lower(name) = hint OR contains(lower(name), stem)")
def route_docs_hint(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(h.lower(),) for h in HINTS], "hint string")
    return routes.hinted(asked, "hint", _files(spark, sf), "name").select("hint", "doc_id")


ASKED_PAGES = ((1, 1, 1), (2, 2, 3), (3, 400, 401))
_LEFT = "CAST({budget} - coalesce(sum(strlen(text)) OVER (PARTITION BY ask ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)".format


@query(
    "route_page",
    f"""WITH {_PAGE_ROWS}, a AS (SELECT * FROM (VALUES {', '.join(map(str, ASKED_PAGES))}) v(ask, a, b)), s AS (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id DESC LIMIT 12),
    t AS (SELECT ask, doc_id, min(page) AS has, min(a) AS a, trim(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM p JOIN s USING (doc_id) JOIN a ON page BETWEEN a AND b GROUP BY ask, doc_id),
    m AS (SELECT *, {_LEFT(budget=4000)} AS room FROM t WHERE has = a AND text <> '') SELECT ask, doc_id, strlen(text) > room AS truncated FROM m WHERE room >= 200""",
)
def route_page(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame(list(ASKED_PAGES), "ask int, first int, last int")
    lines = structure.paged(structure.lines(paged_documents(spark, sf), "doc_id", "text"), "doc_id")
    scope = asked.select("ask").crossJoin(table(spark, sf, "documents").select("doc_id").distinct())  # three questions
    return routes.page_route(asked, "ask", scope, lines, "doc_id", 4000).select("ask", "doc_id", "truncated")


@query("route_definition", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE length(source) BETWEEN 2 AND 80) SELECT source AS asked, doc_id, CAST(rank AS INTEGER) AS rank, 1.0 / rank AS score FROM r WHERE rank <= 6")
def route_definition(spark: SparkSession, sf: str) -> DataFrame:
    """Each document begins with a definition of its source; each source is asked for in capitals."""
    d = table(spark, sf, "documents")
    terms = structure.defined_terms(d.select("doc_id", F.concat(F.lit('"'), "source", F.lit('" means the origin.')).alias("text")), "doc_id", "text")
    asked = d.select(F.col("source").alias("asked"), F.upper("source").alias("term")).distinct()
    return routes.definition_route(asked, "asked", "term", terms, "doc_id").select("asked", "doc_id", "rank", "score")


@query(
    "route_sheet_row",
    """WITH r AS (SELECT n_name, c_custkey, c_name || chr(9) || c_mktsegment AS own, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) + 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_name AS ask, n_name AS sheet, CAST(n AS INTEGER) AS "row", 'name' || chr(9) || 'segment' || chr(10) || own AS text FROM r WHERE n = 3""",
)
def route_sheet_row(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook with a sheet of customers for each nation; the third row of each is asked for."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat("c_name", F.lit("\t"), "c_mktsegment")
    sheet = c.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("l"))
    book = sheet.select(F.col("n_name").alias("doc"), F.concat(F.lit("[[sheet:"), "n_name", F.lit("]]\n\nname\tsegment\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n")).alias("text"))
    rows = routes.sheet_rows(book, "doc", "text")
    asked = sheet.select(F.col("n_name").alias("ask"), F.concat(F.lit("Show row 3 of "), F.initcap("n_name"), F.lit(", please")).alias("question"))
    # every question is asked of its own book and of the one that has the next nation's name; only the first has the sheet
    own = asked.select("ask", F.col("ask").alias("doc"))
    after = asked.select("ask", F.lead("ask").over(Window.orderBy("ask")).alias("doc")).where("doc IS NOT NULL")  # one row for each nation
    found = routes.sheet_route(asked, "ask", "question", own.unionByName(after), rows, "doc")
    return found.select("ask", "sheet", "row", "text")


@query("route_other_versions")
def route_other_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each tenth document, in the other versions of it."""
    files = _files(spark, sf).join(table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 50).alias("subject")), "doc_id")
    files = files.select("doc_id", F.concat(F.lit("subject"), F.substring(F.translate(F.md5(F.col("subject").cast("string")), "0123456789", "ghijklmnop"), 1, 6), F.lit("_v"), "doc_id", F.lit(".pdf")).alias("name"), F.col("doc_id").alias("created"))
    shown = files.where("doc_id % 10 = 0").select(F.col("doc_id").alias("ask"), "doc_id", F.lit(1).alias("first"), F.lit(1).alias("last"))
    lines = structure.paged(structure.lines(paged_documents(spark, sf), "doc_id", "text"), "doc_id")
    return routes.other_versions(shown, "ask", files, "doc_id", "name", "created", lines, 8000).select("ask", "doc_id", "position", "total", "truncated")


_SYNONYMS = ", ".join(f"('{a}', '{b}')" for a, b in stemming.synonym_pairs())
_ASKED = f"b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -row_number() OVER (), 'Terminate the ' || w || ' agreement by contract' FROM (VALUES {_SYNONYMS}) v(w, s))"


@query(
    "fts_clauses",
    f"""WITH {_ASKED}, t AS (SELECT item_id, unnest(terms) AS token, unnest(range(len(terms))) AS pos FROM {query_tokens_sql('b', 'item_id')}),
    p AS (SELECT item_id, pos, coalesce({_prefix_case('token')}, CASE WHEN length(token) >= 6 THEN token END) AS term FROM t),
    w AS (SELECT item_id, pos, token, 0 AS pair FROM t UNION ALL SELECT item_id, pos, concat_ws(' ', token, lead(token) OVER (PARTITION BY item_id ORDER BY pos)), 1 FROM t),
    s0 AS (SELECT item_id, syn, min(pair * 1000000 + pos) AS pos FROM w JOIN (VALUES {_SYNONYMS}) v(word, syn) ON token = word GROUP BY item_id, syn),
    s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos, syn) AS n FROM s0 WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.item_id = s0.item_id AND t.token = s0.syn AND t.pos <= s0.pos)),
    e AS (SELECT item_id, pos, 0 AS step, 'exact' AS kind, token AS term FROM t UNION ALL SELECT item_id, pos, 1, 'prefix', term FROM p WHERE term IS NOT NULL UNION ALL SELECT item_id, pos, n + 1, 'synonym', syn FROM s WHERE n <= 24)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos, step) AS INTEGER) AS n, kind, term FROM e""",
)
def fts_clauses(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stemming.synonym_pairs()
    literal = spark.createDataFrame([(-1 - i, f"Terminate the {w} agreement by contract") for i, (w, _) in enumerate(pairs)], "item_id long, text string")
    asked = table(spark, sf, "benchmark").select("item_id", "text").unionByName(literal)
    return routes.clauses(asked, "item_id", "text", spark.createDataFrame(pairs, "word string, syn string"))


_CORPUS_SYNONYMS = [("tion", "of the"), ("tion", "ing"), ("ing", "to the"), ("with", "and the")]
_CORPUS_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _CORPUS_SYNONYMS)


@query(
    "fts_clause_search",
    rf"""WITH t AS (SELECT item_id, unnest(terms) AS token, unnest(range(len(terms))) AS pos FROM {query_tokens_sql("(SELECT item_id, text || ' tion ing' AS text FROM benchmark)", "item_id")}),
    p AS (SELECT item_id, pos, coalesce({_prefix_case('token')}, CASE WHEN length(token) >= 6 THEN token END) AS term FROM t),
    s AS (SELECT DISTINCT item_id, syn AS term FROM t JOIN (VALUES {_CORPUS_VALUES}) v(word, syn) ON token = word WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.item_id = t.item_id AND x.token = syn AND x.pos <= t.pos)),
    cl AS (SELECT item_id, 'exact' AS kind, token AS term FROM t UNION ALL SELECT item_id, 'prefix', term FROM p WHERE term IS NOT NULL UNION ALL SELECT item_id, 'synonym', term FROM s),
    tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents)),
    tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), voc AS (SELECT DISTINCT term FROM tf),
    size AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id), total AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS average_length),
    u AS (SELECT DISTINCT kind, term FROM cl),
    hits AS (SELECT kind, term, doc_id, tf FROM u JOIN tf USING (term) WHERE kind <> 'prefix' AND NOT contains(term, ' ')
        UNION ALL SELECT kind, u.term, doc_id, CAST(sum(tf) AS BIGINT) FROM u JOIN voc ON starts_with(voc.term, u.term) JOIN tf ON tf.term = voc.term WHERE kind = 'prefix' GROUP BY ALL
        UNION ALL SELECT kind, u.term, a.doc_id, count(*) FROM u JOIN tok a ON a.term = split_part(u.term, ' ', 1) JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = split_part(u.term, ' ', 2) WHERE kind = 'synonym' AND contains(u.term, ' ') GROUP BY ALL),
    df AS (SELECT kind, term, count(*) AS df FROM hits GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average_length))), 6) AS score
        FROM cl JOIN hits USING (kind, term) JOIN df USING (kind, term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10""",
)
def fts_clause_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for the OR of each question's words, beginnings and synonyms (phrases among them), from postings with positions."""
    asked = table(spark, sf, "benchmark").select("item_id", F.concat("text", F.lit(" tion ing")).alias("text"))
    c = written(routes.clauses(asked, "item_id", "text", spark.createDataFrame(_CORPUS_SYNONYMS, "word string, syn string")), "clauses")
    docs = table(spark, sf, "documents")
    postings = written(positions.positional(docs, "doc_id", "text"), "positions")
    scores = positions.clause_scores(docs, "doc_id", "text", postings, c, "item_id")
    return positions.ranked(scores, "item_id", "doc_id", 10)
