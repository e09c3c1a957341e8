"""Verification, comparison, evaluation, retention, sources, streaming, and text operators without an SQL form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stemming
from tessera.functions import text as T
from tessera.operators import quality, search, vectors
from tessera.plans.search import _TOKENS, _bm25_sql, _scores
from tessera.registry import query
from tessera.sources import files
from tessera.sources.shared import working_folder, written
from tessera.sources.tables import messages, table
from tessera.streaming import indexer

# --- evaluation ---------------------------------------------------------------------------------------------------

_RANKED = f"{_bm25_sql()}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s), f AS (SELECT item_id, min(CASE WHEN quality = 1 THEN rank END) AS first FROM (SELECT * FROM r WHERE rank <= 10) LEFT JOIN labels USING (doc_id) GROUP BY item_id)"


@query("eval_hit_mrr", f"WITH {_RANKED} SELECT count(*) AS questions, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f")
def eval_hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    ranked = search.best(_scores(spark, sf), "item_id", "doc_id", 10)
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").join(ranked.select("item_id", "doc_id"), "doc_id")
    return quality.retrieval_metrics(quality.hits(ranked, good, "item_id", "doc_id"))


@query("eval_percentile", "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events WHERE value IS NOT NULL) SELECT event_type, min(CASE WHEN n - 1 = floor(0.5 * (total - 1) + 0.5) THEN value END) AS p50, min(CASE WHEN n - 1 = floor(0.95 * (total - 1) + 0.5) THEN value END) AS p95 FROM s GROUP BY event_type")
def eval_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.nearest_rank(table(spark, sf, "events"), "event_type", "value", 50, 95)


# --- verification ---------------------------------------------------------------------------------------------------

_ANSWER = "'See [' || source || '.pdf, p. ' || (doc_id % 9) || '] and [x](y) [' || source || '.docx, pp. 2-' || (2 + doc_id % 4) || '].'"
_SPARK_ANSWER = "concat('See [', source, '.pdf, p. ', doc_id % 9, '] and [x](y) [', source, '.docx, pp. 2-', 2 + doc_id % 4, '].')"
_CITED = f"c AS (SELECT doc_id, 0 AS n, source || '.pdf' AS file, CAST(doc_id % 9 AS INTEGER) AS page_from, CAST(doc_id % 9 AS INTEGER) AS page_to FROM documents UNION ALL SELECT doc_id, 1, source || '.docx', 2, CAST(2 + doc_id % 4 AS INTEGER) FROM documents)"


@query("verify_citations", f"WITH {_CITED} SELECT doc_id, CAST(n AS INTEGER) AS n, lower(file) AS file, page_from, page_to FROM c")
def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "documents").select("doc_id", F.expr(_SPARK_ANSWER).alias("answer"))
    return quality.citations(answers, "doc_id", "answer")


@query("verify_pages", f"WITH {_CITED} SELECT doc_id, CAST(n AS INTEGER) AS n FROM c WHERE file IN ('src1.pdf', 'src2.docx') AND page_from <= 4 AND page_to >= 3")
def verify_pages(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "documents").select("doc_id", F.expr(_SPARK_ANSWER).alias("answer"))
    shown = spark.createDataFrame([("src1.pdf", 3, 4), ("src2.docx", 3, 4)], "file string, page_from int, page_to int")
    return quality.verified_pages(quality.citations(answers, "doc_id", "answer"), shown).select("doc_id", "n")


_KNOWN = "k AS (SELECT doc_id, doc_id * 10 + i AS doc, i AS place, CASE i WHEN 0 THEN source || '.pdf' WHEN 1 THEN 'old ' || source || '.docx.pdf' ELSE 'x.txt' END AS name, CASE WHEN i = 0 THEN 5 END AS pages, doc_id % 4 = 0 AND i = 1 AS whole FROM documents, (VALUES (0), (1), (2)) v(i) WHERE (doc_id + i) % 5 > 0)"


@query(
    "verify_resolved",
    f"""WITH {_CITED}, {_KNOWN}, m AS (SELECT c.*, k.*, lower(c.file) = lower(name) AS exact, contains(lower(name), regexp_replace(lower(c.file), '\\.[^.]*$', '')) AS part, coalesce(whole, false) OR coalesce(place = 0 AND page_from >= 2 AND page_to <= 3, false) AS has FROM c LEFT JOIN k USING (doc_id)),
    b AS (SELECT doc_id, n, page_from, page_to, arg_min({{'doc': doc, 'pages': pages, 'has': has}}, CASE WHEN exact THEN 0 WHEN part THEN 100 END + place) FILTER (WHERE exact OR part) AS x FROM m GROUP BY ALL)
    SELECT doc_id, CAST(n AS INTEGER) AS n, x.doc AS doc, CASE WHEN x IS NULL THEN 'not provided' WHEN page_to > x.pages THEN 'no such page' WHEN NOT x.has THEN 'page not shown' ELSE 'ok' END AS verdict FROM b""",
)
def verify_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer knows up to three documents, by whole names and by parts of names; the first showed its pages 2 to 3."""
    d = table(spark, sf, "documents")
    answers = d.select("doc_id", F.expr(_SPARK_ANSWER).alias("answer"))
    k = d.select("doc_id", "source", F.explode(F.array(*map(F.lit, range(3)))).alias("place")).where((F.col("doc_id") + F.col("place")) % 5 > 0)
    name = F.when(F.col("place") == 0, F.concat("source", F.lit(".pdf"))).when(F.col("place") == 1, F.concat(F.lit("old "), "source", F.lit(".docx.pdf"))).otherwise("x.txt")
    known = k.select("doc_id", (F.col("doc_id") * 10 + F.col("place")).alias("doc"), "place", name.alias("name"), F.when(F.col("place") == 0, 5).alias("pages"), ((F.col("doc_id") % 4 == 0) & (F.col("place") == 1)).alias("full"))
    shown = known.where("place = 0").select("doc_id", "doc", F.lit(2).alias("page_from"), F.lit(3).alias("page_to"))
    return quality.resolved_citations(quality.citations(answers, "doc_id", "answer"), "doc_id", known, shown)


_QUOTE = r"trim(regexp_replace(lower(q), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("verify_quotes", f"SELECT conv_id, turn, n - 1 AS n, {_QUOTE} AS quote FROM (SELECT conv_id, turn, unnest(l) AS q, generate_subscripts(l, 1) AS n FROM (SELECT conv_id, turn, regexp_extract_all('He wrote \"' || text || '\" there.', '[\"“]([^\"”“]+)[\"”]', 1) AS l FROM conversations)) WHERE len(string_split({_QUOTE}, ' ')) >= 4")
def verify_quotes(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.concat(F.lit('He wrote "'), "text", F.lit('" there.')).alias("answer"))
    return quality.quotes(m, "key", "answer").select("key.conv_id", "key.turn", F.col("n").cast("long").alias("n"), "quote")


_FORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_TURNS = "t AS (SELECT conv_id, turn, CAST(turn AS INTEGER) AS page, translate(text, '\"“”', '   ') AS text FROM conversations WHERE trim(text) <> '')"
_SHOWN_SQL = f"""WITH {_TURNS}, q AS (SELECT conv_id, turn, 0 AS n, {_FORM.format("text")} AS quote, CAST(page + page % 2 AS INTEGER) AS page FROM t UNION ALL SELECT conv_id, turn, 1, 'words that nobody ever wrote there', page FROM t)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, quote, 'talk' || conv_id || '.txt' AS file, page AS page_from, page AS page_to, EXISTS (SELECT 1 FROM t WHERE t.conv_id = q.conv_id AND t.page = q.page AND contains({_FORM.format("t.text")}, quote)) AS found FROM q WHERE len(string_split(quote, ' ')) >= 4"""


@query("verify_quotes_shown", _SHOWN_SQL)
def verify_quotes_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as quotations with the page cited, one page off for odd turns, and a made-up one; a turn and the next one are shown to each as pages."""
    t = table(spark, sf, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.translate("text", '"“”', "   ").alias("text"), F.col("turn").cast("int").alias("page"))
    name = F.concat(F.lit("talk"), "conv_id", F.lit(".txt"))
    cite = lambda page: F.concat(F.lit(" ["), name, F.lit(", p. "), page, F.lit("]"))
    answers = t.select(F.struct("conv_id", "turn").alias("key"), F.concat(F.lit('He wrote "'), "text", F.lit('"'), cite(F.col("page") + F.col("page") % 2), F.lit(' and "words that nobody ever wrote there"'), cite(F.col("page")), F.lit(".")).alias("answer"))
    pages = t.withColumn("file", name)
    shown = pages.select("conv_id", "turn", "file", "page", "text").unionByName(pages.select("conv_id", (F.col("turn") - 1).alias("turn"), "file", "page", "text"))
    shown = shown.select(F.struct("conv_id", "turn").alias("key"), "file", F.col("page").alias("page_from"), F.col("page").alias("page_to"), "text")
    return quality.verified_quotes(answers, "key", "answer", shown).select("key.conv_id", "key.turn", "n", "quote", "file", "page_from", "page_to", "found")


@query("verify_echo")
def verify_echo(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).where("role = 'assistant'").withColumn("answer", F.concat(F.lit("## Context\nreprinted lines\n\n"), "content"))
    return m.select("session_id", "message_index", F.length(quality.strip_scaffold("answer")).alias("n"))


# --- comparison -----------------------------------------------------------------------------------------------------


@query("cmp_normalise", r"SELECT doc_id, sha256(lower(trim(regexp_replace(translate(text, '‘’“”–—' || chr(160), '''''\"\"-- '), '\s+', ' ', 'g')))) AS folded FROM documents".replace('\\"', '"'))
def cmp_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.folded(F.col("text")), 256).alias("folded"))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against a version in which every second line is altered."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("left_text"), F.split("text", "\n").alias("l"))
    altered = F.transform("l", lambda x, i: F.when(i % 2 == 1, F.concat(x, F.lit(" amended"))).otherwise(x))
    return d.select("doc_id", "left_text", F.array_join(altered, "\n").alias("right_text"))


@query("cmp_diff")
def cmp_diff(spark: SparkSession, sf: str) -> DataFrame:
    return quality.compared(_versions(spark, sf), "doc_id")


@query("cmp_summary")
def cmp_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summary(quality.compared(_versions(spark, sf), "doc_id"), "doc_id")


# --- retention ------------------------------------------------------------------------------------------------------


@query("ret_eviction_lru", "WITH s AS (SELECT *, sum(b) OVER (ORDER BY epoch_us(ts) DESC RANGE UNBOUNDED PRECEDING) AS used FROM (SELECT event_id, ts, CAST(floor(abs(value)) AS BIGINT) + 1 AS b FROM events)) SELECT event_id FROM s WHERE used > 20000")
def ret_eviction_lru(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", (F.floor(F.abs("value")).cast("long") + 1).alias("b"))
    return quality.evicted(e, "b", F.unix_micros(F.col("ts").cast("timestamp")), 20000).select("event_id")


@query("ret_cleanup_age", "SELECT user_id, count(*) AS gone FROM events WHERE ts < (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY user_id")
def ret_cleanup_age(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.crossJoin(F.broadcast(newest)).where(F.col("ts") < F.col("newest") - F.expr("INTERVAL 7 DAY")).groupBy("user_id").agg(F.count("*").alias("gone"))


@query("ret_restore_pays", "SELECT event_id, CAST(floor(abs(value) * 10) AS BIGINT) >= 64 AND (floor(abs(value) * 10) * (40000 + event_id % 2000 * 1000)) / 400000.0 < floor(abs(value) * 10) / 400.0 * 1000 AS pays FROM events")
def ret_restore_pays(spark: SparkSession, sf: str) -> DataFrame:
    """Restoring pays when reading the bytes takes less time than computing the tokens, from 64 tokens on; bytes a token differ."""
    pays = quality.restore_pays(F.floor(F.abs("value") * 10), 40_000 + F.col("event_id") % 2000 * 1000, 400_000.0, 400.0)
    return table(spark, sf, "events").select("event_id", pays.alias("pays"))


@query("ewma_rate", "WITH RECURSIVE e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), r AS (SELECT event_type, n, value AS rate FROM e WHERE n = 1 UNION ALL SELECT e.event_type, e.n, 0.7 * r.rate + 0.3 * e.value FROM e JOIN r ON e.event_type = r.event_type AND e.n = r.n + 1) SELECT event_type, round(max_by(rate, n), 6) AS rate FROM r GROUP BY event_type")
def ewma_rate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ewma(table(spark, sf, "events"), "event_type", "event_id", "value")


# --- sources --------------------------------------------------------------------------------------------------------


@query("src_html_text")
def src_html_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", files.html_column("html").alias("text"))
    return p.select("page_id", "text", files.outcome(F.col("text")).alias("status"))


_OUTCOME = "CASE event_type WHEN 'error' THEN '[No text: ' || event_id || ']' WHEN 'click' THEN '[note]' || chr(10) || 'a rest that is long enough to count' ELSE event_type END"


@query("src_outcome", "SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS status FROM events")
def src_outcome(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_type WHEN 'error' THEN concat('[No text: ', event_id, ']') WHEN 'click' THEN concat('[note]', chr(10), 'a rest that is long enough to count') ELSE event_type END")
    return table(spark, sf, "events").select("event_id", files.outcome(text).alias("status"))


_EXT = "CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'pptx' WHEN 4 THEN 'png' ELSE 'txt' END"


@query("src_lane", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'presentation' WHEN 4 THEN 'image' ELSE 'text' END AS lane, {_EXT} <> 'png' AS attachment FROM documents")
def src_lane(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr(f"concat(source, '.', {_EXT})")
    return table(spark, sf, "documents").select("doc_id", files.lane(name).alias("lane"), files.is_attachment(name).alias("attachment"))


@query("src_references", r"SELECT conv_id, turn, r AS reference FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all('[Attached: ' || role || conv_id || '.pdf] ' || text, '\[Attached: ([^\]]+)\]', 1)) AS r FROM conversations WHERE role = 'user')")
def src_references(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("[Attached: "), "role", "conv_id", F.lit(".pdf] "), "text").alias("t"))
    return m.select("conv_id", "turn", F.explode(F.regexp_extract_all("t", F.lit(r"\[Attached: ([^\]]+)\]"), F.lit(1))).alias("reference")).distinct()


# --- streaming ------------------------------------------------------------------------------------------------------


@query("str_incremental_index", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def str_incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents arrive as files of a stream; the index that the batches leave equals that of one batch."""
    work = working_folder(spark, "stream")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.repartition(4, "doc_id").write.parquet(f"{work}/in")
    indexer.run(spark, f"{work}/in", f"{work}/index", f"{work}/checkpoint", "doc_id long, text string", per_trigger=2)
    p = indexer.current(spark, f"{work}/index")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@query("str_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, CAST(n AS VARCHAR) AS session, count(*) AS n_events FROM s GROUP BY ALL")
def str_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = indexer.sessions(table(spark, sf, "events"))
    w = Window.partitionBy("user_id").orderBy("start")
    return s.select("user_id", F.row_number().over(w).cast("string").alias("session"), "n_events")


# --- text without an SQL form ---------------------------------------------------------------------------------------


@query("fts_stemmed_bm25")
def fts_stemmed_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 on stems: distinct words are stemmed once, then joined back to the texts' words."""
    docs = table(spark, sf, "documents")
    vocabulary = search.postings(docs, "doc_id", "text").select(F.col("term").alias("w")).distinct()
    asked = search.query_terms(table(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("term", "w")
    words = written(vocabulary.union(asked.select("w")).distinct().select("w", stemming.porter("w").alias("stem")), "stems")
    q = asked.join(words, "w").select("item_id", F.col("stem").alias("term")).distinct()
    # only words with a stem of a question matter: they are the terms that the corpus is searched for
    same = words.join(q.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    found = search.matches(docs, "doc_id", {"text": 1.0}, same.select(F.col("w").alias("term")))
    total = found.where("pos = 0 OR pos IS NULL").agg(F.count("*").alias("n_docs"), F.avg("length").alias("average_length"))
    stems = found.where("hit").join(same, F.col("term") == F.col("w")).groupBy("doc_id", "stem").agg(F.sum("weight").alias("tf"), F.first("length").alias("length"))
    df = stems.groupBy("stem").agg(F.count("*").alias("df"))
    w = stems.join(df, "stem").join(q.withColumnRenamed("term", "stem"), "stem").crossJoin(F.broadcast(total))  # total is one row
    s = w.groupBy("item_id", "doc_id").agg(F.round(F.sum(search.idf(F.col("n_docs"), F.col("df")) * search.term_weight(F.col("tf"), F.col("length"), F.col("average_length"))), 6).alias("score"))
    return search.best(s, "item_id", "doc_id", 10)


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in stemming.synonym_pairs())


@query("fts_synonym_expand", f"SELECT role, w AS word, syn, count(*) AS n FROM (SELECT role, unnest({_TOKENS('text')}) AS w FROM conversations UNION ALL SELECT 'query', a FROM (VALUES {_PAIRS}) x(a, b)) JOIN (VALUES {_PAIRS}) p(w2, syn) ON w = w2 GROUP BY ALL")
def fts_synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame(stemming.synonym_pairs(), "word string, syn string")
    m = table(spark, sf, "conversations").select("role", F.explode(T.tokens(F.col("text"))).alias("word")).unionByName(pairs.select(F.lit("query").alias("role"), "word"))
    return m.join(F.broadcast(pairs), "word").groupBy("role", "word", "syn").agg(F.count("*").alias("n"))  # a fixed list


@query("fts_snippet")
def fts_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Fourteen words with the most query words, for the best document of each question."""
    terms = table(spark, sf, "benchmark").select("item_id", T.query_tokens(F.col("text")).alias("terms"))
    best = search.best(_scores(spark, sf), "item_id", "doc_id", 1).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(terms, "item_id")

    def task(frames):
        for f in frames:
            out = []
            for item, doc, text, wanted in zip(f["item_id"], f["doc_id"], f["text"], f["terms"], strict=True):
                words, wanted = text.split(), set(wanted)
                hit = np.array([any(t in wanted for t in _split(w)) for w in words] or [False])
                window = np.convolve(hit, np.ones(14), "full")[13:] if len(hit) > 14 else np.array([hit.sum()])
                a = int(window[: max(1, len(words) - 13)].argmax())
                out.append((item, doc, " ".join(f"\u0002{w}\u0003" if h else w for w, h in zip(words[a : a + 14], hit[a : a + 14], strict=False)) + ("…" if len(words) > a + 14 else "")))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "snippet"])

    return best.select("item_id", "doc_id", "text", "terms").mapInPandas(task, "item_id long, doc_id long, snippet string")


def _split(word: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in word.lower()).split()


@query("fts_topics")
def fts_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three capitalised topics: words after a question word or about, without stop words."""
    m = messages(spark, sf).where("role = 'user'")
    after = F.regexp_extract_all(F.lower("content"), F.lit(r"\b(?:what|how|why|when|where|who|about|regarding)\s+((?:[\p{L}\p{N}]+\s*){1,4})"), F.lit(1))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(after, lambda x: T.content_tokens(x)))))
    return m.select("session_id", "message_index", F.array_join(F.transform(F.slice(words, 1, 3), lambda x: T.capitalised(x)), ", ").alias("topics"))


@query("vec_trigram_embed")
def vec_trigram_embed(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.trigram_embedded(table(spark, sf, "documents"), "doc_id", "text")
