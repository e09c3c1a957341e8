"""Upkeep of stored state, small filters and orders, JSON sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import upkeep
from tessera.plans.search import _STOP
from tessera.registry import query
from tessera.sources.shared import working_folder
from tessera.sources.tables import messages, table

_STATES = "s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'embedded' WHEN 1 THEN 'chunked' ELSE 'failed' END AS status FROM documents)"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'embedded' WHEN 1 THEN 'chunked' ELSE 'failed' END").alias("status"))


def _bad(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()


_LINES = "c AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS ord, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))


@query("snk_repair", f"WITH b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), {_LINES}, d AS (SELECT doc_id, CASE WHEN doc_id IN (FROM b) THEN 'repaired' ELSE 'ok' END AS status, CASE WHEN doc_id IN (FROM b) THEN 7 ELSE length(text) END AS char_count FROM documents), n AS (SELECT doc_id, count(*) AS chunks FROM c WHERE doc_id NOT IN (FROM b) GROUP BY doc_id UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id IN (FROM b)) SELECT doc_id, status, CAST(char_count AS BIGINT) AS char_count, chunks FROM d JOIN n USING (doc_id)")
def snk_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a new text of seven characters: it replaces text, status, size and chunks."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit("ok").alias("status"), F.length("text").cast("long").alias("char_count"))
    fixed = _bad(spark, sf).select("doc_id", F.lit("removed").alias("text"), F.lit("repaired").alias("status"))
    made = fixed.select("doc_id", F.lit(0).alias("ord"), "text")
    out = upkeep.repaired(d, _chunks(spark, sf), fixed, made, "doc_id")
    return out["documents"].join(out["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id").select("doc_id", "status", "char_count", "chunks")


@query("snk_clear_index", f"WITH {_STATES}, b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), {_LINES} SELECT 'chunk' AS kind, doc_id, count(*) AS n, '' AS status FROM c WHERE doc_id NOT IN (FROM b) GROUP BY doc_id UNION ALL SELECT 'state', doc_id, 0, CASE WHEN doc_id IN (FROM b) THEN 'failed' ELSE status END FROM (SELECT doc_id, status FROM s UNION SELECT doc_id, 'failed' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM s))")
def snk_clear_index(spark: SparkSession, sf: str) -> DataFrame:
    states = _states(spark, sf).withColumn("error", F.lit(None).cast("string"))
    out = upkeep.cleared_index(_chunks(spark, sf), states, _bad(spark, sf), "doc_id", "cleared")
    chunks = out["chunks"].groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("chunk").alias("kind"), "doc_id", "n", F.lit("").alias("status"))
    return chunks.unionByName(out["states"].select(F.lit("state").alias("kind"), "doc_id", F.lit(0).cast("long").alias("n"), "status"))


@query("snk_clear_vectors", f"WITH {_STATES} SELECT doc_id, CASE status WHEN 'embedded' THEN 'chunked' ELSE status END AS status FROM s")
def snk_clear_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.without_vectors(_states(spark, sf))


@query("snk_kv", "WITH o AS (SELECT user_id AS k, event_id AS v FROM events WHERE event_type = 'view'), n AS (SELECT user_id AS k, event_id AS v FROM events WHERE event_type = 'signup'), u AS (SELECT user_id AS k, max(event_id) AS used FROM events WHERE event_type = 'click' GROUP BY user_id), p AS (SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n) SELECT k, count(*) AS n, max(greatest(v, coalesce(used, v))) AS last_used FROM p LEFT JOIN u USING (k) GROUP BY k")
def snk_kv(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups replace the entries of their users, clicks touch them."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    out = upkeep.touched_entries(upkeep.put_entries(of("view"), of("signup"), "k"), of("click"), "k", "v")
    return out.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("last_used"))


_ITEMS = "i AS (SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS tier, ts, CAST(floor(abs(value)) AS BIGINT) + 1 AS b FROM events)"


@query("ret_tiers", f"WITH {_ITEMS}, r AS (SELECT event_id, tier, sum(b) OVER (ORDER BY tier, epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i) SELECT event_id, tier FROM r WHERE coalesce(before, 0) < (SELECT sum(b) * 0.6 FROM i)")
def ret_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """What goes, kind by kind and the longest unused first, until six tenths of all bytes are free."""
    e = table(spark, sf, "events").select("event_id", F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END").alias("tier"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.floor(F.abs("value")).cast("long") + 1).alias("b"))
    needed = e.agg((F.sum("b") * 0.6).alias("needed"))
    return upkeep.enough(e, ["at", "event_id"], "b", needed, "tier").select("event_id", "tier")


_VERSIONS = "v AS (SELECT o_custkey AS draft, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version_no, o_orderkey AS body FROM orders)"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("draft"), n.alias("version_no"), F.col("o_orderkey").alias("body"))


@query("drf_current", f"WITH {_VERSIONS} SELECT draft, max(version_no) AS version_no, max_by(body, version_no) AS body FROM v GROUP BY draft")
def drf_current(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.current_versions(_versions(spark, sf), "draft", "version_no")


@query("drf_restored", f"WITH {_VERSIONS}, n AS (SELECT draft, max(version_no) AS m FROM v GROUP BY draft) SELECT draft, version_no, body FROM v UNION ALL SELECT draft, CAST(m + 1 AS INTEGER), body FROM v JOIN n USING (draft) WHERE version_no = 1 AND draft % 2 = 0")
def drf_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The first version of every second draft comes back as its newest."""
    v = _versions(spark, sf)
    wanted = v.where("version_no = 1 AND draft % 2 = 0").select("draft", "version_no")
    return upkeep.restored(v, wanted, "draft", "version_no")


@query("drf_superseded", f"WITH {_VERSIONS} SELECT draft, version_no FROM v QUALIFY version_no < max(version_no) OVER (PARTITION BY draft)")
def drf_superseded(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.superseded(_versions(spark, sf), "draft", "version_no").select("draft", "version_no")


@query("flt_covers_most", "SELECT doc_id FROM documents WHERE len(list_filter(['the', 'and', 'ing', 'ion', 'est'], lambda t: contains(lower(text), t))) >= 3")
def flt_covers_most(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(*map(F.lit, ["the", "and", "ing", "ion", "est"]))
    return table(spark, sf, "documents").where(upkeep.covers_most(F.col("text"), terms)).select("doc_id")


@query("flt_named_by", r"SELECT p_partkey FROM part WHERE len(list_filter(list_filter(regexp_split_to_array('show the steel, small or LARGE tin', '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4), lambda w: contains(lower(p_name || ' ' || p_type), lower(w)))) > 0")
def flt_named_by(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf, "part").where(upkeep.named_by(name, F.lit("show the steel, small or LARGE tin"))).select("p_partkey")


@query("flt_other_sessions", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 3 AND contains(lower(text), 'the')")
def flt_other_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).where((F.col("session_id") != 3) & F.contains(F.lower("content"), F.lit("the"))).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"))


@query("fts_keywords", rf"SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda w: lower(w)), lambda w: strlen(w) > 3 AND NOT list_contains([{_STOP}], w)), ' ') AS keywords FROM conversations")
def fts_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(upkeep.keywords(F.col("text"), T.STOP_WORDS), " ").alias("keywords"))


@query("vec_embedding_input", r"SELECT doc_id, concat_ws(chr(10), nullif(trim(translate(regexp_replace(source || '_' || lang || '-v2.pdf', '\.[^.]*$', ''), '_-', '  ')), ''), nullif(CASE WHEN doc_id % 2 = 0 THEN 'Part 1 > ' || lang ELSE '' END, ''), text) AS input FROM documents")
def vec_embedding_input(spark: SparkSession, sf: str) -> DataFrame:
    name, section = F.concat("source", F.lit("_"), "lang", F.lit("-v2.pdf")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Part 1 > "), "lang")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", upkeep.embedding_input(name, section, F.col("text")).alias("input"))


@query("vec_message_parts")
def vec_message_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(upkeep.message_parts(F.col("text"), 60)).alias("part", "piece"))


@query("sort_importance", "WITH m AS (SELECT conv_id, turn, role, length(text) % 5 AS importance, max(turn) OVER (PARTITION BY conv_id) AS recent FROM conversations) SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY importance DESC, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, recent DESC, turn DESC, conv_id) AS INTEGER) AS place FROM m QUALIFY place <= 50")
def sort_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty most important messages: importance, answers last, then the conversation's and the message's recency."""
    m = table(spark, sf, "conversations")
    recent = m.groupBy("conv_id").agg(F.max("turn").alias("recent"))
    m = m.withColumn("importance", F.length("text") % 5).join(recent, "conv_id")
    order = [F.desc("importance"), F.when(F.col("role") == "assistant", 1).otherwise(0), F.desc("recent"), F.desc("turn"), F.col("conv_id")]
    top = m.orderBy(*order).limit(50)  # the limit comes before the numbering
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("conv_id", "turn", "place")


@query("sort_flag_first", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size > 40 DESC, p_name, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 100")
def sort_flag_first(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged rows first, then by name; a page of a hundred."""
    order = [F.desc(F.col("p_size") > 40), F.col("p_name"), F.col("p_partkey")]
    top = table(spark, sf, "part").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("p_partkey", "place")


@query("agg_sheet_selection", "SELECT source, count(*) AS cells, count(TRY_CAST(v AS DOUBLE)) AS numbers, round(sum(TRY_CAST(v AS DOUBLE)), 4) AS total, round(avg(TRY_CAST(v AS DOUBLE)), 6) AS average FROM (SELECT source, CASE WHEN doc_id % 4 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS v FROM documents) GROUP BY source")
def agg_sheet_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Count, sum and average of the cells of a column that are numbers."""
    v = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string")).try_cast("double")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("cells"), F.count(v).alias("numbers"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("average"))


@query("src_jsonl_questions", "SELECT item_id, text AS question, CAST(item_id % 7 AS INTEGER) AS first_page FROM benchmark")
def src_jsonl_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written as JSON lines and read with their schema."""
    path = working_folder(spark, "questions")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.array((F.col("item_id") % 7).cast("int"), F.lit(9)).alias("expected_pages"))
    b.write.json(path)
    q = spark.read.schema("item_id long, question string, expected_pages array<int>").json(path)
    return q.select("item_id", "question", F.element_at("expected_pages", 1).alias("first_page"))


@query("src_json_catalogue", "SELECT DISTINCT source AS key, lang || '.txt' AS file, upper(lang) AS tag FROM documents")
def src_json_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue of documents as one JSON value for each entry, with tags."""
    path = working_folder(spark, "catalogue")
    d = table(spark, sf, "documents").select(F.col("source").alias("key"), F.concat("lang", F.lit(".txt")).alias("file"), F.array(F.upper("lang")).alias("tags")).distinct()
    d.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    c = spark.read.option("multiLine", False).schema("key string, file string, tags array<string>").json(path)
    return c.select("key", "file", F.explode("tags").alias("tag"))
