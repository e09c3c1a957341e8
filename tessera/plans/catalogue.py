"""Filters, projections, sinks and rules that the other modules do not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import intervals, passages, search, store, structure
from tessera.plans.search import _TOKENS
from tessera.registry import query
from tessera.sources.shared import written
from tessera.sources.tables import messages, table


@query("flt_contains_phrase", r"SELECT doc_id FROM documents WHERE regexp_matches(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g') || ' ', ' in the ')")
def flt_contains_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase whose neighbours are no letters or digits."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", " "), F.lit(" "))
    return table(spark, sf, "documents").where(F.contains(flat, F.lit(" in the "))).select("doc_id")


@query("flt_session_id", "SELECT event_id, s <> '' AND strlen(s) <= 256 AND regexp_matches(s, '^[A-Za-z0-9_-]+$') AS valid FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'a b' ELSE event_type || '-' || user_id END AS s FROM events)")
def flt_session_id(spark: SparkSession, sf: str) -> DataFrame:
    s = F.expr("CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'a b' ELSE concat(event_type, '-', user_id) END")
    return table(spark, sf, "events").select("event_id", ((s != "") & (F.octet_length(s) <= 256) & s.rlike("^[A-Za-z0-9_-]+$")).alias("valid"))


@query("flt_role_and_length", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 20")
def flt_role_and_length(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant") & (F.length(F.trim("text")) >= 20)).select("conv_id", "turn")


@query("flt_interval_containment", "SELECT o_orderkey FROM orders WHERE o_totalprice * 0.9 <= 150000 AND o_totalprice * 1.1 >= 150000")
def flt_interval_containment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_totalprice * 0.9 <= 150000 AND o_totalprice * 1.1 >= 150000").select("o_orderkey")


@query("flt_prefix_label", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'STANDARD') OR starts_with(p_brand, 'Brand#1')")
def flt_prefix_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_type").startswith("STANDARD") | F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("flt_unescaped_like", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a_e%'")
def flt_unescaped_like(spark: SparkSession, sf: str) -> DataFrame:
    """The user's own wildcards count."""
    return table(spark, sf, "part").where(F.col("p_name").ilike("%a_e%")).select("p_partkey")


@query("flt_registry_search", "SELECT p_partkey, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'brass') QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 20")
def flt_registry_search(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty of all that match, with how many there are."""
    found = table(spark, sf, "part").where(F.contains(F.lower("p_name"), F.lit("an")) | F.contains(F.lower("p_type"), F.lit("brass")))
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey").crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


@query("prj_conversation_summary", r"""WITH u AS (SELECT conv_id, min_by(text, turn) AS first, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT c.conv_id, coalesce(CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END, 'Conversation ' || c.conv_id) AS title, c.n AS n_messages FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c LEFT JOIN (SELECT conv_id, trim(regexp_replace(first, '\s+', ' ', 'g')) AS t FROM u) u USING (conv_id)""")
def prj_conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    title = T.shortened(T.collapse(F.col("first")), 50)
    return c.select("conv_id", F.coalesce(title, F.concat(F.lit("Conversation "), "conv_id")).alias("title"), "n_messages")


@query("jn_as_of", "SELECT event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.ts <= a.ts) AS last_signup FROM events a WHERE event_type = 'purchase'")
def jn_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The latest sign-up before each purchase: one window over both kinds, no pairs."""
    e = table(spark, sf, "events").where("event_type IN ('signup', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_signup", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w)).where("event_type = 'purchase'").select("event_id", "last_signup")


@query("jn_pair_completion", "SELECT a.conv_id, a.turn, coalesce(b.turn, c.turn) AS partner FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND a.role = 'user' AND b.turn = a.turn + 1 AND b.role = 'assistant' LEFT JOIN conversations c ON c.conv_id = a.conv_id AND a.role = 'assistant' AND c.turn = a.turn - 1 AND c.role = 'user' WHERE a.role IN ('user', 'assistant')")
def jn_pair_completion(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("message_index")
    both = lambda f: f(F.struct("message_index", "role")).over(w)
    m = messages(spark, sf).withColumn("next", both(F.lead)).withColumn("before", both(F.lag))
    partner = F.when((F.col("role") == "user") & (F.col("next.role") == "assistant"), F.col("next.message_index")).when((F.col("role") == "assistant") & (F.col("before.role") == "user"), F.col("before.message_index"))
    return m.where(F.col("role").isin("user", "assistant")).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), partner.alias("partner"))


@query("jn_page_overlap", "SELECT a.doc_id, count(*) AS n FROM (SELECT doc_id, source, n_chars % 90 AS f, n_chars % 90 + 4 AS t FROM documents) a JOIN (SELECT s_suppkey % 20 AS src, s_suppkey % 70 AS f, s_suppkey % 70 + 2 AS t FROM supplier) b ON a.source = 'src' || b.src AND a.f <= b.t AND a.t >= b.f GROUP BY a.doc_id")
def jn_page_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").selectExpr("doc_id", "source", "n_chars % 90 AS f", "n_chars % 90 + 4 AS t")
    b = table(spark, sf, "supplier").selectExpr("concat('src', s_suppkey % 20) AS src", "s_suppkey % 70 AS bf", "s_suppkey % 70 + 2 AS bt")
    return intervals.overlapping(a, b, [("source", "src")], ("f", "t"), ("bf", "bt"), 4).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("agg_tag_list", "SELECT source, string_agg(lang, ',' ORDER BY lang) AS tags FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def agg_tag_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("tags"))


@query("agg_registry_stats", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY o_orderstatus")
def agg_registry_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("size"))


@query("agg_term_frequency", f"SELECT lang, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM (SELECT lang, unnest({_TOKENS('text')}) AS term FROM documents) WHERE strlen(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY lang")
def agg_term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("term")).where((F.octet_length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$"))
    c = t.groupBy("lang", "term").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.sum("n").alias("n_terms"), F.count("*").alias("n_distinct"))


@query("snk_insert_if_exists", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def snk_insert_if_exists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").where("lang = 'de'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("snk_link_once", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def snk_link_once(spark: SparkSession, sf: str) -> DataFrame:
    return store.link_once(table(spark, sf, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("snk_stamp", "SELECT event_id, CASE WHEN props IS NULL OR event_type = 'view' THEN user_id ELSE NULL END AS stamp FROM events")
def snk_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.when(F.col("props").isNull() | (F.col("event_type") == "view"), F.col("user_id")).alias("stamp"))


@query("snk_cascade_delete", "SELECT c.conv_id, c.turn FROM conversations c WHERE c.conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def snk_cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    gone = c.where("role = 'system'").select("conv_id").distinct()
    return store.delete_with_children(c.select("conv_id").distinct(), gone, "conv_id", {"turns": (c, "conv_id")})["turns"].select("conv_id", "turn")


@query("snk_embed_status", "SELECT source, count(*) AS chunk_count, count(quality) AS embedded_count, CASE WHEN count(quality) >= count(*) THEN 'embedded' WHEN count(quality) > 0 THEN 'embedding' ELSE 'chunked' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def snk_embed_status(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("chunk_count"), F.count("quality").alias("embedded_count"))
    return d.withColumn("status", F.when(F.col("embedded_count") >= F.col("chunk_count"), "embedded").when(F.col("embedded_count") > 0, "embedding").otherwise("chunked"))


@query("tk_longest_prefix", "SELECT p_partkey, max_by(n_name, (length(n_name), n_name)) AS nation FROM part JOIN nation ON starts_with(lower(p_name), lower(left(n_name, 1))) GROUP BY p_partkey")
def tk_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name", F.lower(F.substring("n_name", 1, 1)).alias("first"))
    p = table(spark, sf, "part").select("p_partkey", F.lower(F.substring("p_name", 1, 1)).alias("first"))
    return p.join(n, "first").groupBy("p_partkey").agg(F.max_by("n_name", F.struct(F.length("n_name"), "n_name")).alias("nation"))


@query("ret_options", "SELECT event_id, CAST(greatest(3, least(10, floor(b / 1500.0))) AS INTEGER) AS most_passages, CAST(greatest(1200, least(4000, floor(b / 3.0))) AS INTEGER) AS most_bytes FROM (SELECT event_id, event_id * 7 % 30000 AS b FROM events)")
def ret_options(spark: SparkSession, sf: str) -> DataFrame:
    n, most = passages.options(F.col("event_id") * 7 % 30000)
    return table(spark, sf, "events").select("event_id", n.alias("most_passages"), most.alias("most_bytes"))


@query("ret_about_documents", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '[a-z0-9_-]+\\.(pdf|docx)') OR contains(lower(text), 'that') THEN 'retrieve' WHEN length(text) < 40 THEN 'unrelated' WHEN turn % 10 >= 5.5 THEN 'retrieve' WHEN turn % 10 < 2.5 THEN 'unrelated' ELSE 'unclear' END AS decision FROM conversations")
def ret_about_documents(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    decision = passages.about_documents(low.rlike(r"[a-z0-9_-]+\.(pdf|docx)"), F.contains(low, F.lit("that")), (F.col("turn") % 10) / 10, F.lit(0), F.length("text") < 40)
    return table(spark, sf, "conversations").select("conv_id", "turn", decision.alias("decision"))


@query("ret_passages")
def ret_passages(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over chunks, then passages of 6,000 bytes for each question."""
    chunks = structure.chunks(table(spark, sf, "documents"), "doc_id", "text").where("NOT is_toc").withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("ord"))
    chunks = written(chunks, "chunks")  # the search and the assembly read them
    terms = search.query_terms(table(spark, sf, "benchmark"), "item_id", "text")
    hits = search.best(search.bm25(chunks, "chunk_id", "text", terms, "item_id"), "item_id", "chunk_id", 50)
    hits = hits.select(F.col("item_id").alias("query_id"), F.floor(F.col("chunk_id") / 1_000_000).alias("doc_id"), (F.col("chunk_id") % 1_000_000).cast("int").alias("ord"), "score")
    return passages.assembled(hits, chunks.select("doc_id", "ord", "section", "text"), 6000)


@query("mem_plan", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(earlier|before|previous|last time)\\b') AS past, length(text) > 30 AS detailed, CAST(greatest(10, least(100, length(text) // 50)) AS BIGINT) AS most FROM conversations WHERE role = 'user'")
def mem_plan(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").where("role = 'user'")
    return m.select("conv_id", "turn", F.lower("text").rlike(r"\b(earlier|before|previous|last time)\b").alias("past"), (F.length("text") > 30).alias("detailed"), F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.length("text") / 50))).cast("long").alias("most"))


@query("mem_complexity", "SELECT conv_id, turn, round(least(1.0, least(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')), 50) / 100.0 + least(len(regexp_extract_all(text, '[,;]')), 5) / 10.0), 6) AS complexity FROM conversations WHERE role = 'user'")
def mem_complexity(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.split(T.collapse(F.col("text")), " "))
    clauses = F.regexp_count("text", F.lit("[,;]"))
    c = F.least(F.lit(1.0), F.least(words, F.lit(50)) / 100.0 + F.least(clauses, F.lit(5)) / 10.0)
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.round(c, 6).alias("complexity"))


@query("mem_replay", "SELECT c.conv_id, c.turn, CASE WHEN n.turn IS NOT NULL THEN 'recorded ' || c.turn ELSE c.text END AS content FROM conversations c LEFT JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) > 100) n ON n.conv_id = c.conv_id AND n.turn = c.turn AND n.text = c.text")
def mem_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Stored turns give way to their recorded text where index and content agree."""
    c = table(spark, sf, "conversations")
    r = c.where("role = 'user' AND length(text) > 100").select("conv_id", "turn", F.col("text").alias("said"), F.concat(F.lit("recorded "), "turn").alias("recorded"))
    j = c.join(r, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", F.when(F.col("said") == F.col("text"), F.col("recorded")).otherwise(F.col("text")).alias("content"))


@query("rcm_compatibility", "SELECT p_partkey, CAST(round(greatest(0, least(1, (CASE WHEN p_size <= 20 THEN 1.0 WHEN p_size <= 40 THEN 0.7 ELSE 0.3 END) * (CASE WHEN p_retailprice < 1000 THEN 1.0 ELSE 0.8 END))), 6) AS DOUBLE) AS score FROM part")
def rcm_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """Multiplicative factors, held between 0 and 1."""
    fits = F.when(F.col("p_size") <= 20, 1.0).when(F.col("p_size") <= 40, 0.7).otherwise(0.3)
    price = F.when(F.col("p_retailprice") < 1000, 1.0).otherwise(0.8)
    return table(spark, sf, "part").select("p_partkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fits * price)), 6).alias("score"))
