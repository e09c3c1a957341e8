"""Conversation queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import memory, search
from tessera.plans.search import _CONTENT, _TOKENS, _query_terms_sql
from tessera.registry import query
from tessera.sources.tables import messages, table

_M = "m AS (SELECT conv_id AS session_id, turn AS message_index, role, text AS content FROM conversations)"


@query("mem_exchanges", f"WITH {_M} SELECT q.session_id, q.message_index AS question_index, length(q.content) AS question_length, length(a.content) AS answer_length FROM m q LEFT JOIN m a ON a.session_id = q.session_id AND a.message_index = q.message_index + 1 AND a.role = 'assistant' WHERE q.role = 'user'")
def mem_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    e = memory.exchanges(messages(spark, sf))
    return e.select("session_id", "question_index", F.length("question").cast("long").alias("question_length"), F.length("answer").cast("long").alias("answer_length"))


@query("mem_turn_number", f"WITH {_M} SELECT session_id, message_index, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY message_index) AS BIGINT) AS turn_number FROM m")
def mem_turn_number(spark: SparkSession, sf: str) -> DataFrame:
    return memory.turn_numbers(messages(spark, sf)).select("session_id", "message_index", "turn_number")


@query("mem_ordinal", f"WITH {_M}, u AS (SELECT session_id, message_index, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS n, count(*) OVER (PARTITION BY session_id) AS total FROM m WHERE role = 'user') SELECT session_id, ordinal, message_index FROM u, (VALUES (1), (2), (-1)) o(ordinal) WHERE CASE WHEN ordinal > 0 THEN n = ordinal ELSE n = total + ordinal + 1 END")
def mem_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    asked = m.select("session_id").distinct().withColumn("ordinal", F.explode(F.array(F.lit(1), F.lit(2), F.lit(-1))))
    return memory.resolved_ordinal(m, asked)


_PLAIN = r"replace(replace(regexp_replace(trim(line), '^[#>\-*+ |]+', ''), '**', ''), chr(96), '')"
_SENTENCES = rf"list_filter(list_transform(flatten(list_transform(regexp_split_to_array({{0}}, '\r?\n'), lambda line: string_split(regexp_replace({_PLAIN}, '([.!?;。])\s+', '\1' || chr(10), 'g'), chr(10)))), lambda s: trim(s)), lambda s: length(s) > 0)".format


@query("mem_sentences", f"WITH {_M} SELECT session_id, message_index, len({_SENTENCES('content')}) AS n FROM m")
def mem_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("session_id", "message_index", F.size(T.sentences(F.col("content"))).cast("long").alias("n"))


@query(
    "mem_key_points",
    rf"""WITH {_M}, s AS (SELECT session_id, message_index, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT *, {_SENTENCES('content')} AS l FROM m)),
    f AS (SELECT *, min(pos) OVER (PARTITION BY session_id, message_index) AS first FROM s WHERE length(sentence) BETWEEN 25 AND 400),
    p AS (SELECT *, CAST(CASE WHEN regexp_matches(sentence, '\[[^\[\]\n]{{2,120}}\]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 2 ELSE 0 END + 2 * least(2, len(regexp_extract_all(lower(sentence), '{memory.DECISION}')))
        + CASE WHEN regexp_matches(sentence, '["“]') THEN 1 ELSE 0 END + CASE WHEN pos = first THEN 2 ELSE 0 END AS INTEGER) AS score FROM f)
    SELECT session_id, message_index, pos, score FROM p QUALIFY row_number() OVER (PARTITION BY session_id, message_index ORDER BY score DESC, pos) <= 3""",
)
def mem_key_points(spark: SparkSession, sf: str) -> DataFrame:
    return memory.key_points(messages(spark, sf), ["session_id", "message_index"], "content").select("session_id", "message_index", F.col("pos").cast("long").alias("pos"), "score")


_TERMS = f"""t AS (SELECT session_id, term, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT session_id, CASE role WHEN 'user' THEN 2 ELSE 1 END AS weight, unnest({_CONTENT(_TOKENS('content'))}) AS term FROM m WHERE role IN ('user', 'assistant'))
    WHERE strlen(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY session_id, term QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sum(weight) DESC, term) <= 64)"""


@query("mem_topic_terms", f"WITH {_M}, {_TERMS} SELECT * FROM t")
def mem_topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    return memory.topic_terms(messages(spark, sf)).select("session_id", "term", "weight")


@query("mem_topic_match", f"WITH {_M}, {_TERMS}, q AS (SELECT DISTINCT item_id, unnest({_CONTENT(_TOKENS('text'))}) AS term FROM benchmark) SELECT item_id, session_id, CAST(sum(weight) AS BIGINT) AS weight FROM t JOIN q USING (term) GROUP BY ALL")
def mem_topic_match(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("term"))
    return memory.topic_terms(messages(spark, sf)).join(q, "term").groupBy("item_id", "session_id").agg(F.sum("weight").alias("weight"))


def _bm25_messages() -> str:
    return f"""{_M}, {_query_terms_sql()}, d AS (SELECT session_id * 100000 + message_index AS id, session_id, {_TOKENS('content')} AS t FROM m WHERE role IN ('user', 'assistant')),
        size AS (SELECT id, len(t) AS length FROM d), total AS (SELECT count(*) AS n_docs, avg(length) AS average_length FROM size),
        tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT item_id, id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average_length))), 6) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term) JOIN size USING (id), total GROUP BY item_id, id)"""


def _message_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).where("role IN ('user', 'assistant')").withColumn("id", F.col("session_id") * 100000 + F.col("message_index"))
    return search.bm25(m, "id", "content", search.query_terms(table(spark, sf, "benchmark"), "item_id", "text"), "item_id")


@query("mem_session_search", f"WITH {_bm25_messages()} SELECT item_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) <= 30")
def mem_session_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.best(_message_scores(spark, sf), "item_id", "id", 30).select("item_id", "id", "score")


@query("mem_recall", f"WITH {_bm25_messages()}, b AS (SELECT item_id, id // 100000 AS session_id, max(score) AS score FROM s GROUP BY ALL) SELECT item_id, session_id, score FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, session_id) <= 6")
def mem_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The six conversations with the best message for each question."""
    s = _message_scores(spark, sf).groupBy("item_id", F.floor(F.col("id") / 100000).cast("long").alias("session_id")).agg(F.max("score").alias("score"))
    return search.best(s, "item_id", "session_id", 6).select("item_id", "session_id", "score")


@query("mem_near_duplicates", f"""WITH a AS (SELECT item_id, list_distinct({_CONTENT(_TOKENS('text'))}) AS w FROM benchmark), b AS (SELECT doc_id, list_distinct({_CONTENT(_TOKENS('text'))}) AS w FROM documents),
    p AS (SELECT item_id, doc_id, len(list_intersect(a.w, b.w)) AS common, len(a.w) AS n_a, len(b.w) AS n_b FROM a, b)
    SELECT item_id, doc_id, common FROM p WHERE common > 0 AND (common >= 0.6 * (n_a + n_b - common) OR (least(n_a, n_b) >= 3 AND common >= 0.85 * least(n_a, n_b)))""")
def mem_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    a = memory.word_sets(table(spark, sf, "benchmark"), "item_id", "text")
    b = memory.word_sets(table(spark, sf, "documents"), "doc_id", "text")
    return memory.near_duplicates(a, "item_id", b, "doc_id")


@query("mem_duplicate_sessions", f"""WITH {_M}, q AS (SELECT session_id, message_index, list_distinct({_CONTENT(_TOKENS('content'))}) AS w FROM m WHERE role = 'user'),
    i AS (SELECT item_id, list_distinct({_CONTENT(_TOKENS('text'))}) AS w FROM benchmark),
    p AS (SELECT session_id, message_index, item_id, len(list_intersect(q.w, i.w)) AS common, len(q.w) AS n_a, len(i.w) AS n_b FROM q, i)
    SELECT session_id, count(DISTINCT message_index) AS repeated FROM p WHERE common > 0 AND (common >= 0.6 * (n_a + n_b - common) OR (least(n_a, n_b) >= 3 AND common >= 0.5 * least(n_a, n_b))) GROUP BY session_id""")
def mem_duplicate_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that ask what the stated questions ask, with how many of their questions do."""
    m = messages(spark, sf).where("role = 'user'").withColumn("id", F.col("session_id") * 100000 + F.col("message_index"))
    pairs = memory.near_duplicates(memory.word_sets(m, "id", "content"), "id", memory.word_sets(table(spark, sf, "benchmark"), "item_id", "text"), "item_id", containment=0.5)
    return pairs.groupBy(F.floor(F.col("id") / 100000).cast("long").alias("session_id")).agg(F.count_distinct("id").alias("repeated"))


@query("mem_compaction_cut", f"""WITH {_M}, k AS (SELECT *, strlen(content) // 4 + 8 AS tokens FROM m), r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY message_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER (PARTITION BY session_id) AS total FROM k)
    SELECT session_id, CAST(total AS BIGINT) AS total, min(CASE WHEN role = 'user' AND rest <= 0.45 * 400 THEN message_index END) AS cut FROM r WHERE total > 0.8 * 400 GROUP BY session_id, total""")
def mem_compaction_cut(spark: SparkSession, sf: str) -> DataFrame:
    return memory.compaction_cut(messages(spark, sf), 400)


@query("mem_recency_window", f"WITH {_M} SELECT session_id, message_index FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) <= 3")
def mem_recency_window(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recent(messages(spark, sf), 3).select("session_id", "message_index")


@query("mem_recall_recent", rf"""WITH {_M}, u AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS n, left(trim(regexp_replace(content, '\s+', ' ', 'g')), 40) AS q FROM m WHERE role = 'user')
    SELECT session_id, string_agg(q, ' | ' ORDER BY n) AS questions FROM u WHERE n <= 4 GROUP BY session_id""")
def mem_recall_recent(spark: SparkSession, sf: str) -> DataFrame:
    return memory.first_questions(messages(spark, sf))


def _chain_sql() -> str:
    half = lambda start: f"CAST('0x' || substr(md5(message_index || ':' || content), {start}, 15) AS BIGINT)"
    upto = "OVER (PARTITION BY session_id ORDER BY message_index)"
    return f"SELECT session_id, message_index, sha256(sum({half(1)}) {upto} || '-' || sum({half(16)}) {upto}) AS prefix_hash FROM m"


@query("ret_hash_chain", f"WITH {_M} {_chain_sql()}")
def ret_hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    return memory.prefix_hashes(messages(spark, sf))


@query("ret_prefix_lookup", f"WITH {_M}, h AS (SELECT session_id, message_index, prefix_hash AS h FROM ({_chain_sql()})) SELECT a.session_id, max(a.message_index) AS depth FROM h a JOIN h b ON a.h = b.h AND b.session_id < a.session_id GROUP BY a.session_id")
def ret_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The longest prefix of a conversation that an earlier one begins with."""
    h = ret_hash_chain(spark, sf)
    first = h.groupBy("prefix_hash").agg(F.min("session_id").alias("first"))
    return h.join(first, "prefix_hash").where("first < session_id").groupBy("session_id").agg(F.max("message_index").alias("depth"))
