"""References to earlier material, recall of dropped turns, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import memory, recall, references, vectors
from tessera.plans.search import _CONTENT, _TOKENS
from tessera.registry import query
from tessera.sources.tables import messages, table

#: Questions that refer to earlier material in each way, or not at all.
QUESTIONS = (
    "What did we say about the lease yesterday?", "Open contract_v2.pdf and Notes.TXT please", "And also, what about before?", "Also explain refunds", "We discussed it before", "beforehand and although",
    "what was my first question?", "What did I initially ask?", "show the message two messages ago", "answer question number 7 again", "the last question", "Summarise my question 3",
    "Is this still standard, as mentioned?", "previous agreement of 2020", "The priority is earliness",
)
_ASKED = "q AS (SELECT -row_number() OVER () AS id, question FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + "')" for q in QUESTIONS) + ") v(question) UNION ALL SELECT conv_id * 100000 + turn, text FROM conversations WHERE role = 'user')"


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    literal = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(QUESTIONS)], "id long, question string")
    m = messages(spark, sf).where("role = 'user'").select((F.col("session_id") * 100000 + F.col("message_index")).alias("id"), F.col("content").alias("question"))
    return literal.unionByName(m)


_STRONG = references.phrase_pattern(references.STRONG).replace("'", "''")
_WEAK = " + ".join(f"CAST(regexp_matches(low, '{references.phrase_pattern([p])}') AS INTEGER)" for p in references.WEAK)


@query("ref_signals", rf"WITH {_ASKED}, l AS (SELECT id, lower(question) AS low FROM q) SELECT id, list_aggregate(list_distinct(regexp_extract_all(low, '{references.FILE_NAME}', 1)), 'count') AS n_files, regexp_matches(low, '{references.CERTAIN}') OR regexp_matches(low, '{_STRONG}') AS strong, CASE WHEN regexp_matches(low, '{references.CERTAIN}') THEN 0 ELSE {_WEAK} END AS weak FROM l")
def ref_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = references.signals(_questions(spark, sf), "question", F.lit("2026-03-04 00:00:00").cast("timestamp"))
    return s.select("id", F.size("files").cast("long").alias("n_files"), "strong", "weak")


_NAME = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:2], '_') || '.pdf'"
_FILLER = ", ".join(f"'{w}'" for w in sorted({*T.STOP_WORDS, *references.DETERMINERS}))


@query(
    "ref_described",
    rf"""WITH q AS (SELECT conv_id * 100000 + turn AS id, list_distinct({_TOKENS('text')}) AS t FROM conversations WHERE role = 'user'),
    f AS (SELECT name, list_distinct(list_filter({_TOKENS('stem')}, lambda w: length(w) >= 3 AND NOT list_contains([{_FILLER}], w))) AS w, length(stem) AS n FROM (SELECT DISTINCT {_NAME} AS name, regexp_replace({_NAME}, '\.[A-Za-z0-9]+$', '') AS stem FROM documents))
    SELECT id, name FROM q, f WHERE n >= 5 AND len(w) > 0 AND list_has_all(t, w)""",
)
def ref_described(spark: SparkSession, sf: str) -> DataFrame:
    """Files, named by the first two words of a document, that a question describes with all of their words."""
    name = F.concat(F.array_join(F.slice(T.tokens(F.col("text")), 1, 2), "_"), F.lit(".pdf"))
    files = table(spark, sf, "documents").select(name.alias("name"), F.col("doc_id").alias("latest")).groupBy("name").agg(F.max("latest").alias("latest"))
    found = references.described(_questions(spark, sf).where("id >= 0"), "id", "question", files, "name", "latest")
    return found.where("how = 'words'").select("id", "name")


_OF = lambda value, listed: f"CASE {value} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in listed) + " END"
_BACK = f"coalesce(TRY_CAST(ago AS INTEGER), {_OF('ago', [(w, i + 1) for i, w in enumerate(memory.NUMBERS)])})"


@query(
    "mem_detected_ordinal",
    rf"""WITH {_ASKED}, l AS (SELECT id, lower(question) AS low FROM q), e AS (SELECT id, low, regexp_extract(low, '{memory.NTH}', 1) AS nth, regexp_extract(low, '{memory.AGO}', 1) AS ago,
        TRY_CAST(coalesce(nullif(regexp_extract(low, '{memory.NUMBERED}', 1), ''), nullif(regexp_extract(low, '{memory.OWN_NUMBERED}', 1), '')) AS INTEGER) AS number FROM l)
    SELECT id, CASE WHEN regexp_matches(low, '{memory.ASKED_FIRST}') THEN 1 WHEN nth <> '' THEN {_OF('nth', memory.ORDINALS.items())} WHEN ago <> '' AND {_BACK} >= 1 THEN -{_BACK} WHEN number >= 1 THEN number END AS ordinal FROM e""",
)
def mem_detected_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("id", memory.detected_ordinal(F.col("question")).alias("ordinal"))


def _asked_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last question of each conversation; what precedes it by two messages or more has left the prompt."""
    u = messages(spark, sf).where("role = 'user'")
    last = u.groupBy("session_id").agg(F.max_by("content", "message_index").alias("question"), F.max("message_index").alias("current_index"))
    return last.select(F.col("session_id").alias("ask_id"), "session_id", "question", (F.col("current_index") - 2).alias("cutoff"), "current_index")


def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    return recall.dropped_turns(messages(spark, sf), _asked_last(spark, sf), 2000, near_turns(spark, sf))


def near_turns(spark: SparkSession, sf: str, least: float = 0.45) -> DataFrame:
    """ask_id, message_index, score: messages of a conversation that are near its last question by their letter trigrams."""
    asked = _asked_last(spark, sf)
    m = messages(spark, sf).where("role IN ('user', 'assistant')")
    own = vectors.trigram_embedded(m.withColumn("id", F.col("session_id") * 100000 + F.col("message_index")), "id", "content")
    q = vectors.queries(vectors.trigram_embedded(asked, "ask_id", "question"), "ask_id", "embedding", 512).withColumn("session", F.col("query_id"))
    index = vectors.indexed(own, "id", "embedding", 512).withColumn("session", F.floor(F.col("id") / 100000).cast("long"))
    near = vectors.near_of_same(index, "id", q, "session", least)
    return near.select(F.col("query_id").alias("ask_id"), (F.col("id") % 100000).alias("message_index"), "score")


@query("mem_recall_dropped")
def mem_recall_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return _dropped(spark, sf)


@query("mem_recall_block")
def mem_recall_block(spark: SparkSession, sf: str) -> DataFrame:
    return recall.block(_dropped(spark, sf))


@query("mem_summary_entries")
def mem_summary_entries(spark: SparkSession, sf: str) -> DataFrame:
    return recall.entries(messages(spark, sf))


@query("mem_summary")
def mem_summary(spark: SparkSession, sf: str) -> DataFrame:
    return recall.rendered_summary(recall.entries(messages(spark, sf)), 600)


@query("mem_round_key")
def mem_round_key(spark: SparkSession, sf: str) -> DataFrame:
    return recall.round_keys(messages(spark, sf))


@query("mem_same_without_words", f"SELECT a.item_id, b.doc_id FROM benchmark a JOIN documents b ON lower(trim(a.text)) = lower(trim(b.text)) WHERE len({_CONTENT(_TOKENS('a.text'))}) = 0 AND len({_CONTENT(_TOKENS('b.text'))}) = 0")
def mem_same_without_words(spark: SparkSession, sf: str) -> DataFrame:
    return memory.same_without_words(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"), "doc_id", "text")
