"""Full-text queries over ``documents`` with the items of ``benchmark`` as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import positions, search
from tessera.registry import query
from tessera.sources.shared import working_folder
from tessera.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')".format
_CONTENT = f"list_filter({{0}}, lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t))".format
#: The first places of distinct elements, in order.
_DISTINCT = "list_filter({0}, lambda t, i: list_position({0}, t) = i)".format


_ORIGINAL = f"list_filter(regexp_extract_all({{0}}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], lower(t)))".format
_FOCUS = r"CASE WHEN trim(regexp_extract({0}, '(?is).*question:(.*)$', 1)) <> '' THEN trim(regexp_extract({0}, '(?is).*question:(.*)$', 1)) ELSE regexp_extract({0}, '([^.!?\n:]*)\?[^?]*$', 1) END".format


def query_tokens_sql(table: str, key: str, text: str = "text") -> str:
    """A subquery (key, terms): the words that a query holds, by tiers where there are more than it can hold."""
    tier = r"CASE WHEN list_contains(focus, lower(t)) THEN 0 WHEN regexp_matches(t, '[0-9]|^\p{Lu}') THEN 1 ELSE 2 END"
    return f"""(SELECT {key}, CASE WHEN len(w) <= {T.QUERY_WORDS} THEN {_DISTINCT('low')} ELSE ({_DISTINCT('tiered')})[1:{T.QUERY_WORDS}] END AS terms
        FROM (SELECT {key}, w, list_transform(w, lambda t: lower(t)) AS low, list_transform(list_sort(list_transform(w, lambda t, i: {{'tier': {tier}, 'i': i, 't': lower(t)}})), lambda x: x.t) AS tiered
              FROM (SELECT {key}, {_ORIGINAL(text)} AS w, list_transform({_ORIGINAL(_FOCUS(text))}, lambda t: lower(t)) AS focus FROM {table})))"""


def _query_terms_sql() -> str:
    return f"q AS (SELECT item_id, unnest(terms) AS term FROM {query_tokens_sql('benchmark', 'item_id')})"


def _bm25_sql() -> str:
    return f"""{_query_terms_sql()},
        d AS (SELECT doc_id, source, {_TOKENS('text')} AS t FROM documents),
        size AS (SELECT doc_id, len(t) AS length FROM d),
        total AS (SELECT count(*) AS n_docs, avg(length) AS average_length FROM size),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT item_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average_length))), 6) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)"""


@query("fts_tokens", f"SELECT doc_id, len({_TOKENS('text')}) AS n_tokens, list_aggregate(list_distinct({_TOKENS('text')}), 'count') AS n_distinct FROM documents")
def fts_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("fts_content_tokens", f"SELECT item_id, array_to_string(terms, ' ') AS terms FROM {query_tokens_sql('benchmark', 'item_id')} WHERE len(terms) > 0")
def fts_content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("terms")).where("terms <> ''")


@query("fts_postings", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS('text')}) AS term FROM documents) GROUP BY term")
def fts_postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@query("fts_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({_TOKENS('text')})), 6) AS average_length FROM documents")
def fts_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = search.corpus_statistics(search.lengths(table(spark, sf, "documents"), "doc_id", "text"))
    return s.select("n_docs", F.round("average_length", 6).alias("average_length"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), "doc_id", "text", search.query_terms(table(spark, sf, "benchmark"), "item_id", "text"), "item_id")


_BEST = "SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {0}) WHERE rank <= {1}".format


@query("fts_bm25_topk", f"WITH {_bm25_sql()} {_BEST('s', 10)}")
def fts_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.best(_scores(spark, sf), "item_id", "doc_id", 10)


@query("fts_bm25_scoped", f"WITH {_bm25_sql()}, scoped AS (SELECT s.* FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) {_BEST('scoped', 5)}")
def fts_bm25_scoped(spark: SparkSession, sf: str) -> DataFrame:
    scope = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return search.best(_scores(spark, sf).join(scope, "doc_id", "left_semi"), "item_id", "doc_id", 5)


@query("fts_bm25_doc_max", f"WITH {_bm25_sql()} SELECT source, max(score) AS best, count(DISTINCT doc_id) AS n_docs FROM s JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source")
def fts_bm25_doc_max(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return _scores(spark, sf).groupBy("doc_id").agg(F.max("score").alias("score")).join(docs, "doc_id").groupBy("source").agg(F.max("score").alias("best"), F.count("*").alias("n_docs"))


_WEIGHTED = f"""{_query_terms_sql()},
        c AS (SELECT doc_id, split_part(text, chr(10), 1) AS heading, text AS body FROM documents),
        d AS (SELECT doc_id, {_TOKENS('heading')} AS h, {_TOKENS('body')} AS t FROM c),
        size AS (SELECT doc_id, len(h) + len(t) AS length FROM d),
        total AS (SELECT count(*) AS n_docs, avg(length) AS average_length FROM size),
        tf AS (SELECT doc_id, term, sum(weight) AS tf FROM (SELECT doc_id, unnest(h) AS term, 3.0 AS weight FROM d UNION ALL SELECT doc_id, unnest(t), 1.0 FROM d) GROUP BY doc_id, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT item_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average_length))), 6) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)"""


@query("fts_bm25_weighted", f"WITH {_WEIGHTED} {_BEST('s', 10)}")
def fts_bm25_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """The heading (a document's first line) counts three times as much as the body."""
    docs = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading"), F.col("text").alias("body"))
    terms = search.query_terms(table(spark, sf, "benchmark"), "item_id", "text")
    return search.best(search.bm25(docs, "doc_id", {"heading": 3.0, "body": 1.0}, terms, "item_id"), "item_id", "doc_id", 10)


@query("fts_prefix_match", f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS('text')}, lambda t: starts_with(t, 'inter'))) > 0")
def fts_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.matching_prefix(table(spark, sf, "documents"), "doc_id", "text", F.lit("inter"))


@query("fts_phrase_match", rf"SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string({_TOKENS('text')}, ' ') || ' ', ' of the ')")
def fts_phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    """Two words one after the other, from the postings of these two."""
    phrases = spark.createDataFrame([("of the", ["of", "the"])], "phrase string, words array<string>")
    postings = positions.positional(table(spark, sf, "documents"), "doc_id", "text", F.broadcast(phrases.select(F.explode("words").alias("term"))))  # two words
    return positions.phrase_matches(postings, "doc_id", phrases).select("doc_id")


_PLACES = f"tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS('text')} AS t FROM documents))"


@query("fts_positions", f"WITH {_PLACES} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, CAST(sum(pos) AS BIGINT) AS total, CAST(max(pos) AS INTEGER) AS last FROM tok GROUP BY term")
def fts_positions(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored postings know of each term: documents, occurrences and places."""
    path = working_folder(spark, "positions")
    positions.save(positions.positional(table(spark, sf, "documents"), "doc_id", "text"), path)
    p = positions.stored(spark, path)
    total, last = positions.place_sum(F.col("gaps")), positions.last_place(F.col("gaps"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"), F.sum(total).alias("total"), F.max(last).alias("last"))


@query("fts_prefix_terms", f"WITH {_PLACES} SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE starts_with(term, 'inte') OR starts_with(term, 'ß') GROUP BY term")
def fts_prefix_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that begin so: a range of the sorted dictionary, to which a scan of the stored postings skips."""
    path = working_folder(spark, "positions")
    positions.save(positions.positional(table(spark, sf, "documents"), "doc_id", "text"), path)
    p = positions.stored(spark, path)
    return positions.dictionary(positions.prefix_matches(p, "inte").unionByName(positions.prefix_matches(p, "ß")))


@query("fts_and_prefix", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS('text')} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'that') AND len(list_filter(t, lambda x: starts_with(x, 'rea'))) > 0")
def fts_and_prefix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.where(search.all_terms_last_prefix(F.col("t"), ["the", "that", "rea"])).select("doc_id")


def _prefix_case(term: str) -> str:
    whens = " ".join(f"WHEN {term} LIKE '%{e}' THEN CASE WHEN length({term}) - {len(e)} >= {T.LEAST_STEM} THEN left({term}, length({term}) - {len(e)}) END" for e in T.ENDINGS)
    return f"CASE {whens} END"


def _prefix_sql() -> str:
    return f"SELECT term, {_prefix_case('term')} AS prefix FROM (SELECT DISTINCT unnest({_TOKENS('text')}) AS term FROM benchmark)"


@query("fts_morph_prefix", _prefix_sql())
def fts_morph_prefix(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.morphological_prefix(F.col("term")).alias("prefix"))


_HITS = f"""WITH {_bm25_sql()}, top AS ({_BEST('s', 10)}), h AS (SELECT item_id, doc_id, rank, lower(text) AS low, ts FROM top JOIN documents USING (doc_id) JOIN (SELECT item_id, list(term) AS ts FROM q GROUP BY item_id) USING (item_id))"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each question with their text and the question's terms."""
    terms = table(spark, sf, "benchmark").select("item_id", T.query_tokens(F.col("text")).alias("terms"))
    return search.best(_scores(spark, sf), "item_id", "doc_id", 10).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(terms, "item_id")


@query("fts_keyword_overlap", f"{_HITS} SELECT item_id, max(len(list_filter(ts, lambda t: contains(low, t)))) AS overlap FROM h WHERE rank <= 3 GROUP BY item_id")
def fts_keyword_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The most distinct query words that one of the three best documents contains."""
    n = F.size(F.filter("terms", lambda t: F.contains(F.lower("text"), t))).cast("long")
    return _hits(spark, sf).where("rank <= 3").groupBy("item_id").agg(F.max(n).alias("overlap"))


@query("flt_all_keywords", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'ing')")
def flt_all_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    for word in ("the", "and", "ing"):
        docs = docs.where(F.contains(F.lower("text"), F.lit(word)))
    return docs.select("doc_id")


@query("flt_like_escaped", r"SELECT doc_id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), 'a_b')")
def flt_like_escaped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("100%")) | F.contains(F.lower("text"), F.lit("a_b"))).select("doc_id")


@query("flt_covers_enough", f"{_HITS} SELECT item_id, doc_id FROM h WHERE len(list_filter(ts, lambda t: contains(low, left(t, 5)))) >= ceil(len(ts) / 2)")
def flt_covers_enough(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).where(T.covers_enough(F.col("text"), F.col("terms"))).select("item_id", "doc_id")
