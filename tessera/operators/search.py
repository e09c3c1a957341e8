"""Full-text search over derived postings: BM25, prefix and phrase clauses, scopes.

Statistics (documents, average length, document frequency) are always those of the whole corpus, also when a scope
or a filter narrows the result. The corpus is read and cut into tokens once; what is written of it is one row for each
match with a query term and one for each document without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Distinct query terms up to which they travel to the tasks; more are joined by a shuffle.
SENT_TERMS = 100_000


def postings(docs: DataFrame, key: str, text: str, weight: float = 1.0) -> DataFrame:
    """key, term, tf: one row per document and term."""
    each = docs.select(key, F.explode(T.tokens(F.col(text))).alias("term"))
    return each.groupBy(key, "term").agg((F.count("*") * F.lit(weight)).alias("tf"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(T.tokens(F.col(text))).cast("long").alias("length"))


def corpus_statistics(lengths_of: DataFrame) -> DataFrame:
    """One row: documents, average length."""
    return lengths_of.agg(F.count("*").alias("n_docs"), F.avg("length").alias("average_length"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def query_terms(questions: DataFrame, key: str, text: str) -> DataFrame:
    return questions.select(key, F.explode(T.query_tokens(F.col(text))).alias("term"))


def matches(docs: DataFrame, key: str, columns: dict[str, float], terms: DataFrame) -> DataFrame:
    """key, length, pos, term, weight, written: each place of a wanted term, and the first place of each document whatever its term.

    ``columns`` are the searched columns with their weights. ``hit`` tells the two kinds of rows apart.
    """

    def weighted(column: str, weight: float) -> Column:
        found = F.coalesce(T.tokens(F.col(column)), F.array().cast("array<string>"))
        return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("weight")))

    each = docs.select(key, F.concat(*[weighted(c, w) for c, w in columns.items()]).alias("t"))
    each = each.select(key, F.size("t").cast("long").alias("length"), F.posexplode_outer("t").alias("pos", "t"))
    wanted = terms.select("term").distinct().withColumn("hit", F.lit(True))
    if wanted.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        wanted = F.broadcast(wanted)
    each = each.select(key, "length", "pos", F.col("t.term").alias("term"), F.col("t.weight").alias("weight")).join(wanted, "term", "left")
    return written(each.where("hit OR pos = 0 OR pos IS NULL"), "matches")


def bm25(docs: DataFrame, doc_key: str, doc_text: str | dict[str, float], terms: DataFrame, query_key: str, within: str | None = None) -> DataFrame:
    """query_key, doc_key, score of all documents that have a term of the query.

    ``doc_text`` is a column, or columns with weights: a term's frequency is then the weighted sum over the columns,
    a document's length that of all of them. With ``within`` (a column of both sides) a query only meets the documents
    that share its value; statistics stay those of all documents. Terms of up to SENT_TERMS rows travel to the matches,
    which are dealt by document: a score is summed where its document is, and no pair of a query and a document is shuffled.
    """
    terms = written(terms, "terms")  # the matches, their join and the count read them
    few = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    sent = F.broadcast if few else lambda rows: rows
    found = matches(docs, doc_key, {doc_text: 1.0} if isinstance(doc_text, str) else doc_text, terms)
    total = found.where("pos = 0 OR pos IS NULL").agg(F.count("*").alias("n_docs"), F.avg("length").alias("average_length"))
    hits = found.where("hit")
    hits = (hits.repartition(doc_key) if few else hits).groupBy(doc_key, "term").agg(F.sum("weight").alias("tf"), F.first("length").alias("length"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighted = hits.join(sent(df), "term").crossJoin(F.broadcast(total))  # total is one row
    weighted = weighted.select(doc_key, "term", (idf(F.col("n_docs"), F.col("df")) * term_weight(F.col("tf"), F.col("length"), F.col("average_length"))).alias("w"))
    if within:
        weighted = weighted.join(docs.select(doc_key, within), doc_key)
    return weighted.join(sent(terms), ["term", within] if within else "term").groupBy(query_key, doc_key).agg(F.round(F.sum("w"), 6).alias("score"))


def best(scored: DataFrame, query_key: str, doc_key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ties to the smaller key; the rank starts at 1."""
    w = Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(doc_key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matching_prefix(docs: DataFrame, key: str, text: str, prefix: Column) -> DataFrame:
    """Documents with a token that begins so."""
    return docs.where(F.exists(T.tokens(F.col(text)), lambda t: t.startswith(prefix))).select(key)


def phrase(tokens: Column, words: list[str]) -> Column:
    """The words occur one after the other."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(padded, F.lit(f" {' '.join(words)} "))


def all_terms_last_prefix(tokens: Column, words: list[str]) -> Column:
    """All words occur, the last one as a beginning."""
    held = [F.array_contains(tokens, w) for w in words[:-1]] + [F.exists(tokens, lambda t: t.startswith(words[-1]))]
    out = held[0]
    for x in held[1:]:
        out = out & x
    return out
