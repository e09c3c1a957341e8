"""Postings with positions, and searches that are answered from them: words, beginnings of words, phrases, and their OR.

A posting is (term, doc, n, gaps): the places of a term in a document, each as the distance to the one before. Written by
``save`` the postings are ranged and sorted by term, so a reader of a few terms or of one beginning skips all other row
groups. Phrases merge positions: the places of every word, moved back by its place in the phrase, must meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions import text as T
from tessera.operators import terms
from tessera.operators.search import corpus_statistics, idf, lengths, term_weight
from tessera.sources.shared import written


def positional(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """term, key, n, gaps. ``only`` (term, each once) keeps the postings of these terms; a null text has none.

    Where each key has one row, as a key should, terms are grouped inside the rows. A few terms, and rows that share a
    key, are grouped by a shuffle.
    """
    if only is None and docs.groupBy(key).count().where("count > 1").isEmpty():
        return terms.by_text(docs, [key], text)
    each = docs.select(key, F.posexplode(T.tokens(F.col(text))).alias("pos", "term"))
    if only is not None:
        each = each.join(only.select("term"), "term", "left_semi")
    listed = each.groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("p"))
    gaps = F.transform("p", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("p", i - 1)))
    return listed.select("term", key, F.size("p").cast("long").alias("n"), gaps.alias("gaps"))


@arrow_udf(ArrayType(IntegerType()))
def _summed(gaps: pa.Array) -> pa.Array:
    """Running sums inside each list, all lists of a batch at once."""
    starts = gaps.offsets.to_numpy().astype(np.int64)
    flat = gaps.values.to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat)])
    sizes = np.diff(starts)
    out = total[starts[0] + 1 : starts[-1] + 1] - np.repeat(total[starts[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(out.astype(np.int32)))


def places(postings: DataFrame) -> DataFrame:
    """The postings with their positions in place of the gaps."""
    return postings.withColumn("places", _summed("gaps")).drop("gaps")


def place_sum(gaps: Column) -> Column:
    """The sum of a posting's places."""
    zero = F.lit(0).cast("long")
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), (s["sum"] + s["at"] + x).alias("sum"))
    return F.aggregate(gaps, F.struct(zero.alias("at"), zero.alias("sum")), step, lambda s: s["sum"])


def last_place(gaps: Column) -> Column:
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def save(postings: DataFrame, path: str, parts: int | None = None) -> None:
    """Ranged and sorted by term; ``parts`` files (the session's shuffle partitions if not said)."""
    postings = written(postings, "unsorted")  # the ranges are sampled from them before they are sorted
    ranged = postings.repartitionByRange(parts, "term") if parts else postings.repartitionByRange("term")
    ranged.sortWithinPartitions("term").write.parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dictionary(postings: DataFrame) -> DataFrame:
    """term, df."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _after(prefix: str) -> str | None:
    """The least string above all that begin so; None if there is none."""
    while prefix:
        if ord(prefix[-1]) < 0x10FFFF:
            code = ord(prefix[-1]) + 1
            return prefix[:-1] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)
        prefix = prefix[:-1]
    return None


def prefix_matches(postings: DataFrame, prefix: str) -> DataFrame:
    """The postings of all terms that begin so: a range of the sorted terms, which a scan of saved postings skips to."""
    end = _after(prefix)
    found = F.col("term") >= prefix
    return postings.where(found & (F.col("term") < end) if end else found)


def phrase_matches(postings: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """phrase, key, tf: how often the words of ``phrases`` (phrase, words, each phrase once) stand one after the other.

    Every word of every phrase meets its postings over the term; a phrase's lists for one document come together and
    are intersected, so what is gathered is as long as the phrase, and each list as the document.
    """
    words = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    # the places are worked out for what was met, not for all postings
    met = places(words.join(postings.select("term", key, "gaps"), "term")).select("phrase", "size", "at", key, F.transform("places", lambda p: p - F.col("at")).alias("starts"))
    lists = met.groupBy("phrase", key, "size").agg(F.collect_list("starts").alias("l")).where(F.size("l") == F.col("size"))
    common = F.aggregate(F.slice("l", 2, 1 << 20), F.get("l", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select("phrase", key, F.size(common).cast("long").alias("tf")).where("tf > 0")


def clause_matches(postings: DataFrame, key: str, clauses: DataFrame) -> DataFrame:
    """kind, term, key, tf: where each distinct clause occurs and how often.

    ``clauses``: kind (exact, prefix, or any other for words one after the other) and term. A clause that several
    questions share is looked up once.
    """
    c = clauses.select("kind", "term").distinct().withColumn("words", F.split("term", " "))
    single = c.where((F.col("kind") == "exact") | ((F.col("kind") != "prefix") & (F.size("words") == 1)))
    exact = single.join(postings.select("term", key, F.col("n").alias("tf")), "term").select("kind", "term", key, "tf")
    # beginnings meet the dictionary over all beginnings of its words that are as long as one that is asked for
    asked = c.where("kind = 'prefix'").select(F.col("term").alias("prefix"))
    sizes = F.array_distinct(F.col("s"))
    known = dictionary(postings).select("term").crossJoin(F.broadcast(asked.agg(F.collect_set(F.length("prefix")).alias("s"))))  # one row, of lengths
    known = known.select("term", F.explode(F.filter(sizes, lambda n: n <= F.length("term"))).alias("size")).select("term", F.substring("term", F.lit(1), F.col("size")).alias("prefix"))
    family = written(known.join(asked, "prefix"), "family")  # as many terms as the beginnings have: small beside the postings
    begun = family.join(postings.select("term", key, "n"), "term").groupBy(F.lit("prefix").alias("kind"), F.col("prefix").alias("term"), key).agg(F.sum("n").alias("tf"))
    several = c.where((~F.col("kind").isin("exact", "prefix")) & (F.size("words") > 1))
    phrases = phrase_matches(postings, key, several.select(F.col("term").alias("phrase"), "words").distinct())
    spoken = several.select("kind", "term").join(phrases.withColumnRenamed("phrase", "term"), "term").select("kind", "term", key, "tf")
    return exact.unionByName(begun).unionByName(spoken)


def clause_scores(docs: DataFrame, key: str, text: str, postings: DataFrame, clauses: DataFrame, question: str) -> DataFrame:
    """question, key, score: the OR of each question's clauses; every clause weighs by BM25 on its own documents.

    A document that has the asked word itself matches the word and its beginning, so it stands above one with a
    relative of the word only.
    """
    sizes = written(lengths(docs, key, text), "lengths")
    total = corpus_statistics(sizes)
    found = written(clause_matches(postings, key, clauses), "clause-matches")  # counted and weighed
    df = found.groupBy("kind", "term").agg(F.count("*").alias("df"))
    weighted = found.join(df, ["kind", "term"]).join(sizes, key).crossJoin(F.broadcast(total))  # total is one row
    weight: Column = idf(F.col("n_docs"), F.col("df")) * term_weight(F.col("tf"), F.col("length"), F.col("average_length"))
    weighted = weighted.select("kind", "term", key, weight.alias("w"))
    return clauses.select(question, "kind", "term").join(weighted, ["kind", "term"]).groupBy(question, key).agg(F.round(F.sum("w"), 6).alias("score"))


def ranked(scores: DataFrame, question: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(question).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
