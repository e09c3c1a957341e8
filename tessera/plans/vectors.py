"""Vector and fusion queries over ``embeddings`` (64 components) and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import ranking, vectors
from tessera.operators.search import best
from tessera.plans.search import _BEST, _bm25_sql, _scores
from tessera.registry import query
from tessera.sources.shared import written
from tessera.sources.tables import table

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_SQL = f"""
    p AS (SELECT vec_id, label, CASE WHEN n > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS p
          FROM (SELECT vec_id, label, embedding, {_NORM} AS n FROM embeddings)),
    s AS (SELECT vec_id, label, p, CASE WHEN top > 0 THEN top / 127 ELSE 1.0 END AS scale FROM (SELECT *, list_max(list_transform(p, lambda x: abs(x))) AS top FROM p)),
    v AS (SELECT vec_id, label, p, scale, list_transform(p, lambda x: CAST(greatest(-127, least(127, round(x / scale))) AS BIGINT)) AS q FROM s),
    near AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, list_sum(list_transform(list_zip(a.p, b.q), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS distance,
                    round(list_sum(list_transform(list_zip(a.p, b.q), lambda z: z[1] * z[2])) * b.scale, 6) AS score
             FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id DESC) AS place FROM near) WHERE place <= 300)"""


@query("vec_prepare", f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) / {_NORM}))), 6) AS l1, round(CAST(embedding[1] AS DOUBLE) / {_NORM}, 6) AS first FROM embeddings")
def vec_prepare(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "embeddings").select("vec_id", V.prepared(F.col("embedding"), 64).alias("p"))
    return p.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"), F.round(F.element_at("p", 1), 6).alias("first"))


@query("vec_quantize", f"WITH {_SQL} SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS total, array_to_string(q[1:4], ',') AS head FROM v")
def vec_quantize(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors.indexed(table(spark, sf, "embeddings"), "vec_id", "embedding")
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return q.select("vec_id", F.round("scale", 9).alias("scale"), total.alias("total"), F.array_join(F.transform(F.slice("q", 1, 4), lambda x: x.cast("string")), ",").alias("head"))


@query("vec_signature", f"WITH {_SQL} SELECT vec_id, CAST(len(list_filter(q, lambda x: x > 0)) AS INTEGER) AS n_positive FROM v")
def vec_signature(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors.indexed(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return q.select("vec_id", F.bit_count("sig").alias("n_positive"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    return vectors.queries(table(spark, sf, "embeddings").where("vec_id % 100 = 0"), "vec_id", "embedding")


def _index(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return vectors.indexed(table(spark, sf, "embeddings").where(where), "vec_id", "embedding", 64, "label")


def _short(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return vectors.shortlist(_index(spark, sf, where), "vec_id", _asked(spark, sf), label="label")


@query("vec_hamming_shortlist", f"WITH {_SQL} SELECT query_id, vec_id, CAST(distance AS INTEGER) AS distance FROM short")
def vec_hamming_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return _short(spark, sf).select("query_id", "vec_id", "distance")


@query("vec_rescore_topk", f"WITH {_SQL} SELECT query_id, vec_id, score FROM short QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50")
def vec_rescore_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.rescored(_short(spark, sf), "vec_id").select("query_id", "vec_id", "score")


@query("vec_best_similarity", f"WITH {_SQL} SELECT query_id, max(score) AS best FROM near GROUP BY query_id")
def vec_best_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.best_by_group(_index(spark, sf), "vec_id", _asked(spark, sf)).select("query_id", "best")


@query("vec_scoped", f"WITH {_SQL} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id DESC) AS p FROM near WHERE label IN (1, 2, 3)) WHERE p <= 300 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def vec_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """The scope narrows before the shortlist is cut."""
    return vectors.rescored(_short(spark, sf, "label IN (1, 2, 3)"), "vec_id", 10).select("query_id", "vec_id", "score")


@query("vec_best_part_per_group", f"WITH {_SQL} SELECT query_id, label, max(score) AS best FROM near WHERE score >= 0.1 GROUP BY ALL")
def vec_best_part_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.best_by_group(_index(spark, sf), "vec_id", _asked(spark, sf), "label", 0.1).select("query_id", F.col("label").cast("int").alias("label"), "best")


_LISTS = f"""WITH {_bm25_sql()},
    a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s),
    b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY length, doc_id) AS rank FROM s JOIN size USING (doc_id)),
    f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY ALL)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.search import lengths

    s = _scores(spark, sf)
    short = s.join(lengths(table(spark, sf, "documents"), "doc_id", "text"), "doc_id").withColumn("score", -F.col("length"))
    return ranking.fused([ranking.ranked(s, "item_id", "doc_id", k=50), ranking.ranked(short, "item_id", "doc_id", k=50)], "item_id", "doc_id")


@query("rank_rrf", f"{_LISTS} SELECT item_id, doc_id, score FROM f")
def rank_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf)


#: The vector list of a question, and the similarity from which unasked material counts.
NEAR, GATE = 50, 0.2


def vector_lists(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, doc_id, score: the documents nearest to each question by their letter-trigram embeddings."""
    docs = vectors.trigram_embedded(table(spark, sf, "documents"), "doc_id", "text")
    asked = vectors.trigram_embedded(table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("item_id"), "text"), "item_id", "text")
    near = vectors.nearest(vectors.indexed(docs, "doc_id", "embedding", 512), "doc_id", vectors.queries(asked, "item_id", "embedding", 512), NEAR)
    return near.select((-1 - F.col("query_id")).alias("item_id"), "doc_id", "score")


@query("vec_trigram_nearest")
def vec_trigram_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return vector_lists(spark, sf)


@query("rank_hybrid")
def rank_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and vectors fused, twelve of each question."""
    keyword = ranking.ranked(_scores(spark, sf), "item_id", "doc_id", k=50)
    near = ranking.ranked(vector_lists(spark, sf), "item_id", "doc_id", k=NEAR)
    return best(ranking.fused([keyword, near], "item_id", "doc_id"), "item_id", "doc_id", 12).select("item_id", "doc_id", "score", "rank")


@query("rank_hybrid_gated")
def rank_hybrid_gated(spark: SparkSession, sf: str) -> DataFrame:
    """The fused list of each question, of which only similar documents stay."""
    keyword, near = ranking.ranked(_scores(spark, sf), "item_id", "doc_id", k=50), vector_lists(spark, sf)
    out = ranking.hybrid(keyword, "item_id", "doc_id", near, GATE, None)
    return best(out, "item_id", "doc_id", 12).select("item_id", "doc_id", "score", "rank")


@query(
    "rank_keyword_gated",
    f"""WITH {_bm25_sql()}, n AS (SELECT item_id, count(*) AS words FROM q GROUP BY item_id),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s),
    f AS (SELECT item_id, doc_id, round(1.0 / (60 + place), 9) AS score FROM r JOIN n USING (item_id) WHERE place <= 50 AND words >= 2) {_BEST('f', 4)}""",
)
def rank_keyword_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Without vectors a question needs two words or more, and its four best documents stay."""
    words = table(spark, sf, "benchmark").select("item_id", F.size(T.query_tokens(F.col("text"))).alias("words"))
    out = ranking.hybrid(ranking.ranked(_scores(spark, sf), "item_id", "doc_id", k=50), "item_id", "doc_id", None, GATE, words)
    return best(out, "item_id", "doc_id", 4).select("item_id", "doc_id", "score", "rank")


@query("rank_relative_floor", f"WITH {_bm25_sql()} SELECT item_id, doc_id, score FROM s QUALIFY score >= 0.4 * max(score) OVER (PARTITION BY item_id)")
def rank_relative_floor(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.above_floor(_scores(spark, sf), "item_id")


@query("rank_similarity_gate", f"WITH {_SQL} SELECT query_id, vec_id, CAST(distance AS INTEGER) AS distance FROM short WHERE score >= 0.3")
def rank_similarity_gate(spark: SparkSession, sf: str) -> DataFrame:
    short = written(_short(spark, sf), "shortlist")  # two parts of the plan read it
    similar = short.where("score >= 0.3")
    return ranking.gated(short, similar, ["query_id", "vec_id"]).select("query_id", "vec_id", "distance")


@query("rank_coverage_per_source", f"WITH {_bm25_sql()} SELECT item_id, source, doc_id, score FROM s JOIN (SELECT doc_id, source FROM documents) USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) <= 2")
def rank_coverage_per_source(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _scores(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    w = Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 2").select("item_id", "source", "doc_id", "score")
