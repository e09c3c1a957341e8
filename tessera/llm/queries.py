"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import token_files

    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pieces

    return pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import learn, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_packing, op3_exact_dedup, op4_secrets, op5_mixing, op6_simhash, op7_topk, op8_lm, op9_substrings, op10_language, op11_toxicity, op12_spelling, op13_divergence)}

SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                     1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
                     1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 5)) // (l.total + 5 * l.v) AS q
              FROM g JOIN kept ON g.lang = kept.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT y.lang, y.source, z.source AS other, sum(abs(y.p - z.p)) AS value FROM f y JOIN f z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY ALL) x
                  ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM f WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 50""",
}
