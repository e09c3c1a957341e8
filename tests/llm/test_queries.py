"""The registered queries: their columns and rows on a small table, and those with SQL against DuckDB."""

from collections import Counter

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from tessera.llm import queries  # noqa: E402
from tests.conftest import DATA  # noqa: E402
from tests.llm.test_operators import SCHEMA, rows  # noqa: E402

COLUMNS = {
    "op1_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    ids = Counter(r.doc_id for r in df.select("doc_id").collect())
    want = Counter(r[0] for r in rows())
    assert set(ids) == set(want) if name == "op2_packing" else ids == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(map(tuple, df.select(want.columns).collect())) == Counter(want.fetchall())


def test_topk_columns(spark):
    df = queries.QUERIES["op7_topk"](spark, DATA)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
