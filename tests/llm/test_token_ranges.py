"""Token files of tables in which one id, or none, stands on most rows."""

import pytest

pytest.importorskip("public_tokenizers")
from tessera.llm import token_files  # noqa: E402
from tessera.llm.queries import tokenizer  # noqa: E402

NAME = "word_bpe_49k.json"


@pytest.mark.parametrize("hot", [None, 7])
def test_a_hot_id_is_dealt_over_ranges(spark, tmp_path, hot):
    table = [(hot, f"text number {i} of many") for i in range(800)] + [(i, f"other {i}") for i in range(100, 200)]
    path = f"file://{tmp_path}/files"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges this small become one task
    try:
        token_files.write(spark.createDataFrame(table, "doc_id long, text string").repartition(4), path, tokenizer(NAME))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_files.read(spark, path, tokenizer(NAME)).collect()
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert len(rows) == 900 and ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert sorted(r.start for r in rows)[1:] == [r.start + r.n_tokens for r in sorted(rows, key=lambda r: r.start)][:-1]
    shards = spark.read.parquet(path).where("doc_to IS NULL" if hot is None else f"doc_from <= {hot} AND doc_to >= {hot}").select("shard").distinct().count()
    assert shards > 1


def test_lookup_reads_only_blocks_with_room(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    path = f"file://{tmp_path}/files"
    token_files.write(spark.createDataFrame([(i, f"text number {i}") for i in range(0, 400, 2)], "doc_id long, text string"), path, tokenizer(NAME))
    found = token_files.lookup(spark, path, tokenizer(NAME), [10, 11, 390])
    assert sorted(r.doc_id for r in found.collect()) == [10, 390]
    assert token_files.lookup(spark, path, tokenizer(NAME), []).count() == 0
