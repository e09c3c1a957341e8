"""Indexing that is delivered twice, bumped and retried; admission of requests against a plain fold."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessera.streaming import indexer, limits

SCHEMA = "doc_id long, text string"


def postings(spark, folder):
    return {(r.doc_id, r.term): r.tf for r in indexer.current(spark, folder).collect()}


def put(spark, folder, name, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_a_stream_indexes_each_document_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    run = lambda: indexer.run(spark, f"{folder}/in/*", f"{folder}/index", f"{folder}/checkpoint", SCHEMA)
    put(spark, folder, 1, (1, "a b a"), (2, None))
    run()
    put(spark, folder, 2, (1, "changed"), (3, "c"))
    run()
    run()
    assert postings(spark, f"{folder}/index") == {(1, "a"): 2.0, (1, "b"): 1.0, (3, "c"): 1.0}
    state = indexer.current(spark, f"{folder}/index", "state")
    assert sorted((r.doc_id, r.status, r.attempts, r.chunk_count) for r in state.collect()) == [(1, "indexed", 0, 1), (2, "failed", 1, 0), (3, "indexed", 0, 1)]


def test_a_new_version_through_a_new_checkpoint(spark, tmp_path):
    """The numbers of a new checkpoint start at 0 again; the new version's rows count all the same."""
    folder = f"file://{tmp_path}"
    for i in range(3):
        put(spark, folder, i, (i, f"old words {i}"))
    indexer.run(spark, f"{folder}/in/*", f"{folder}/index", f"{folder}/first", SCHEMA, per_trigger=1, version=1)
    assert indexer.manifest(spark, f"{folder}/index").count() == 3
    put(spark, folder, "new", (0, "zero"), (1, "one"), (2, "two"))
    newer = f"{folder}/in/new"
    indexer.run(spark, newer, f"{folder}/index", f"{folder}/second", SCHEMA, version=2)
    assert postings(spark, f"{folder}/index") == {(0, "zero"): 1.0, (1, "one"): 1.0, (2, "two"): 1.0}
    # an older version changes nothing any more
    indexer.run(spark, f"{folder}/in/*", f"{folder}/index", f"{folder}/third", SCHEMA, version=1)
    assert postings(spark, f"{folder}/index") == {(0, "zero"): 1.0, (1, "one"): 1.0, (2, "two"): 1.0}
    assert {r.version for r in indexer.current(spark, f"{folder}/index", "state").collect()} == {2}


def test_a_batch_counts_once_and_wholly(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    indexer.create(spark, folder)
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    indexer.index_batch(batch((1, "a a"), (1, "a a")), 0, folder, "x")
    indexer.index_batch(batch((1, "a a"), (5, "later")), 0, folder, "x")  # the same batch again
    assert postings(spark, folder) == {(1, "a"): 2.0}
    # what an attempt has left without a row in the manifest is never read
    spark.createDataFrame([(1, "ghost", 9.0)], indexer.TABLES["postings"]).write.parquet(f"{folder}/postings/epoch=2/attempt=dead")
    indexer.index_batch(batch((2, "b")), 1, folder, "x")
    assert postings(spark, folder) == {(1, "a"): 2.0, (2, "b"): 1.0}


def test_all_tables_change_together(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    indexer.create(spark, folder)
    text = 'Section 1 Terms\nThe "Tenant" means who rents.\nContents\nRent ..... 3\nDuty ..... 4\nSection 2 Rent\nThe (the "Rent") is due.'
    batch = lambda t: spark.createDataFrame([(1, t)], SCHEMA)
    indexer.index_batch(batch(text), 0, folder, "x", 1)
    chunks = {r.ord: r for r in indexer.current(spark, folder, "chunks").collect()}
    terms = {r.term: (r.byte_start, r.ord) for r in indexer.current(spark, folder, "terms").collect()}
    assert set(terms) == {"Tenant", "Rent"}
    for term, (at, n) in terms.items():
        assert text.encode()[at:].startswith(b'"' + term.encode()) and chunks[n].byte_start <= at < chunks[n].byte_end
    searched = {(r.ord, r.term) for r in indexer.current(spark, folder, "chunk_postings").collect()}
    hidden = {n for n, c in chunks.items() if c.is_toc}
    assert {n for n, _ in searched} == set(chunks) - hidden
    assert any(t == "section" for _, t in searched), "the heading is searched with its chunk"
    indexer.index_batch(batch("plain"), 1, folder, "x", 2)
    assert [r.text for r in indexer.current(spark, folder, "chunks").collect()] == ["plain"]
    assert indexer.current(spark, folder, "terms").count() == 0


def test_failed_documents_are_tried_again_a_bounded_number_of_times(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    indexer.create(spark, folder)
    docs = lambda text: spark.createDataFrame([(1, text), (2, "fine")], SCHEMA)
    indexer.index_batch(docs(None), 0, folder, "x")
    assert indexer.retry(spark, folder, docs(None)) == 1
    assert indexer.retry(spark, folder, docs("found")) == 1
    assert postings(spark, folder) == {(1, "found"): 1.0, (2, "fine"): 1.0}
    assert indexer.retry(spark, folder, docs("again")) == 0
    indexer.index_batch(spark.createDataFrame([(3, None)], SCHEMA), 1, folder, "x")
    tries = [indexer.retry(spark, folder, spark.createDataFrame([(3, None)], SCHEMA)) for _ in range(4)]
    assert tries == [1, 1, 0, 0]


# --- admission -------------------------------------------------------------------------------------------------------


def fold(requests, lim):
    """Second by second bookkeeping of one key, in fractions, without the machine's shortcuts."""
    out, tokens, last, busy, line = {}, float(lim.rate), None, [], []

    def settle(now):
        while line:
            came, who, needs = line[0]
            free = min(busy)
            if min(free, came + lim.patience) > now:
                return
            line.pop(0)
            if free <= came + lim.patience:
                busy.remove(free)
                busy.append(free + needs)
                out[who] = (limits.ADMITTED, free - came)
            else:
                out[who] = (limits.LATE, lim.patience)

    for at, who, needs in sorted(requests):
        settle(at)
        busy[:] = [b for b in busy if b > at or line]
        tokens = min(float(lim.rate), tokens + (0 if last is None else (at - last) / 1e6 * lim.rate))
        last = at
        if tokens < 1 - 1e-9:
            out[who] = (limits.RATE, 0)
            continue
        tokens -= 1
        if len(busy) < lim.streams:
            busy.append(at + needs)
            out[who] = (limits.ADMITTED, 0)
        elif len(line) >= lim.queue:
            out[who] = (limits.FULL, 0)
        else:
            line.append((at, who, needs))
    settle(limits.NEVER)
    return out


LIMITS = limits.Limits(rate=2, streams=2, queue=2, patience=4_000_000)


def requests():
    rng = random.Random(5)
    at, out = 1_700_000_000_000_000, []
    for i in range(600):
        at += rng.choice([0, 100_000, 250_000, 1_000_000, 3_000_000])
        out.append((rng.randrange(3), i, at, rng.choice([500_000, 2_000_000, 6_000_000])))
    return out


def wanted():
    return {(k, i): d for k in range(3) for i, d in fold([(at, i, needs) for key, i, at, needs in requests() if key == k], LIMITS).items()}


def test_decisions_on_a_table(spark):
    df = spark.createDataFrame(requests(), "key long, id long, at long, needs long").repartition(5)
    got = {(r.key, r.id): (r.outcome, r.waited) for r in limits.decided(df, LIMITS).collect()}
    want = wanted()
    assert got == want
    assert {x[0] for x in want.values()} == {limits.ADMITTED, limits.RATE, limits.FULL, limits.LATE}


@pytest.mark.parametrize("batches", [1, 4])
def test_decisions_on_a_stream_in_any_batches(spark, tmp_path, batches):
    rows = requests()
    size = -(-len(rows) // batches)
    for b in range(batches):
        part = rows[b * size : (b + 1) * size]
        random.Random(b).shuffle(part)
        limits_rows(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    limits_rows(spark, [(-1, -1, rows[-1][2] + 10**12, 0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {(r.key, r.id): (r.outcome, r.waited) for r in limits.run(spark, f"{tmp_path}/in", str(tmp_path), LIMITS).collect() if r.key >= 0}
    assert got == wanted()


def limits_rows(spark, rows):
    when = lambda us: datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
    return spark.createDataFrame([(k, i, when(at), needs) for k, i, at, needs in rows], "key long, id long, ts timestamp, needs long").withColumn("ts", F.col("ts"))
