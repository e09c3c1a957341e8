"""Incremental indexing by Structured Streaming: new files become chunks, postings and terms once, whatever is re-delivered.

An index is a folder of tables (``TABLES``) and a manifest. A batch writes its frames into partitions of their own
(``epoch=``, ``attempt=``) and then one row into the manifest, which alone makes them visible: chunks, postings, terms and
state of a document change together, and what a failed attempt has left is never read. Epochs count on over all runs,
so a document's newest epoch is its newest state, whichever run, checkpoint or version wrote it. A batch that is delivered
again, by number and run, finds itself in the manifest and does nothing. One stream at a time writes to an index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import structure
from tessera.operators import terms as terms_of
from tessera.sources.shared import written

VERSION = 1
#: Attempts at a document that cannot be read, in all.
ATTEMPTS = 3

MANIFEST = "epoch long, attempt string, run string, batch long, version int"
TABLES = {
    "state": "doc_id long, version int, status string, error string, attempts int, chunk_count long",
    "postings": "doc_id long, term string, tf double",
    "chunks": f"doc_id long, {structure.CHUNK}",
    "chunk_postings": "doc_id long, ord int, term string, tf double",
    "terms": "doc_id long, term string, byte_start long, ord int",
}


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables where there are none."""
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{folder}/manifest")
    for name, ddl in TABLES.items():
        spark.createDataFrame([], f"{ddl}, epoch long, attempt string").write.mode("append").partitionBy("epoch", "attempt").parquet(f"{folder}/{name}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per batch that counts."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of all batches in the manifest, of whatever age."""
    rows = spark.read.schema(f"{TABLES[name]}, epoch long, attempt string").parquet(f"{folder}/{name}")
    known = manifest(spark, folder).select("epoch", "attempt")  # one row per batch
    return rows.join(F.broadcast(known), ["epoch", "attempt"]).drop("attempt")


def current(spark: SparkSession, folder: str, name: str = "postings") -> DataFrame:
    """A table as it stands: of each document the rows of the epoch that dealt with it last."""
    states = _committed(spark, folder, "state")
    newest = states.groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    if name == "state":
        return states.join(newest, ["doc_id", "epoch"]).drop("epoch")
    # what is no longer true is known by its state as well, and is little beside what stands
    stale = written(states.select("doc_id", "epoch").join(newest, ["doc_id", "epoch"], "left_anti"), "stale")
    return _committed(spark, folder, name).join(stale, ["doc_id", "epoch"], "left_anti").drop("epoch")


def pending(docs: DataFrame, state: DataFrame, version: int = VERSION, attempts: int = ATTEMPTS) -> DataFrame:
    """Documents to index: without a state, with one of an older version, or failed fewer times than ``attempts``."""
    done = state.where((F.col("version") >= version) & ((F.col("status") != "failed") | (F.col("attempts") >= attempts)))
    return docs.join(done.select("doc_id"), "doc_id", "left_anti")


def containing_chunk(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """``places`` (doc_id, byte_start, ...) with the first chunk of the document that holds the place; null if none does."""
    c = chunks.select(F.col("doc_id").alias("__d"), "ord", F.col("byte_start").alias("__s"), F.col("byte_end").alias("__e"))
    met = places.join(c, (F.col("doc_id") == F.col("__d")) & (F.col("byte_start") >= F.col("__s")) & (F.col("byte_start") < F.col("__e")), "left")
    return met.groupBy(*places.columns).agg(F.min("ord").alias("ord"))


def frames(docs: DataFrame) -> dict[str, DataFrame]:
    """Every table's rows of readable documents (doc_id, text). Contents lists are chunks, but nobody finds them."""
    chunks = written(structure.chunks(docs, "doc_id", "text"), "chunks")
    body = chunks.where("NOT is_toc").select("doc_id", "ord", F.concat_ws("\n", "section", "text").alias("body"))
    # a document and a chunk are one row each, so their terms are counted where they are
    tf = F.col("n").cast("double").alias("tf")
    found = terms_of.by_text(body, ["doc_id", "ord"], "body").select("doc_id", "ord", "term", tf)
    named = written(structure.defined_terms(docs, "doc_id", "text"), "defined").join(docs.select("doc_id", "text"), "doc_id")
    # a definition stands where its term is first quoted
    quoted = F.least(*[F.nullif(F.position(F.concat(F.lit(q), F.col("term")), F.col("text")), F.lit(0)) for q in ('"', "“")])
    at = F.octet_length(F.substring(F.col("text"), F.lit(1), quoted - 1)).cast("long")
    terms = containing_chunk(named.select("doc_id", "term", at.alias("byte_start")), chunks)
    return {"chunks": chunks, "chunk_postings": found, "postings": terms_of.by_text(docs, ["doc_id"], "text").select("doc_id", "term", tf), "terms": terms}


def index_batch(batch: DataFrame, batch_id: int, folder: str, run: str, version: int = VERSION) -> None:
    """Index what of ``batch`` (doc_id, text) needs it, all tables at once. A null text fails and is tried again when it comes again."""
    spark = batch.sparkSession
    known = manifest(spark, folder)
    if known.where((F.col("run") == run) & (F.col("batch") == batch_id)).limit(1).count():
        return
    epoch = (known.agg(F.max("epoch")).first()[0] or 0) + 1
    attempt = uuid.uuid4().hex
    state = written(current(spark, folder, "state"), "state")
    one = batch.groupBy("doc_id").agg(F.max("text").alias("text"))  # a row with a text before one without
    new = written(pending(one, state, version), "pending")
    good = new.where(F.col("text").isNotNull())
    out = frames(good)
    sizes = out["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    before = state.where((F.col("status") == "failed") & (F.col("version") >= version)).select("doc_id", F.col("attempts").alias("before"))
    bad = F.col("text").isNull()
    rows = new.join(sizes, "doc_id", "left").join(before, "doc_id", "left")
    out["state"] = rows.select("doc_id", F.lit(version).alias("version"), F.when(bad, "failed").otherwise("indexed").alias("status"), F.when(bad, "no text").alias("error"), F.when(bad, F.coalesce("before", F.lit(0)) + 1).otherwise(0).cast("int").alias("attempts"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
    for name, ddl in TABLES.items():
        columns = [x.split()[0] for x in ddl.split(", ")]
        out[name].select(*columns).write.parquet(f"{folder}/{name}/epoch={epoch}/attempt={attempt}")
    spark.createDataFrame([(epoch, attempt, run, batch_id, version)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; it goes when the checkpoint goes."""
    path = f"{checkpoint}/tessera-run"
    spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("name string").parquet(path).first()[0]


def run(spark: SparkSession, source: str, folder: str, checkpoint: str, schema: str, per_trigger: int | None = None, version: int = VERSION) -> None:
    """Everything that is in ``source`` now, in as many batches as it takes. A new version needs a new checkpoint, to see all files again."""
    create(spark, folder)
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    name = _run_name(spark, checkpoint)
    q = reader.parquet(source).writeStream.foreachBatch(lambda df, i: index_batch(df, i, folder, name, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def retry(spark: SparkSession, folder: str, docs: DataFrame, version: int = VERSION) -> int:
    """Try failed documents again with what ``docs`` (doc_id, text) has of them now; how many were due."""
    failed = current(spark, folder, "state").where((F.col("status") == "failed") & (F.col("attempts") < ATTEMPTS))
    due = written(docs.join(failed.select("doc_id"), "doc_id", "left_semi"), "retry")
    many = due.select("doc_id").distinct().count()
    if many:
        index_batch(due, 0, folder, f"retry-{uuid.uuid4().hex}", version)
    return many


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per user with a watermark; works on a stream and on a table alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start"), "n_events")
