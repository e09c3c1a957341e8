"""Two-phase vector search: sign-bit shortlist, then the 8-bit rescore, within a scope.

A query set is stated; it is packed into blocks, and so is the index. Each block of the index meets each block of
queries once, in a task that works on whole matrices and hands on the best of its block for each query, so what is
sorted afterwards is some hundred rows for a query and block, never a row for each pair. Query blocks travel to the
tasks while they are small enough (SENT_BYTES), and the tasks block the rows of the index as these arrive; beyond that,
both sides are packed and Spark pairs the blocks by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources.shared import written

SHORTLIST, KEPT = 300, 50
#: Vectors of a block of the index, and of a block of queries.
INDEX_BLOCK, QUERY_BLOCK = 4096, 512
#: Bytes of query blocks up to which they are sent to every task.
SENT_BYTES = 64 << 20

_INDEX = "n int, width int, keys binary, labels binary, q binary, scales binary, sigs binary"
_ASKED = "a_n int, a_width int, a_keys binary, a_vectors binary, a_sigs binary, a_bytes long"


def indexed(vectors: DataFrame, key: str, vector: str, dimensions: int = 64, *keep: str) -> DataFrame:
    """key, sig (sign bits of the quantised value), q (8-bit), scale."""
    p = vectors.select(key, *keep, V.prepared(F.col(vector), dimensions).alias("p"))
    q = p.select(key, *keep, V.quantised(F.col("p")).alias("q"), V.scale(F.col("p")).alias("scale"))
    return q.withColumn("sig", V.signature(F.col("q")))


def queries(vectors: DataFrame, key: str, vector: str, dimensions: int = 64) -> DataFrame:
    """query_id, qp (normalised), qsig (sign bits of the normalised value)."""
    p = vectors.select(F.col(key).alias("query_id"), V.prepared(F.col(vector), dimensions).alias("qp"))
    return p.withColumn("qsig", V.signature(F.col("qp")))


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows; the last one may be shorter."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held, n = [*held, part], n + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(rows: DataFrame, ddl: str, size: int, pack: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Rows of up to ``size`` rows of ``rows`` each."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _gathered(batches, size):
            out = pack(whole)
            yield pa.RecordBatch.from_pylist([{k: out[k] for k in names}], schema=schema)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])
    return rows.mapInArrow(task, ddl)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _index_rows(index: DataFrame, key: str, label: str | None) -> DataFrame:
    return index.select(F.col(key).cast("long").alias("key"), (F.col(label) if label else F.lit(0)).cast("long").alias("label"), "q", "scale", "sig")


def _index_block(x: pa.RecordBatch) -> dict:
    q = _matrix(x.column("q"), "i1")
    return {"n": len(q), "width": q.shape[1], "keys": x.column("key").to_numpy().tobytes(), "labels": x.column("label").to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "q": q.tobytes(), "scales": x.column("scale").to_numpy().tobytes(), "sigs": x.column("sig").to_numpy().tobytes()}


def query_blocks(asked: DataFrame) -> DataFrame:
    rows = asked.select(F.col("query_id").cast("long").alias("query_id"), "qp", "qsig").coalesce(8)

    def pack(x: pa.RecordBatch) -> dict:
        v = _matrix(x.column("qp"), "<f8")
        return {"a_n": len(v), "a_width": v.shape[1], "a_keys": x.column("query_id").to_numpy().tobytes(), "a_vectors": v.tobytes(), "a_sigs": x.column("qsig").to_numpy().tobytes(), "a_bytes": v.nbytes}

    return written(_packed(rows, _ASKED, QUERY_BLOCK, pack), "query-blocks")


class Met:
    """A block of the index and a block of queries as arrays."""

    def __init__(self, row: dict):
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.keys, self.labels, self.scales, self.sigs = of("keys", "<i8"), of("labels", "<i8"), of("scales", "<f8"), of("sigs", "<u8")
        self.q = of("q", "i1").reshape(row["n"], row["width"])
        self.asked, self.asked_sigs = of("a_keys", "<i8"), of("a_sigs", "<u8")
        self.vectors = of("a_vectors", "<f8").reshape(row["a_n"], row["a_width"])
        self.other = self.asked[:, None] != self.keys[None, :]

    def scores(self) -> np.ndarray:
        s = self.vectors @ self.q.T.astype(np.float64)
        s *= self.scales
        return np.round(s, 6, out=s)

    def distances(self) -> np.ndarray:
        return np.bitwise_count(self.asked_sigs[:, None] ^ self.sigs[None, :]).astype(np.int64)


def met(index: DataFrame, asked: DataFrame, key: str, ddl: str, work: Callable[[Met], pd.DataFrame], label: str | None = None) -> DataFrame:
    """What ``work`` makes of each block of the index with each block of queries."""
    blocks = query_blocks(asked)
    size = blocks.agg(F.coalesce(F.sum("a_bytes"), F.lit(0))).first()[0]  # one number
    rows, many = _index_rows(index, key, label), INDEX_BLOCK
    if size <= SENT_BYTES:
        sent = index.sparkSession.sparkContext.broadcast([r.asDict() for r in blocks.collect()])  # SENT_BYTES at most

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in _gathered(batches, many):
                block = _index_block(whole)
                for other in sent.value:
                    yield pa.RecordBatch.from_pandas(work(Met(block | other)), preserve_index=False)

        return rows.mapInArrow(meet, ddl)
    pairs = _packed(rows, _INDEX, many, _index_block).crossJoin(blocks)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for at in range(batch.num_rows):  # one pair at a time leaves Arrow
                yield pa.RecordBatch.from_pandas(work(Met(batch.slice(at, 1).to_pylist()[0])), preserve_index=False)

    return pairs.mapInArrow(task, ddl)


def _best(order: tuple[np.ndarray, ...], allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k allowed ones in the order of the keys (last one first)."""
    at = np.flatnonzero(allowed)
    lead = order[-1][at]
    if len(at) > 4 * k:
        edge = np.partition(lead, k - 1)[k - 1]
        at = at[lead <= edge]
    return at[np.lexsort(tuple(x[at] for x in order))][:k]


def shortlist(index: DataFrame, key: str, asked: DataFrame, k: int = SHORTLIST, label: str | None = None) -> DataFrame:
    """query_id, key, label, distance, score, place: the k nearest by sign bits, ties to the larger key; with the product of the query and the 8-bit vector."""

    def work(m: Met) -> pd.DataFrame:
        away, out = m.distances(), []
        for i, own in enumerate(m.asked):
            at = _best((-m.keys, away[i]), m.other[i], k)
            score = np.round(m.q[at].astype(np.float64) @ m.vectors[i] * m.scales[at], 6)
            out.append(pd.DataFrame({"query_id": own, key: m.keys[at], "label": m.labels[at], "distance": away[i][at].astype(np.int32), "score": score}))
        return pd.concat(out, ignore_index=True)

    near = met(index, asked, key, f"query_id long, {key} long, label long, distance int, score double", work, label)
    w = Window.partitionBy("query_id").orderBy("distance", F.desc(key))
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rescored(short: DataFrame, key: str, k: int = KEPT) -> DataFrame:
    """The k best of a shortlist by score; ties to the smaller key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return short.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(index: DataFrame, key: str, asked: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """query_id, key, score: the k best of all vectors by score, from ``least`` on; ties to the smaller key."""

    def work(m: Met) -> pd.DataFrame:
        scores, out = m.scores(), []
        for i, own in enumerate(m.asked):
            at = _best((m.keys, -scores[i]), m.other[i] & (scores[i] >= least), k)
            out.append(pd.DataFrame({"query_id": own, key: m.keys[at], "score": scores[i][at]}))
        return pd.concat(out, ignore_index=True)

    return rescored(met(index, asked, key, f"query_id long, {key} long, score double", work), key, k)


def best_by_group(index: DataFrame, key: str, asked: DataFrame, label: str | None = None, least: float = -1.0) -> DataFrame:
    """query_id, label, best: the greatest score of each group's vectors, from ``least`` on."""

    def work(m: Met) -> pd.DataFrame:
        scores = np.where(m.other, m.scores(), -np.inf)
        groups, inside = np.unique(m.labels, return_inverse=True)
        out = []
        for g, name in enumerate(groups):
            top = scores[:, inside == g].max(axis=1)
            good = top >= least
            out.append(pd.DataFrame({"query_id": m.asked[good], "label": name, "best": top[good]}))
        return pd.concat(out, ignore_index=True)

    found = met(index, asked, key, "query_id long, label long, best double", work, label)
    return found.groupBy("query_id", "label").agg(F.max("best").alias("best"))


# The start and the factor of the hash of three characters, its components, and the bit that gives the sign.
TRIGRAM_START, TRIGRAM_FACTOR, TRIGRAM_COMPONENTS, TRIGRAM_SIGN = 1469598103934665603, 1099511628211, 512, 20


def trigram_vector(text: str | None) -> np.ndarray:
    """Hashed bag of three characters in a row (letters, digits and spaces, lower case); a set bit 20 subtracts."""
    code = np.array([ord(c) for c in (text or "").lower() if c.isalnum() or c == " "], np.uint64)
    h = np.full(max(0, len(code) - 2), TRIGRAM_START, np.uint64)
    for i in range(3):
        h = (h ^ code[i : i + len(h)]) * np.uint64(TRIGRAM_FACTOR)
    sign = np.where(h >> np.uint64(TRIGRAM_SIGN) & np.uint64(1), -1.0, 1.0)
    return np.bincount((h % np.uint64(TRIGRAM_COMPONENTS)).astype(np.int64), sign, TRIGRAM_COMPONENTS)


#: Texts whose vectors are handed on at once.
EMBEDDED = 256


def trigram_embedded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, embedding (512 components, not normalised): a deterministic embedding without a model.

    The vectors of EMBEDDED texts are one array of numbers; no vector is a list of Python's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBEDDED):
                part = batch.slice(at, EMBEDDED)
                flat = np.concatenate([trigram_vector(x.as_py()) for x in part.column("text")]).astype("float32")
                ends = pa.array(np.arange(part.num_rows + 1, dtype="int32") * TRIGRAM_COMPONENTS)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(ends, pa.array(flat))], names=[key, "embedding"])

    return rows.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(task, f"{key} long, embedding array<float>")


def near_of_same(index: DataFrame, key: str, asked: DataFrame, label: str, least: float) -> DataFrame:
    """query_id, key, score of the rows of ``index`` that share ``label`` with a query and are as near as ``least``.

    ``asked`` has a query or a few for each label, so a row meets these only; no vector leaves the JVM for its product.
    """
    met = index.join(asked.select("query_id", label, "qp"), label)
    score = F.round(V.dot(F.col("qp"), F.col("q")) * F.col("scale"), 6)
    return met.select("query_id", key, score.alias("score")).where(F.col("score") >= least)
