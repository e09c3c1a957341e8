"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (Euclidean norm) into buckets, longest first. A query that already has k products
carries its lowest as a threshold; divided by its own length and a bucket's greatest, that is the cosine a vector of
the bucket must reach. Over 1, the whole bucket falls away; a high one prunes by coordinates (the ranges that the
query's largest coordinates leave open), a low one by length alone. What is left is verified with exact products.

Queries travel in blocks: a first round against the bucket of the longest vectors gives the thresholds. What each
block still needs (the least length that one of its queries can use) and each bucket's greatest length are single
numbers; they decide which blocks and buckets meet, before any vector is sent. Blocks and buckets have bounded sizes,
so a task holds two of them at a time, and a block is dealt to as many places as its buckets need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import columns, map_rows, materialise

#: Vectors in a bucket, and in a block of queries.
BLOCK, QUERIES = 1024, 4096
#: Buckets that meet one copy of a query block.
TOGETHER = 64
#: From this local cosine threshold on, coordinates prune; below it, only length.
COORDINATES_FROM = 0.75
#: Coordinates of a query that are looked at.
FOCUS = 3


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) to vec_id, v = floor(256 * x) and norm. Vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("long"))
    return vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


#: Whole numbers by size: a block is written in the smallest that holds all its components.
KINDS = ("<i2", "<i4", "<i8")


def _pack(rows: list[tuple]) -> dict[str, list]:
    width = max(len(v) for _, v, _ in rows)
    matrix = np.zeros((len(rows), width), "<i8")
    for i, (_, v, _) in enumerate(rows):
        matrix[i, : len(v)] = v
    top = int(np.abs(matrix).max(initial=0))
    kind = next(k for k in KINDS if top <= np.iinfo(k).max)
    return {"n": [len(rows)], "width": [width], "top": [max(x for _, _, x in rows)], "ids": [np.array([i for i, _, _ in rows], "<i8").tobytes()], "matrix": [matrix.astype(kind).tobytes()]}


def blocks(vectors: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows of up to ``size`` vectors, consecutive in ``order``; numbered from 0, longest first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        shard, part = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        for batch in batches:
            for row in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                held.append(row)
                if len(held) == size:
                    yield _pack(held) | {"shard": [shard], "part": [part]}
                    held, part = [], part + 1
        if held:
            yield _pack(held) | {"shard": [shard], "part": [part]}

    dealt = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return map_rows(dealt, "shard int, part int, n int, width int, top double, ids binary, matrix binary", task)


def numbered(packed: DataFrame, name: str) -> DataFrame:
    """The blocks, written, with their number in norm order: the numbering sorts one row per block."""
    table = materialise(packed, name)
    order = table.select("shard", "part").withColumn(name, F.row_number().over(Window.orderBy("shard", "part")) - 1)
    return table.join(order, ["shard", "part"]).drop("shard", "part")


def candidates_of(q: np.ndarray, q_norm: float, unit: np.ndarray, norms: np.ndarray, threshold: float) -> np.ndarray:
    """Positions in a bucket (longest first) that may reach ``threshold``; never misses one."""
    if q_norm == 0 or threshold <= 0:
        return np.arange(len(norms))
    n = int(np.searchsorted(-norms, -(threshold / q_norm) * (1 - 1e-9), side="right"))  # by length
    local = threshold / (q_norm * norms[0]) if n else 2.0
    if n == 0 or local > 1 + 1e-9:
        return np.zeros(0, np.int64)
    if local < COORDINATES_FROM:
        return np.arange(n)
    q_unit = q / q_norm
    open_ = np.ones(n, bool)
    for f in np.argsort(-np.abs(q_unit))[:FOCUS]:
        spread = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - q_unit[f] ** 2))
        # a unit vector with cosine >= local keeps its coordinate within the arc around the query's; past the pole the bound is 1 or -1
        top = 1.0 if q_unit[f] >= local else q_unit[f] * local + spread
        low = -1.0 if -q_unit[f] >= local else q_unit[f] * local - spread
        open_ &= (unit[:n, f] <= top + 1e-9) & (unit[:n, f] >= low - 1e-9)
    return np.flatnonzero(open_)


def products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum fits 53 bits, else in 64-bit whole numbers."""
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k].tolist()


def _matrix(raw: bytes, n: int, width: int, wide: int) -> np.ndarray:
    out = np.zeros((n, wide), np.int64)
    if n * width:
        out[:, :width] = np.frombuffer(raw, f"<i{len(raw) // (n * width)}").reshape(n, width)
    return out


def search(pairs: DataFrame, k: int) -> DataFrame:
    """For each pair of a query block and a bucket the k best of every query in it: query_id, vec_id, score."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for row in batch.to_pylist():
                wide = max(row["q_width"], row["width"])
                q, c = _matrix(row["q_matrix"], row["q_n"], row["q_width"], wide), _matrix(row["matrix"], row["n"], row["width"], wide)
                q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                norms, q_norms = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (c, q))
                order = np.argsort(-norms, kind="stable")
                c, ids, norms = c[order], ids[order], norms[order]
                unit = c / np.maximum(norms, 1e-300)[:, None]
                bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * wide
                floor = np.frombuffer(row["floor"], "<f8") if row["floor"] else np.full(len(q), -np.inf)
                out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
                chosen = [candidates_of(q[i], q_norms[i], unit, norms, floor[i]) for i in range(len(q))]
                plain = [i for i, x in enumerate(chosen) if len(x) > len(norms) // 2]
                dense = dict(zip(plain, products(q[plain], c, bound), strict=True)) if plain else {}
                for i, at in enumerate(chosen):
                    at = at[ids[at] != q_ids[i]]
                    if not len(at):
                        continue
                    score = dense[i][at] if i in dense else products(q[i : i + 1], c[at], bound)[0]
                    for j in best_of(score, ids[at], k):
                        out["query_id"].append(int(q_ids[i]))
                        out["vec_id"].append(int(ids[at[j]]))
                        out["score"].append(int(score[j]))
                if out["query_id"]:
                    yield out

    return map_rows(pairs, "query_id long, vec_id long, score long", task)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reachable(queries: DataFrame, buckets: DataFrame) -> DataFrame:
    """q_block, bucket: the buckets after the first whose greatest length is at least what the block needs.

    Buckets are numbered by length, so those are the first ones, and a count decides: one sort of a number for each
    block and each bucket.
    """
    marks = queries.select(F.col("need").alias("length"), "q_block").unionByName(buckets.select(F.col("top").alias("length"), F.lit(None).cast("int").alias("q_block")))
    w = Window.orderBy(F.desc("length"), F.col("q_block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    upto = marks.withColumn("many", F.count(F.when(F.col("q_block").isNull(), 1)).over(w)).where("q_block IS NOT NULL AND many > 1")
    return upto.select("q_block", F.explode(F.sequence(F.lit(1), F.col("many").cast("int") - 1)).alias("bucket"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, asked: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best among all other rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; an empty
    vector scores 0 with all, and a shorter vector counts as filled up with zeros. Ties go to the smaller id; rows
    that repeat an id are candidates one by one, a query's own id never. Scores are 64-bit. Fewer than k others: all of them; an empty
    table: no rows. Other columns are ignored.
    """
    base = quantised(columns(vectors, vec_id=vec_id, embedding=embedding).where(F.col("vec_id").isNotNull()))
    buckets = numbered(blocks(base, [F.desc("norm"), F.asc("vec_id")], block), "bucket")
    queries = base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    queries = blocks(queries, [F.desc("norm"), F.asc("vec_id")], asked)
    queries = numbered(queries, "q_block").select("q_block", *[F.col(x).alias(f"q_{x}") for x in ("n", "width", "ids", "matrix")])
    # round 1: the longest vectors give each query a first threshold
    first = queries.withColumn("floor", F.lit(None).cast("binary")).withColumn("bucket", F.lit(0)).join(buckets, "bucket")
    seen = materialise(search(first, k), "topk-first")
    floors = seen.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("found")).where(F.col("found") == k).select("query_id", "low")
    queries = materialise(with_floors(queries, floors), "topk-queries")
    pairs = reachable(queries, buckets).withColumn("copy", (F.col("bucket") / TOGETHER).cast("int"))
    wanted = pairs.groupBy("q_block", "copy").count().drop("count")
    copies = queries.drop("need").join(wanted, "q_block")
    rest = pairs.join(buckets.drop("top"), "bucket").join(copies, ["q_block", "copy"])
    return _ranked(seen.unionByName(search(rest, k)), k)


def with_floors(queries: DataFrame, floors: DataFrame) -> DataFrame:
    """Query blocks with ``floor``, a threshold for each of their queries (little-endian doubles), and ``need``, the least length by which a vector can reach one of them."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for number, raw in zip(batch.column("q_block").to_pylist(), batch.column("q_ids").to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8")
                yield {"q_block": [number] * len(own), "at": list(range(len(own))), "query_id": own.tolist()}

    of = map_rows(queries.select("q_block", "q_ids"), "q_block int, at int, query_id long", ids).join(floors, "query_id")
    per = of.groupBy("q_block").agg(F.collect_list(F.struct("at", "low")).alias("lows"))  # at most a block's queries

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for row in batch.to_pylist():
                floor = np.full(row["q_n"], -np.inf)
                for x, low in zip(row["at"] or [], row["low"] or [], strict=True):
                    floor[x] = low
                own = np.sqrt((_matrix(row["q_matrix"], row["q_n"], row["q_width"], row["q_width"]).astype(np.float64) ** 2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor <= 0, 0.0, floor / own * (1 - 1e-9))  # a query of length 0 reaches no floor above 0
                yield {k: [row[k]] for k in ("q_block", "q_n", "q_width", "q_ids", "q_matrix")} | {"floor": [floor.astype("<f8").tobytes()], "need": [float(need.min())]}

    joined = queries.join(per, "q_block", "left").select(*queries.columns, F.col("lows.at").alias("at"), F.col("lows.low").alias("low"))
    return map_rows(joined, "q_block int, q_n int, q_width int, q_ids binary, q_matrix binary, floor binary, need double", task)
