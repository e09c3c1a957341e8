"""Token-id files with Elias-Fano document boundaries.

A file is a Parquet folder whose rows are blocks. A block holds the concatenated ids of consecutive documents
(two bytes an id where the vocabulary allows it), and two Elias-Fano sequences: where each document starts in the
block, and the ascending document ids. Samples of the set bits are stored with them: ``EliasFano.select`` gives one
offset from the nearest sample, without unpacking the others, and all reading goes through it.

Order: documents ascend by doc_id over all blocks (null first; rows that share a doc_id by text). Blocks are made
inside range partitions, so no task sees more than its range; where a block starts among all ids follows from
one running sum over the partitions' totals, which is read from the written blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import as_text, columns, map_rows, new_path, prefix_offsets, slices
from tessera.llm.encoding import ENCODED_BYTES, encoder, id_width

#: A block is closed at this many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Every so many set bits of the upper part, a block stores the bit's position.
SAMPLE = 64


class EliasFano:
    """Non-decreasing integers: low bits packed, high bits in unary, and the places of every SAMPLE-th set bit for select."""

    def __init__(self, n: int, base: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", b"")
        base = int(values[0])
        rest = (values.astype(np.uint64) - np.uint64(base & (2**64 - 1))).astype(np.uint64)
        low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
        bits = (rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        at = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        return cls(n, base, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, words of 64 bits are passed over by their count of set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int.from_bytes(self.samples[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        left, byte = i % SAMPLE, at // 8
        word = int.from_bytes(self.high[byte : byte + 8], "little") >> at % 8 << at % 8
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 8
            word = int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        start = i * self.low_bits
        low = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little") >> start % 8 & (1 << self.low_bits) - 1
        return (position - i << self.low_bits) + low + self.base

    def row(self) -> dict:
        return {"n": self.n, "base": self.base, "low_bits": self.low_bits, "low": self.low, "high": self.high, "samples": self.samples}


_PART = "n long, base long, low_bits int, low binary, high binary, samples binary"
_SCHEMA = "shard int, block int, first_in_shard long, n_ids long, nulls boolean, doc_from long, doc_to long, ids binary, " + ", ".join(f"{p}_{x}" for p in ("start", "doc") for x in _PART.split(", "))


def write(docs: DataFrame, path: str, tokenizer: str, kind: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text (null: empty), add ``end_id`` to each, write the blocks under ``path``.

    Empty table: a folder without blocks. Repeated rows are written as often as they come. Other columns are ignored.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        enc = encoder(tokenizer, kind)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> dict[str, list]:
            nonlocal block, before, held, size
            lengths = np.array([len(x) // enc.dtype.itemsize for _, x in held], np.int64)
            nulls = held[0][0] is None
            parts = {"start": EliasFano.encode(np.cumsum(lengths) - lengths), "doc": EliasFano.encode(np.zeros(len(held)) if nulls else np.array([i for i, _ in held], np.int64))}
            out = {"shard": [shard], "block": [block], "first_in_shard": [before], "n_ids": [int(lengths.sum())], "nulls": [nulls], "doc_from": [held[0][0]], "doc_to": [held[-1][0]], "ids": [b"".join(x for _, x in held)]}
            out |= {f"{p}_{k}": [v] for p, e in parts.items() for k, v in e.row().items()}
            block, before, held, size = block + 1, before + int(lengths.sum()), [], 0
            return out

        for part in slices(batches, limit=ENCODED_BYTES):
            for i, ids in zip(part.column("doc_id").to_pylist(), enc.encode(as_text(part.column("text")), end_id), strict=True):
                n = len(ids) // enc.dtype.itemsize
                if held and (size + n > BLOCK_IDS or (held[0][0] is None) != (i is None)):
                    yield close()
                held.append((i, ids))
                size += n
        if held:
            yield close()

    # ranges go by the beginning of the text as well, so that rows without an id, or of one repeated id, are no single range
    ordered = columns(docs, doc_id=doc_id, text=text).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    map_rows(ordered, _SCHEMA, task).write.option("compression", "zstd").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``first``, the ids of all documents before the block."""
    table = spark.read.schema(_SCHEMA).parquet(path)
    offsets = prefix_offsets(table.groupBy("shard").agg(F.sum("n_ids").alias("total")), "shard", "total", "shard_first")
    # one row for each partition that wrote: as bounded as the list of tasks itself
    return table.join(F.broadcast(offsets), "shard").withColumn("first", F.col("shard_first") + F.col("first_in_shard")).drop("shard_first")


def sequence(row: dict, name: str) -> EliasFano:
    """A block's Elias-Fano sequence ``start`` or ``doc``."""
    return EliasFano(*(row[f"{name}_{k}"] for k in ("n", "base", "low_bits", "low", "high", "samples")))


def read(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    width = id_width(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for row in batch.to_pylist():
                start, docs, ids = sequence(row, "start"), sequence(row, "doc"), np.frombuffer(row["ids"], width)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                a = 0
                for i in range(start.n):
                    b = start.select(i + 1) if i + 1 < start.n else len(ids)
                    for k, v in zip(out, (None if row["nulls"] else docs.select(i), row["first"] + a, b - a, ids[a:b].astype("<u4").tobytes()), strict=True):
                        out[k].append(v)
                    a = b
                yield out

    return map_rows(blocks(spark, path), "doc_id long, start long, n_tokens long, ids binary", task)


def lookup(spark: SparkSession, path: str, tokenizer: str, doc_ids: list[int]) -> DataFrame:
    """The documents of the files with the given ids, as ``read`` gives them, out of the blocks that can hold them.

    Blocks whose least and greatest id leave no room for a wanted one are not read; a block is searched by bisection over
    ``select``. Rows that repeat an id all come.
    """
    width, wanted = id_width(tokenizer), sorted(set(doc_ids))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for row in batch.to_pylist():
                start, docs, ids = sequence(row, "start"), sequence(row, "doc"), np.frombuffer(row["ids"], width)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                for x in wanted:
                    i = bisect_left(range(docs.n), x, key=docs.select)
                    while i < docs.n and docs.select(i) == x:
                        a, b = start.select(i), start.select(i + 1) if i + 1 < start.n else len(ids)
                        for k, v in zip(out, (x, row["first"] + a, b - a, ids[a:b].astype("<u4").tobytes()), strict=True):
                            out[k].append(v)
                        i += 1
                yield out

    if not wanted:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    room = F.exists(F.array(*map(F.lit, wanted)), lambda x: x.between(F.col("doc_from"), F.col("doc_to")))
    return map_rows(blocks(spark, path).where((F.col("doc_to") >= wanted[0]) & (F.col("doc_from") <= wanted[-1]) & room), "doc_id long, start long, n_tokens long, ids binary", task)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder, read them back, and digest each document's ids."""
    path = new_path(spark, "token-files")
    write(docs, path, tokenizer, kind, end_id)
    return read(spark, path, tokenizer).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


