"""Concatenate and cut: documents end to end, cut into windows of ``window`` ids.

First pass: each task of the scan encodes its texts, counts, and writes (task, position in the task, ids). Prefix
sums over the tasks' totals give every document its place among all ids. Second pass: the place decides the windows;
a document that crosses a boundary gets one piece in each window it touches. No shuffle moves a text or an id, and
no window but the last is short: padding is under one window for the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text, columns, map_rows, materialise, prefix_offsets, slices
from tessera.llm.encoding import ENCODED_BYTES, encoder, id_width

WINDOW = 2048


def encoded(docs: DataFrame, tokenizer: str, kind: str | None, end_id: int) -> DataFrame:
    """First pass, written: doc_id, task, place (ids before the document in its task), n, ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        enc = encoder(tokenizer, kind)
        number, place = TaskContext.get().partitionId(), 0
        for part in slices(batches, limit=ENCODED_BYTES):
            ids = enc.encode(as_text(part.column("text")), end_id)
            n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            yield {"doc_id": part.column("doc_id"), "task": [number] * len(ids), "place": (place + np.cumsum(n) - n).tolist(), "n": n.tolist(), "ids": ids}
            place += int(n.sum())

    return materialise(map_rows(docs, "doc_id long, task int, place long, n long, ids binary", task), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, kind: str | None = None, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null text counts as empty and has the end id alone. Repeated rows are packed as often as they come, null
    doc_ids are carried, other columns ignored; an empty table gives no pieces.
    """
    width = id_width(tokenizer)
    table = encoded(columns(docs, doc_id=doc_id, text=text), tokenizer, kind, end_id)
    firsts = prefix_offsets(table.groupBy("task").agg(F.sum("n").alias("total")), "task", "total", "task_first")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in slices(batches, "ids"):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], width).astype("<u4")
                first = row["task_first"] + row["place"]
                for sequence in range(first // window, (first + row["n"] - 1) // window + 1):
                    a, b = max(first, sequence * window), min(first + row["n"], (sequence + 1) * window)
                    for k, v in (("doc_id", row["doc_id"]), ("start", a - first), ("length", b - a), ("ids", ids[a - first : b - first].tobytes()), ("doc_tokens", row["n"]), ("sequence_id", sequence), ("offset", a - sequence * window)):
                        out[k].append(v)
            yield out

    # one row for each task of the first pass
    placed = table.join(F.broadcast(firsts), "task").select("doc_id", "place", "n", "ids", "task_first")
    return map_rows(placed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", cut)


def pieces(docs: DataFrame, tokenizer: str, **options: int | str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


