"""Terms of texts with their places, grouped inside each row: nothing is shuffled for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Texts that are grouped at once.
TEXTS = 256


def _postings(part: pa.RecordBatch, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """One row per text and term, the places as distances: all tokens of the texts are ordered by text, term and place at once."""
    lists = part.column("__tokens")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    both = row * max(1, len(coded.dictionary)) + codes
    order = np.argsort(both, kind="stable")
    both, place = both[order], place[order]
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[start] = place[start]
    ends = np.append(start, len(both))
    at = order[start]
    columns = [coded.dictionary.take(pa.array(codes[at])), *[part.column(k).take(pa.array(row[at])) for k in keys], pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(gaps.astype("int32")))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_text(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """term, keys, n, gaps: one row per term of each row of ``rows``; a null text has none.

    Rows with equal keys are not put together.
    """
    cut = rows.select(*keys, T.tokens(F.col(text)).alias("__tokens")).where(F.size("__tokens") > 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("term", pa.string()), *[batch.schema.field(k) for k in keys], ("n", pa.int64()), ("gaps", pa.list_(pa.int32()))])
            for at in range(0, batch.num_rows, TEXTS):
                yield _postings(batch.slice(at, TEXTS), keys, schema)

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return cut.mapInArrow(task, f"term string, {kinds}, n long, gaps array<int>")
