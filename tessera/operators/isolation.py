"""Calls that fail for some inputs of a batch: the bad ones are found by halving, the others keep their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Inputs of one call.
BATCH = 64


def isolated(call: Callable[[list], list], inputs: list) -> list[tuple[object, str | None]]:
    """(result, None) or (None, what went wrong) for each input.

    A call that fails, or gives another number of results than inputs, is repeated on both halves of its inputs: with b
    bad ones among n there are about 2 * b * log2(n) calls. If nothing at all succeeds, the fault is the call's and not
    the inputs': the error goes on, so that the batch is tried again later as a whole.
    """

    def halved(part: list) -> list[tuple[object, str | None]]:
        try:
            got = list(call(part))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} inputs")
            return [(x, None) for x in got]
        except Exception as e:  # whatever a model or a parser raises
            errors.append(e)
            if len(part) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            middle = len(part) // 2
            return halved(part[:middle]) + halved(part[middle:])

    errors: list[Exception] = []
    out = halved(list(inputs)) if inputs else []
    if out and all(error is not None for _, error in out):
        raise errors[0]
    return out


def applied(df: DataFrame, key: str, value: str, make: Callable[[], Callable[[list], list]], result: str, size: int = BATCH) -> DataFrame:
    """key, result, error: one row per row of ``df``; ``make`` is called once in a task and gives the function of a batch.

    A null value is an error of its own and is handed to no call.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            keys, values = frame[key].tolist(), frame[value].tolist()
            rows = [(k, None, "no input") for k, v in zip(keys, values, strict=True) if v is None]
            good = [(k, v) for k, v in zip(keys, values, strict=True) if v is not None]
            for at in range(0, len(good), size):
                part = good[at : at + size]
                rows += [(k, r, e) for (k, _), (r, e) in zip(part, isolated(call, [v for _, v in part]), strict=True)]
            yield pd.DataFrame(rows, columns=[key, "result", "error"])

    return df.select(key, value).mapInPandas(task, f"{key} {df.schema[key].dataType.simpleString()}, result {result}, error string")
