"""Helpers shared by the training-data operators.

Two conventions hold throughout:

* What several later steps read is written once as Parquet under the folder named by
  ``spark.checkpoint.dir`` (``materialise``), so a lost executor costs a re-read, not a recomputation,
  and no step depends on a file that only one machine can see.
* Python runs only inside tasks, over Arrow batches that are cut to a bounded number of text bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a task handles at a time.
SLICE_BYTES = 4 << 20
#: Bytes of a batch that Spark hands to Python.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine that names none gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and every later read sees the same rows."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialise`` wrote of frames that nothing reads any more, and let Spark's cleaner drop the shuffles behind them.

    Only call it when all that was made of them has been written.
    """
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "written_to", None)
        if path:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    if frames:
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, renamed; whatever else the table has cannot clash with an operator's own names."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in wanted.items()])


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as one struct ``row`` beside what a stage needs of them, so that no name of theirs can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``carried`` with the columns of ``docs``."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about ``limit`` bytes of text; one row is never cut. ``column`` has the texts, or their sizes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        lengths = pc.fill_null(sizes if pa.types.is_integer(sizes.type) else pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


#: What Python workers remember between tasks, by name; only the tasks of one stage share it.
_memories: dict[str, object] = {}
_stage: list[int] = []


def remembered(name: str, make: Callable[[], object]) -> object:
    """A memory that the tasks of one stage share in a worker; the first task of another stage starts without any."""
    if name not in _memories:
        _memories[name] = make()
    return _memories[name]


def forget_other_stages() -> None:
    context = TaskContext.get()
    now = [context.stageId()] if context else []
    if now != _stage:
        _memories.clear()
        give_back()
        _stage[:] = now


def give_back() -> None:
    """Hand memory that Arrow and the C library hold but do not use back to the system: workers stay when their tasks have ended."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Of what goes to Python, JVM and worker each hold a batch of BATCH_BYTES at a time, not one of Spark's 64 MB; a session that has less keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def map_rows(df: DataFrame, ddl: str, task: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` for a task that yields columns as lists."""
    schema = arrow_schema(ddl)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for out in task(batches):
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)
        give_back()

    return df.mapInArrow(run, ddl)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other characters take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def prefix_offsets(totals: DataFrame, order: str, total: str, name: str) -> DataFrame:
    """Exclusive running sum over one row per task of an earlier stage: as many rows as that stage had partitions."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(order, F.coalesce(F.sum(total).over(w), F.lit(0)).cast("long").alias(name))
