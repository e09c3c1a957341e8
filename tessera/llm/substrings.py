"""Removal of passages that occur more than once, with a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the KEY-word hashes inside it the least is its anchor, so equal windows have
equal anchors at equal places, and one anchor serves about a dozen neighbouring windows. The index holds, for each
anchor hash, how often it occurs and whether all its occurrences have the same extent (all words of the windows that
it serves). Each batch of documents becomes a sorted immutable run; runs are bucketed and sorted by hash, so a new
one is merge-joined with the history without a shuffle, and compaction writes the merged run. An index lives in a
folder, can be opened again, and judges a new batch against all that was added before (``remove_repeats`` with
``index``); for that it also keeps the anchors and the texts of its documents.

Verification: an anchor that occurs again settles its windows at once only if all its occurrences have one extent,
by a digest of the extent's words themselves, which has nothing to do with the hash that brought them together.
Where extents differ, the windows are compared, again by the hash and by a digest of their words. Two different
windows would have to agree in two independent 64-bit values to be taken for one.

Removal: every word that a repeated window covers goes, in all documents, the first one included.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, columns, map_rows, materialise, new_path, slices

WINDOW = 35
#: Words of an anchor.
KEY = 10
#: Windows that are worked on at a time; of a longer text each such stretch has its own anchors.
STRETCH = 1 << 20
#: Text bytes whose texts are worked on together.
TOGETHER = 1 << 20
#: Bytes whose words are hashed at a time.
BLOCK = 1 << 18
#: Version of the hashes that an index keeps.
HASHES = 2

_BASE = 0x9E3779B97F4A7C15
#: What each byte counts in the hash of a word.
_BYTES = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB)


class Text:
    """Words of one text, or of several one behind the other, and the hashes of its word sequences by prefix sums.

    No window spans two texts. Places count the words of all texts; ``first`` has where each text begins, and the end.
    """

    def __init__(self, *raw: bytes):
        each = [b" ".join(x.split()) for x in raw]  # of UTF-8, exactly the runs of other characters than the six ASCII white spaces
        self.first = np.cumsum([0, *(x.count(b" ") + 1 if x else 0 for x in each)])
        self.n = int(self.first[-1])
        line = b" ".join(filter(None, each))
        self.line = memoryview(line)
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        self.ends = np.append(spaces, len(line))[: self.n] + 1  # one behind each word

    @cached_property
    def sums(self) -> np.ndarray:
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.word_hashes() * powers(self.n + 1)[0][: self.n], dtype=np.uint64, out=sums[1:])
        return sums

    def word_hashes(self) -> np.ndarray:
        """Of each word, by prefix sums of its bytes; words of more than BLOCK bytes one by one."""
        data, h, at = np.frombuffer(self.line, np.uint8), np.zeros(self.n, np.uint64), 0
        begins = np.concatenate([[0], self.ends[:-1]])
        while at < self.n:
            begin = int(begins[at])
            upto = int(np.searchsorted(self.ends, begin + BLOCK + 1, side="right"))  # words within BLOCK bytes
            if upto == at:
                h[at] = xxhash.xxh64_intdigest(self.line[begin : int(self.ends[at]) - 1], 7)
                at += 1
                continue
            part = data[begin : int(self.ends[upto - 1]) - 1]
            power, inverse = powers(BLOCK + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * power[: len(part)], dtype=np.uint64, out=sums[1:])
            a, b = begins[at:upto] - begin, self.ends[at:upto] - 1 - begin
            h[at:upto] = mixed((sums[b] - sums[a]) * inverse[a])
            at = upto
        return h

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * powers(self.n + 1)[1][start])

    def digests(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Digests of the words themselves, in their order and joined by single spaces."""
        begins, ends = (self.ends[start - 1] * (start > 0)).tolist(), (self.ends[start + length - 1] - 1).tolist()
        line = self.line
        return np.array([xxhash.xxh3_64_intdigest(line[a:b], 9) for a, b in zip(begins, ends, strict=True)], np.uint64).view(np.int64)

    def anchors(self, extents: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor its hash, the hash of its extent (zeros without ``extents``), and the first and last window that it serves."""
        found = []
        reach = WINDOW - KEY + 1
        many = np.maximum(np.diff(self.first) - WINDOW + 1, 0)
        windows = np.zeros(self.n, bool)
        windows[starts(self.first[:-1][many > 0], (self.first[:-1] + many - 1)[many > 0])] = True
        for first in range(0, max(0, self.n - WINDOW + 1), STRETCH):
            count = min(STRETCH, self.n - WINDOW + 1 - first)  # places of this stretch
            own = np.flatnonzero(windows[first : first + count])
            if not len(own):
                continue
            keys = self.hashes(first + np.arange(count + reach - 1), KEY)
            low = np.uint64((1 << 24) - 1)
            least = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)  # ties: the leftmost
            size = 1
            while size * 2 <= reach:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            least = np.minimum(least[:count], least[reach - size : reach - size + count])
            at = (least[own] & low).astype(np.int64)  # inside the window, so texts do not share any
            edge = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            a, b, p = own[edge], own[np.append(edge[1:], len(own)) - 1], at[edge]
            extent = np.zeros(len(a), np.uint64)
            if extents:
                extent = self.digests(first + a, b - a + WINDOW).view(np.uint64) + (p - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (b - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            found.append((keys[p].view(np.int64), mixed(extent).view(np.int64), first + a, first + b))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def without(self, repeated: np.ndarray) -> tuple[list[int], list[str]]:
        """For each text the words removed, and the digest of the others, when the windows that start at ``repeated`` go."""
        size = self.n + 1
        gone = np.cumsum(np.bincount(repeated, minlength=size) - np.bincount(repeated + WINDOW, minlength=size))[: self.n] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[self.first])
        # stretches of words that stay, each in one text
        border = np.ones(size, bool)
        border[1:-1] = gone[1:] != gone[:-1]
        border[self.first] = True
        edge = np.flatnonzero(border)
        a, b = edge[:-1], edge[1:]
        a, b = a[~gone[a]], b[~gone[a]]
        of = np.searchsorted(a, self.first).tolist()
        line, begins, ends = self.line, (self.ends[a - 1] * (a > 0)).tolist() if len(a) else [], (self.ends[b - 1] - 1).tolist()
        parts = [line[x:y] for x, y in zip(begins, ends, strict=True)]
        return removed.tolist(), [hashlib.sha256(b" ".join(parts[i:j])).hexdigest() for i, j in pairwise(of)]

    def by_text(self, a: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        """For values that belong to the places ``a``, in order: a list for each text."""
        at = pa.array(np.searchsorted(a, self.first), pa.int32())
        return [pa.ListArray.from_arrays(at, pa.array(x)) for x in values]


def starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All windows from a to b, for several such ranges."""
    n = b - a + 1
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a 64-bit key that is never null.

    Rows that are equal, or by chance share a key, are told each other's repeated hashes as well. That is harmless:
    whether a hash repeats holds for the whole table, and each row only looks for its own hashes.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text")


def anchors(docs: DataFrame) -> DataFrame:
    """From keyed rows: k, fp and ext (arrays), written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches, limit=TOGETHER):
            text = Text(*as_bytes(part.column("text")))
            fp, ext, a, _ = text.anchors()
            fp, ext = text.by_text(a, fp, ext)
            yield {"fp": fp, "ext": ext, "k": part.column("k")}

    return materialise(map_rows(docs.select("k", "text"), "k long, fp array<long>, ext array<long>", task), "substring-anchors")


_RUN = "fp BIGINT, n BIGINT, ext BIGINT, mixed BOOLEAN"


class FingerprintIndex:
    """Sorted immutable runs of (fp, n, ext, mixed): an anchor's hash, its occurrences, an extent, and whether there are others.

    The folder ``path`` has the runs, a manifest whose newest version names those that count and, unless ``documents``
    is false, the anchors and texts of what was added. An index that exists is opened.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, documents: bool = True):
        self.spark, self.path, self.documents = spark, path.rstrip("/"), documents
        self.runs: list[str] = []
        self.version, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            rows = spark.read.parquet(f"{self.path}/manifest")
            last = rows.agg(F.max("version")).first()[0]
            found = rows.where(F.col("version") == last).orderBy("place").collect()  # one or two runs
        except AnalysisException:  # a new index
            found = []
        if found:
            if found[0].asDict().get("hashes") != HASHES:
                raise ValueError(f"the index {self.path} was written with other hashes of words; build it again")
            self.runs, self.version, self.buckets = [r["run"] for r in found], last, found[0]["buckets"]
            for name in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _write(self, rows: DataFrame) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _note(self) -> None:
        self.version += 1
        rows = [(self.version, i, name, self.buckets, HASHES) for i, name in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "version long, place int, run string, buckets int, hashes int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, batch: DataFrame, docs: DataFrame | None = None) -> None:
        """``batch`` (anchors of ``docs``) becomes a run; as soon as two runs exist they are merged, so a lookup reads one."""
        each = batch.select(F.explode(F.arrays_zip("fp", "ext")).alias("x")).select("x.fp", "x.ext")
        run = each.groupBy("fp").agg(F.count("*").alias("n"), F.min("ext").alias("ext"), (F.min("ext") != F.max("ext")).alias("mixed"))
        if self.documents and docs is not None:
            batch.write.mode("append").parquet(f"{self.path}/anchors")
            docs.select("k", "text").write.mode("append").parquet(f"{self.path}/texts")
        self.runs.append(self._write(run))
        if len(self.runs) > 1:
            self.compact()
        else:
            self._note()

    def compact(self) -> None:
        """Merge-join of the two oldest runs, both bucketed and sorted by hash; once the merged run is written they go."""
        old, new = (self.spark.table(x) for x in self.runs[:2])
        new = new.select("fp", *[F.col(x).alias(f"new_{x}") for x in ("n", "ext", "mixed")])
        merged = old.join(new.hint("merge"), "fp", "full").select(
            "fp",
            (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"),
            F.coalesce("ext", "new_ext").alias("ext"),
            (F.coalesce("mixed", F.lit(False)) | F.coalesce("new_mixed", F.lit(False)) | F.coalesce(F.col("ext") != F.col("new_ext"), F.lit(False))).alias("mixed"),
        )
        done, self.runs[:2] = self.runs[:2], [self._write(merged)]
        self._note()
        for name in done:
            self.spark.sql(f"DROP TABLE {name}")
            self.spark.createDataFrame([], _RUN).write.mode("overwrite").parquet(f"{self.path}/{name}")  # frees its files

    def repeated(self) -> DataFrame:
        """fp and mixed of the anchors that occur more than once in all that was added."""
        while len(self.runs) > 1:
            self.compact()
        # read as plain files: with exchanges on both sides the later join can split a hot anchor
        return self.spark.read.schema(_RUN).parquet(f"{self.path}/{self.runs[0]}").where("n > 1").select("fp", "mixed")

    def history(self) -> tuple[DataFrame, DataFrame] | None:
        """Anchors (k, fp, ext) and texts (k, text) of what an opened index holds; None for a new one."""
        if not self.version or not self.documents:
            return None
        return tuple(self.spark.read.schema(s).parquet(f"{self.path}/{x}") for x, s in (("anchors", "k long, fp array<long>, ext array<long>"), ("texts", "k long, text string")))

    def close(self) -> None:
        """No table stays in the session's catalogue; the folder does."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _both(hashes: np.ndarray, digests: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the pair of a hash and a digest is one of the pairs ``of``. Pairs are compared by the ranks of what they consist of."""
    n, code = len(hashes), np.zeros(len(hashes) + len(of[0]), np.int64)
    for mine, theirs in zip((hashes, digests), of, strict=True):
        values, rank = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
        code = code * len(values) + rank
    return np.isin(code[:n], code[n:])


def _isin(values: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which values the lists of a column have. What repeats holds for the whole table, so the lists of a slice count as one."""
    return np.isin(values, column.flatten().to_numpy(zero_copy_only=False))


def first_verdict(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that need no comparison of windows get their result; the others keep what the comparison needs.

    ``sure`` and ``open`` are ranges of windows (first, last, first, last, ...): those that repeat, and those that may.
    """

    def settled(part: pa.RecordBatch) -> dict[str, list]:
        text = Text(*as_bytes(part.column("text")))
        at = np.zeros(0, np.int64)
        if len(part.column("one").flatten()):
            fp, _, a, b = text.anchors(extents=False)
            sure = _isin(fp, part.column("one"))
            at = starts(a[sure], b[sure])
        removed, sha = text.without(at)
        return {"n_words": np.diff(text.first), "n_removed": removed, "sha": sha} | {k: [None] * len(sha) for k in ("text", "sure", "open", "some", "window", "digest")}

    def unsettled(part: pa.RecordBatch) -> dict[str, list]:
        text = Text(*as_bytes(part.column("text")))
        fp, _, a, b = text.anchors(extents=False)
        sure, open_ = _isin(fp, part.column("one")), _isin(fp, part.column("some"))
        out: dict[str, list] = {}
        for k, of in (("sure", sure), ("open", open_)):
            x, y = a[of], b[of]
            base = text.first[np.searchsorted(text.first, x, side="right") - 1]
            (out[k],) = text.by_text(np.repeat(x, 2), np.stack([x - base, y - base], axis=1).ravel().astype(np.int32))
        at = starts(a[open_], b[open_])
        out["window"], out["digest"] = text.by_text(at, text.hashes(at, WINDOW).view(np.int64), text.digests(at, WINDOW))
        return out | {"n_words": np.diff(text.first), "text": part.column("text"), "some": part.column("some")} | {k: [None] * part.num_rows for k in ("n_removed", "sha")}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches, limit=TOGETHER):
            some = pc.fill_null(pc.greater(pc.list_value_length(part.column("some")), 0), False)
            for rows, verdict in ((part.filter(pc.invert(some)), settled), (part.filter(some), unsettled)):
                if rows.num_rows:
                    yield verdict(rows) | {k: rows.column(k) for k in ("k", "doc_id")}

    joined = docs.join(known, "k", "left").select("k", "doc_id", "text", "one", "some")
    return materialise(map_rows(joined, "k long, doc_id long, n_words long, n_removed long, sha string, text string, sure array<int>, open array<int>, some array<long>, window array<long>, digest array<long>", task), "substring-verdict")


def last_verdict(rest: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches, limit=TOGETHER):
            text = Text(*as_bytes(part.column("text")))
            at = []
            for k in ("sure", "open"):
                column = part.column(k)
                places = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                places += np.repeat(text.first[:-1], pc.list_value_length(column).to_numpy(zero_copy_only=False))
                at.append(starts(places[::2], places[1::2]))
            sure, maybe = at
            again = tuple(part.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("again", "digest"))
            if len(again[0]):
                hashes = text.hashes(maybe, WINDOW).view(np.int64)
                maybe = maybe[np.isin(hashes, again[0])]
                maybe = maybe[_both(text.hashes(maybe, WINDOW).view(np.int64), text.digests(maybe, WINDOW), again)]
            else:
                maybe = maybe[:0]
            removed, sha = text.without(np.concatenate([sure, maybe]))
            yield {"n_removed": removed, "sha": sha} | {k: part.column(k) for k in ("doc_id", "n_words")}

    return map_rows(rest, "doc_id long, n_words long, n_removed long, sha string", task)


def windows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """From (k, text) and (k, some): window and digest (arrays) of the windows that the anchors ``some`` of each text serve."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches, limit=TOGETHER):
            text = Text(*as_bytes(part.column("text")))
            fp, _, a, b = text.anchors(extents=False)
            open_ = _isin(fp, part.column("some"))
            at = starts(a[open_], b[open_])
            window, digest = text.by_text(at, text.hashes(at, WINDOW).view(np.int64), text.digests(at, WINDOW))
            yield {"window": window, "digest": digest}

    return map_rows(docs.join(wanted, "k").select("text", "some"), "window array<long>, digest array<long>", task)


def remove_repeats(docs: DataFrame, batches: int = 2, doc_id: str = "doc_id", text: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words; a text of fewer than WINDOW words loses none; the digest is of the kept words joined by
    single spaces. Repeated rows are copies of each other, so all their windows repeat. Null doc_ids are carried, an
    empty table gives no rows, other columns are ignored. Documents reach the index in ``batches`` (by hash), and the
    result does not depend on how many. With ``index``, a window also repeats if it starts anywhere in what that index
    holds, and ``docs`` are added to it; what was judged before stays as it is.
    """
    spark = docs.sparkSession
    docs, parts = keyed(columns(docs, doc_id=doc_id, text=text)), []
    own = index or FingerprintIndex(spark, new_path(spark, "substring-index"), documents=False)
    past = own.history()
    if past is not None:  # as it is now: what follows adds to it
        past = tuple(materialise(x, "substring-history") for x in past)
    for i in range(batches):
        batch = docs.where(F.pmod("k", F.lit(batches)) == i)
        parts.append(anchors(batch))
        own.add(parts[-1], batch)
    seen = parts[0]
    for x in parts[1:]:
        seen = seen.unionByName(x)
    each = seen.select("k", F.explode(F.array_distinct("fp")).alias("fp"))
    known = each.join(own.repeated(), "fp").groupBy("k").agg(F.collect_set(F.when(~F.col("mixed"), F.col("fp"))).alias("one"), F.collect_set(F.when(F.col("mixed"), F.col("fp"))).alias("some"))
    verdict = first_verdict(docs, known)
    if index is None:
        own.close()
    rest = verdict.where("sha IS NULL")
    # the arrays have an entry for each place, so a window that repeats inside one text counts twice
    places = rest.select(F.explode(F.arrays_zip("window", "digest")).alias("x"))
    if past is not None:
        open_ = rest.select(F.explode("some").alias("fp")).distinct()
        old = past[0].select("k", F.explode(F.array_distinct("fp")).alias("fp")).join(open_, "fp").groupBy("k").agg(F.collect_set("fp").alias("some"))
        # one text for each key: rows that share a key are equal
        places = places.unionByName(windows_of(past[1], old).select(F.explode(F.arrays_zip("window", "digest")).alias("x")))
    repeated = places.select("x.window", "x.digest").groupBy("window", "digest").count().where("count > 1").drop("count")
    window = rest.select("k", F.explode(F.arrays_zip("window", "digest")).alias("x")).select("k", "x.window", "x.digest").distinct()
    again = window.join(repeated, ["window", "digest"]).groupBy("k").agg(F.collect_list(F.struct("window", "digest")).alias("again"))
    open_ = rest.drop("digest").join(again, "k", "left").select("doc_id", "n_words", "text", "sure", "open", F.col("again.window").alias("again"), F.col("again.digest").alias("digest"))
    done = verdict.where("sha IS NOT NULL").select("doc_id", "n_words", "n_removed", "sha")
    return done.unionByName(last_verdict(open_)).select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
