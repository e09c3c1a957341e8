"""Exact duplicates through compressed radix tries.

Every task of the scan inserts its texts (A-Z lower-cased, full bytes) into a trie; a terminal node keeps the owner
(the extreme doc_id) and how many rows it stands for, so a text that fills a third of the table leaves each task once.
These records are dealt by length and content hash, sorted, and inserted again; since all records of a text come
together, every subtree is complete between two hashes, and subtrees are given out and freed one by one whenever the
trie outgrows its budget. Finally each row joins its class by hash. Only classes with copies are joined, and the join
splits a hot class on the rows' side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, ascii_lower, carried, columns, give_back, map_rows, slices, unpacked

#: Key bytes that one task's trie may hold before subtrees leave it.
TRIE_BYTES = 16 << 20
#: Rows, and bytes of them, that a task holds beside it before it hands on those that own their texts.
TRIE_ROWS, HELD_BYTES = 1 << 14, 32 << 20


class Node:
    __slots__ = ("children", "count", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count = label, {}, None, 0


class Trie:
    """Patricia trie over byte strings: an edge holds as many bytes as no key branches in.

    ``largest`` decides which doc_id owns a text; a null doc_id owns one only if there is no other.
    """

    def __init__(self, largest: bool = True):
        self.root, self.bytes, self.best = Node(b""), 0, (max if largest else min)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            if a[low:middle] == b[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = self._common(child.label, key[at : at + len(child.label)])
                upper = node.children[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                self.bytes += 200
                node, at = upper, at + n
        node.count += count
        if owner is not None:
            node.owner = owner if node.owner is None else self.best(node.owner, owner)

    def terminals(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(top or self.root, before)]
        while todo:
            node, prefix = todo.pop()
            key = prefix + node.label
            if node.count:
                yield key, node.owner, node.count
            todo += [(x, key) for x in node.children.values()]

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Give out and free the root's key and then its subtrees, one after the other."""
        if self.root.count:
            yield b"", self.root.owner, self.root.count
            self.root.count, self.root.owner = 0, None
        for first in list(self.root.children):
            yield from self.terminals(self.root.children.pop(first))
        self.bytes = 0


def normal(raw: bytes) -> bytes:
    """A-Z lower-cased; ``bytes.lower`` leaves other characters alone."""
    return raw.lower()


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _records(found: list[tuple[bytes, int | None, int]]) -> dict[str, list]:
    return {"n_bytes": [len(k) for k, _, _ in found], "h": [digest(k) for k, _, _ in found], "text": [k for k, _, _ in found], "owner": [o for _, o, _ in found], "n": [n for _, _, n in found]}


def _chunks(found: Iterator[tuple[bytes, int | None, int]], limit: int = 8 << 20) -> Iterator[list]:
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[0]) + 40
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def classes(docs: DataFrame, largest: bool = True) -> DataFrame:
    """One row per distinct text: n_bytes, h (SHA-256), owner, n. ``docs`` has doc_id and text."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        trie = Trie(largest)
        for part in slices(batches):
            for i, raw in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                trie.insert(normal(raw), i)
            if trie.bytes > TRIE_BYTES:
                yield from map(_records, _chunks(trie.spill()))
        yield from map(_records, _chunks(trie.spill()))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        trie, at = Trie(largest), None
        narrow = lambda found: {k: v for k, v in _records(found).items() if k != "text"}
        for part in slices(batches):
            for n_bytes, h, raw, owner, n in zip(*(part.column(k).to_pylist() for k in ("n_bytes", "h", "text", "owner", "n")), strict=True):
                if (n_bytes, h) != at:  # sorted by length and hash: every subtree is complete
                    if trie.bytes > TRIE_BYTES:
                        yield from map(narrow, _chunks(trie.spill()))
                    at = n_bytes, h
                trie.insert(raw, owner, n)
        yield from map(narrow, _chunks(trie.spill()))

    partial = map_rows(docs, "n_bytes long, h binary, text binary, owner long, n long", first)
    dealt = partial.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h")
    return map_rows(dealt, "n_bytes long, h binary, owner long, n long", second)


def digests(docs: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches):
            yield {"doc_id": part.column("doc_id"), "h": [digest(normal(x)) for x in as_bytes(part.column("text"))]}

    return map_rows(docs, "doc_id long, h binary", task)


def exact_duplicates(docs: DataFrame, largest: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of the rows of one text, that with the largest (or smallest) doc_id stays; rows
    that repeat a doc_id and its text are ties of which exactly one stays; a null doc_id stays only where the whole
    class has none, and keep_id is then null. Empty table: no rows. Other columns are ignored.
    """
    docs = columns(docs, doc_id=doc_id, text=text)
    # rows that agree in id and text become one with a multiplicity, so that a tie keeps exactly one of them
    rows = digests(docs).groupBy("doc_id", "h").agg(F.count("*").alias("m"))
    copied = classes(docs, largest).where("n > 1").select("h", "owner", "n")
    out = rows.join(copied, "h", "left").withColumn("size", F.coalesce("n", F.lit(1)).cast("long"))
    out = out.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("owner")))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), ((F.col("i") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("h")).alias("text_sha256"))


def keep_one(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows tied in doc_id and text any one.

    A row crosses the network once, whole, and only if no other row of its task owns its text. Nulls and empty tables
    as in ``exact_duplicates``.
    """

    def owners(batches: Iterator[pa.RecordBatch], complete: bool) -> Iterator[pa.RecordBatch]:
        """Of each text the row that owns it. ``complete``: rows come sorted by hash, and all rows of a text come here."""
        trie, held, before, size = Trie(), [], 0, 0

        def put(part: pa.RecordBatch) -> None:
            nonlocal before, size
            ids, texts = (pc.struct_field(part.column("row"), i) for i in places)
            for i, (doc, raw) in enumerate(zip(ids.to_pylist(), as_bytes(texts), strict=True)):
                # a null owns a text only if there is no other
                trie.insert(normal(raw), (doc is not None, (doc or 0) if largest else -(doc or 0), before + i))
            held.append(part)
            before += part.num_rows
            size += part.nbytes

        def leave() -> list[pa.RecordBatch]:
            """The owners; subtree by subtree, then in the order in which the rows came."""
            nonlocal trie, held, before, size
            stay, start, out = np.sort(np.array([owner[2] for _, owner, _ in trie.spill()], np.int64)), 0, []
            for part in held:
                mine = stay[(stay >= start) & (stay < start + part.num_rows)] - start
                start += part.num_rows
                if len(mine):
                    out.append(part.take(pa.array(mine)))
            trie, held, before, size = Trie(), [], 0, 0
            return out

        for part in slices(batches, "n_bytes"):
            if trie.bytes > TRIE_BYTES or before > TRIE_ROWS or size > HELD_BYTES:
                for found in leave():
                    # the text that was being read may go on
                    open_ = pc.equal(found.column("h"), part.column("h")[0]) if complete else pa.array([False] * found.num_rows)
                    yield found.filter(pc.invert(open_))
                    if pc.any(open_).as_py():
                        put(found.filter(open_))
            put(part)
        yield from leave()
        give_back()

    text = F.coalesce(docs["text"], F.lit(""))
    places = [[docs.columns.index("doc_id")], [docs.columns.index("text")]]
    body = carried(docs, n_bytes=F.octet_length(text).cast("long"), h=F.unhex(F.sha2(ascii_lower(text), 256)))
    partial = body.mapInArrow(lambda batches: owners(batches, False), body.schema)
    dealt = partial.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h")
    return unpacked(dealt.mapInArrow(lambda batches: owners(batches, True), body.schema).select("row"), docs)
