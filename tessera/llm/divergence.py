"""Source divergence audit: how far the word shares of each source lie from every other source of its language, and which
terms set it apart from the language as a whole.

Groups are (language, source). Their counts over a language's kept terms are packed, one vector for each group and chunk
of the vocabulary. The groups of a language fall into blocks; a vector is replicated to the tiles (block x block) that
its block takes part in, and a task adds up the submatrix of its tile over successive chunks. Long vocabularies are dealt
in spans of chunks as well, whose submatrices are summed. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, columns, forget_other_stages, give_back, map_rows, materialise, slices

#: Documents of its language that a term needs; pseudo-count; shares are in parts of so many; terms reported for a group.
LEAST_DOCS, PSEUDO, PARTS, TERMS = 30, 5, 1_000_000_000, 50
#: Groups of a block, terms of a chunk (about), chunks of a span.
BLOCK, CHUNK, SPAN = 32, 4096, 8
#: Different (group, term) keys that a task counts before it hands them on.
KEYS = 300_000

#: Bytes of UTF-8: A-Z become lower case, other letters and all bytes beyond ASCII stay, the rest becomes a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[dict[str, list]]:
        for (lang, source), (n, docs) in held.items():
            k = len(docs)
            same = lambda x, k=k: pa.DictionaryArray.from_arrays(pa.array(np.zeros(k, np.int32)), pa.array([x])).dictionary_decode()
            yield {"lang": same(lang), "source": same(source), "term": pa.array(docs.keys(), pa.binary()).cast(pa.string()), "n": [n[t] for t in docs], "docs": list(docs.values())}
        held.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
            if (lang, source) not in held:
                held[lang, source] = (Counter(), Counter())
            n, docs = held[lang, source]
            terms = text.encode().translate(_TERMS).split()
            n.update(terms)
            docs.update(set(terms))
            docs[b""] += 1  # the group itself; no term is empty
        if sum(len(d) for _, d in held.values()) > KEYS:
            yield from handed_on()
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs; the empty term stands for the group and counts its documents."""
    texts = columns(docs, lang="lang", source="source", text="text").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = map_rows(texts, "lang string, source string, term string, n long, docs long", _counted)
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + 5) / (total + 5 * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = (wide(count) + PSEUDO).cast("decimal(21,0)") * F.lit(PARTS).cast("decimal(10,0)"), wide(total) + wide(terms) * PSEUDO
    # div of decimals gives a whole number (long); a share is at most PARTS
    return F.call_function("div", top, bottom) + 1


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one tile and span come together, sorted by chunk; a chunk's vectors make two dense matrices at a time."""
    forget_other_stages()
    schema = arrow_schema("lang string, source string, item string, value long")
    tile, sums, names = None, {}, {}

    def given_out() -> Iterator[pa.RecordBatch]:
        lang, first, second, _ = tile
        a, b = sorted(x for x, block in names.items() if block == first), sorted(x for x, block in names.items() if block == second)
        out = ([], [], [])
        for x in a:
            for y in b:
                if x != y and (first != second or x < y):
                    value = sums.get((x, y), 0)
                    for part, got in zip(out, (((x, y), (y, x), (value, value))), strict=True):
                        part.extend(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], schema=schema)

    def add(chunk: list[tuple]) -> None:
        _, first, second, _ = tile
        width = chunk[0][2]
        for source, block, *_ in chunk:
            names[source] = block
        if not width:
            return
        dense = {}
        for source, _, _, rest, slots, shares in chunk:
            v = np.full(width, rest, np.int64)
            v[np.asarray(slots, np.int64)] = shares
            dense[source] = v
        rows = sorted(x for x in dense if names[x] == first)
        others = sorted(x for x in dense if names[x] == second)
        if not rows or not others:
            return
        matrix = np.stack([dense[y] for y in others])
        for x in rows:
            for y, value in zip(others, np.abs(matrix - dense[x]).sum(axis=1).tolist(), strict=True):
                sums[x, y] = sums.get((x, y), 0) + value

    chunk, at = [], None
    for batch in batches:
        for lang, first, second, span, number, source, block, width, rest, slots, shares in zip(*[batch.column(c).to_pylist() for c in ("lang", "first", "second", "span", "chunk", "source", "block", "width", "rest", "slots", "shares")], strict=True):
            here = (lang, first, second, span)
            if here != tile or number != at:
                if chunk:
                    add(chunk)
                if here != tile:
                    if tile:
                        yield from given_out()
                    tile, sums, names = here, {}, {}
                chunk, at = [], number
            chunk.append((source, block, width, rest, slots, shares))
    if chunk:
        add(chunk)
        yield from given_out()
    give_back()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the language (``pair``), the setting-apart terms (``term``).

    Null texts, languages and sources count as empty; repeated rows count each; a group without terms takes part, and a
    language without kept terms gives pairs of value 0.
    """
    counts = materialise(term_counts(docs), "divergence-counts")
    totals = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    per_lang = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    langs = counts.where("term = ''").groupBy("lang").agg(F.count("*").alias("groups")).join(per_lang, "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.ceil(F.col("groups") / block).cast("int").alias("blocks"), F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / chunk), F.lit(1)).cast("int").alias("chunks"))
    langs = materialise(langs, "divergence-languages")
    # a term's chunk and its place there
    kept = totals.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    kept = kept.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = materialise(kept.select("lang", "term", "chunk", "slot", "all_n"), "divergence-terms")
    widths = kept.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    mine = materialise(counts.where("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-kept")
    groups = counts.where("term = ''").select("lang", "source").join(mine.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "v", "lang_total", "blocks", "chunks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    groups = materialise(groups, "divergence-groups")

    shares = mine.join(groups, ["lang", "source"]).select("lang", "source", "term", "chunk", "slot", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("all_n"), F.col("lang_total"), F.col("v")).alias("q"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERMS)

    # at most `chunk` terms (about) in a list
    packed = shares.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("slot", "p"))).alias("x")).select("lang", "source", "chunk", F.col("x.slot").alias("slots"), F.col("x.p").alias("shares"))
    each = groups.select("lang", "source", "block", "blocks", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(0).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    each = each.join(packed, ["lang", "source", "chunk"], "left").join(widths, ["lang", "chunk"], "left")
    none = F.array().cast("array<long>")
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("first"), F.greatest(other, F.col("block")).alias("second")))
    tiles = each.select("lang", "source", "block", "chunk", F.floor(F.col("chunk") / span).cast("int").alias("span"), F.coalesce("width", F.lit(0)).alias("width"), "rest", F.coalesce(F.col("slots").cast("array<long>"), none).alias("slots"), F.coalesce("shares", none).alias("shares"), F.explode(tile).alias("t"))
    tiles = tiles.select("lang", "t.first", "t.second", "span", "chunk", "source", "block", "width", "rest", "slots", "shares")
    pairs = tiles.repartition("lang", "first", "second", "span").sortWithinPartitions("lang", "first", "second", "span", "chunk").mapInArrow(_tiled, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
