"""Spelling variants: words at one inserted, deleted or replaced letter, found through halves of words.

A word is cut into two segments. One edit leaves one of them as it is, so of two near words the one's first segment
begins the other, or its last segment ends it. Automaton shards hold the segments (each marked with the end of the word
that it must lie at) and every word is scanned by the shards that can hold a segment of a near word: those of its own
beginnings and ends of the three lengths that fit. A hit gives the segment's words; what remains of them beside the
segment is looked up with one letter left out, so a segment that thousands of words share costs no pairs. Lengths and
the distance are verified at last. Segments that more than ``HOT`` words share are dealt by what remains, with one
letter left out, as well. Only sums leave a shard: one row for each word and shard, never the pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, columns, forget_other_stages, give_back, map_rows, materialise, slices

#: One in so many (document, word) pairs loses a letter.
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Segments of one automaton shard, about; words that share a segment up to which it is dealt whole.
SHARD, HOT = 10_000, 20_000
#: Different words that a task counts before it hands them on.
KEYS = 300_000

#: Latin-1 bytes: letters A-Z become lower case, other letters stay, all else (also what Latin-1 lacks, as "?") becomes a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    total: Counter = Counter()

    def handed_on() -> dict[str, list]:
        out = {"word": [w.decode("latin-1") for w in total], "n": list(total.values())}
        total.clear()
        return out

    for batch in slices(batches):
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                size = len(word)
                if size < LEAST_LENGTH:
                    continue
                h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                if h % DAMAGED == 0:
                    at = h % size
                    word = word[:at] + word[at + 1 :]
                    if size == LEAST_LENGTH:
                        continue
                total[word] += n
        if len(total) > KEYS:
            yield handed_on()
    yield handed_on()


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that occur often enough, after the contract's damage."""
    counts = map_rows(columns(docs, doc_id="doc_id", text="text"), "word string, n long", _counted)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- one shard -------------------------------------------------------------------------------------------------------


def _segments(word: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """The marked segments of a word, each with what remains beside it."""
    half = len(word) // 2
    return ("^" + word[:half], word[half:]), (word[half:] + "$", word[:half])


def _without_one(rest: str) -> set[str]:
    """What remains, whole and with each single letter left out: the rests of near words share one of these."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


def near(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:]


class Found:
    """Near words of each word of a shard: how many, and the best (largest n, ties to the smaller word)."""

    def __init__(self):
        self.of: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        have = self.of.get(word)
        if have is None:
            self.of[word] = [1, n, other]
        else:
            have[0] += 1
            if (n, have[2]) > (have[1], other):
                have[1:] = n, other


def _meets_first(word: str, other: str, at_front: bool) -> bool:
    """Of two places where a pair meets, only the front one counts."""
    return at_front or not word.startswith(other[: len(other) // 2])


def _match(words: dict[str, int], mine, found: Found) -> None:
    """Scan ``words`` with an automaton over those of their segments that are this shard's (``mine``)."""
    held: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for word in words:
        for segment, rest in _segments(word):
            if mine(segment):
                by_rest = held[segment]
                for x in _without_one(rest):
                    by_rest[x].append(word)
    if not held:
        return
    automaton = ahocorasick.Automaton()
    for segment in held:
        automaton.add_word(segment, segment)
    automaton.make_automaton()
    for word in words:
        size = len(word)
        for _, segment in automaton.iter(f"^{word}$"):
            front, long = segment[0] == "^", len(segment) - 1
            if not (size - 1) // 2 <= (long if front else size - long) <= (size + 1) // 2 + 1:
                continue  # no word of a fitting length has a segment of this length
            rest, by_rest = (word[long:] if front else word[: size - long]), held[segment]
            seen = set()
            for x in _without_one(rest):
                for other in by_rest.get(x, ()):
                    if other not in seen:
                        seen.add(other)
                        if near(word, other) and _meets_first(word, other, front):
                            found.add(word, other, words[other])


def _match_dealt(segment: str, left: str, words: dict[str, int], found: Found) -> None:
    """Words that share a hot segment (as a pattern's or by place) and ``left``, a rest with one letter left out."""
    front, long = segment[0] == "^", len(segment) - 1
    rest = {w: w[long:] if front else w[: len(w) - long] for w in words}
    patterns = [w for w in words if segment in (s for s, _ in _segments(w))]
    for other in patterns:
        for word in words:
            if near(word, other) and _meets_first(word, other, front) and min(_without_one(rest[word]) & _without_one(rest[other])) == left:
                found.add(word, other, words[other])


# --- the job ---------------------------------------------------------------------------------------------------------


def _keys(word: Column) -> Column:
    """The marked segments under which a word meets near words: beginnings and ends of the lengths that theirs have."""
    size = F.char_length(word)
    sizes = F.array(size - 1, size, size + 1)
    fronts = F.transform(F.array_distinct(F.transform(sizes, lambda m: F.floor(m / 2).cast("int"))), lambda k: F.concat(F.lit("^"), F.substring(word, F.lit(1), k)))
    backs = F.transform(F.array_distinct(F.transform(sizes, lambda m: (m - F.floor(m / 2)).cast("int"))), lambda k: F.concat(F.substring(word, size - k + 1, k), F.lit("$")))
    return F.concat(fronts, backs)


def _own_segments(word: Column) -> Column:
    half = F.floor(F.char_length(word) / 2).cast("int")
    return F.array(F.concat(F.lit("^"), F.substring(word, F.lit(1), half)), F.concat(F.substring(word, half + 1, F.char_length(word)), F.lit("$")))


def _shard(segment: Column, shards: int) -> Column:
    return F.pmod(F.crc32(segment), F.lit(shards)).cast("int")


def _shard_of(segment: str, shards: int) -> int:
    return zlib.crc32(segment.encode()) % shards


def near_words(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, n_near, best, best_n of the words that have a near one. ``words``: word, n, each word once."""
    spark = words.sparkSession
    total = words.count()
    shards = max(1, -(-2 * total // shard))
    segments = words.select(F.explode(_own_segments(F.col("word"))).alias("segment")).groupBy("segment").agg(F.count("*").alias("c"))
    crowded = sorted(r.segment for r in segments.where(F.col("c") > hot).collect())  # at most 2 * total / hot segments
    sent = spark.sparkContext.broadcast(frozenset(crowded))
    listed = F.array(*map(F.lit, crowded)).cast("array<string>")
    schema = "word string, n_near long, best string, best_n long"

    def rows(found: Found) -> pa.RecordBatch:
        got = found.of
        return pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.string()), pa.array([x[0] for x in got.values()], pa.int64()), pa.array([x[2] for x in got.values()], pa.string()), pa.array([x[1] for x in got.values()], pa.int64())], schema=arrow_schema(schema))

    def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, dict[str, int]]]:
        """Runs of equal keys; the rows come sorted by them."""
        now, held = None, {}
        for batch in batches:
            for *k, word, n in zip(*[batch.column(c).to_pylist() for c in [*key, "word", "n"]], strict=True):
                if k != now:
                    if held:
                        yield now, held
                    now, held = k, {}
                held[word] = n
        if held:
            yield now, held

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for (k,), held in groups(batches, ["shard"]):
            found = Found()
            _match(held, lambda s, k=k: s not in sent.value and _shard_of(s, shards) == k, found)
            yield rows(found)
        give_back()

    cold = words.select(F.explode(F.array_distinct(F.transform(F.filter(_keys(F.col("word")), lambda s: ~F.array_contains(listed, s)) if crowded else _keys(F.col("word")), lambda s: _shard(s, shards)))).alias("shard"), "word", "n")
    out = cold.repartition(max(shards, 2), "shard").sortWithinPartitions("shard").mapInArrow(whole, schema)
    if crowded:

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_other_stages()
            for (segment, left), held in groups(batches, ["segment", "left"]):
                found = Found()
                _match_dealt(segment, left, held, found)
                yield rows(found)
            give_back()

        word, segment = F.col("word"), F.col("segment")
        rest = F.when(segment.startswith("^"), F.substring(word, F.length(segment), F.length(word))).otherwise(F.substring(word, F.lit(1), F.length(word) - F.length(segment) + 1))
        shorter = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest"))))
        hot_rows = words.select("word", "n", F.explode(F.filter(_keys(word), lambda s: F.array_contains(listed, s))).alias("segment")).select("word", "n", "segment", rest.alias("rest"))
        hot_rows = hot_rows.select("word", "n", "segment", F.explode(F.array_distinct(F.concat(F.array("rest"), shorter))).alias("left"))
        out = out.union(hot_rows.repartition("segment", "left").sortWithinPartitions("segment", "left").mapInArrow(dealt, schema))
    # of the best words that shards found, the one of largest n, ties to the smaller word
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` (word, form; both once a row) ends.

    A form is at least five times as frequent as its word, so a chain of counts below 2^63 has at most 27 links, and five
    doublings of the pointers reach its end.
    """
    links = materialise(forms.select("word", F.col("form").alias("root")), "spelling-links")
    for _ in range(5):
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        if not links.join(onward, links["root"] == onward["at"], "left_semi").limit(1).count():
            break
        links = materialise(links.join(onward, links["root"] == onward["at"], "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-links")
    return links


def variants(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of six letters or more with five occurrences or more.

    A null text has no words; a row without an id counts as one with an empty id; repeated rows count each.
    """
    words = materialise(word_counts(docs), "spelling-words")
    nearest = near_words(words, shard, hot)
    have = words.join(nearest, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best")).alias("form"), "best_n")
    have = materialise(have.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("best_n"))), "spelling-forms")
    roots = rooted(have.where("form IS NOT NULL"))
    return have.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
