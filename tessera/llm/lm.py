"""Scores of whole texts under a unigram base and a log-bilinear model trained by noise-contrastive estimation.

Counts: every training token is counted (words by a 64-bit hash; two words would have to share one to be confused).
Words with high counts, at most HEAD of them, travel to the tasks; all rarer ones are looked up by a join on the hash.

Model: a token is predicted in two steps, its group and then itself in the group. Words are grouped by their endings,
so a word of any rarity has a group; the MODEL most frequent words have parameters of their own, the others of a group
share one place in it. The prediction from the two tokens before is C1 * r(first) + C2 * r(second) (element by
element), and a score its product with an output vector plus a bias, for groups and for words alike. A word without
parameters of its own gets its smoothed share of its group's common place, so a text's score is a proper log
probability over all words, with one place for the unseen words of each group.

Training: rows are dealt by a hash into shards of about SHARD tokens, and shards into ROUNDS. In a round each shard
is one pass of mini-batches (Adagrad) from the parameters of the round before; then the parameters of its shards are
averaged, weighted by tokens, in one aggregation whose rows are the parameter rows. Which rows meet in a shard, and in
which order, follows from the table alone, so scores do not depend on its partitions.
Scores are normalised in full, by batched matrix products over all groups and over all words of a token's group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns, map_rows, materialise, slices
from tessera.llm.language import fold

#: Words whose counts travel to the tasks, at most. The result does not depend on it: other counts are joined.
HEAD = 1 << 18
#: Words with parameters of their own, and groups of words.
MODEL, GROUPS = 1 << 14, 256
#: Bytes of a word's end that decide its group.
ENDING = 3
DIMENSIONS = 16
CONTEXT = 2
BATCH = 4096
#: Rows of scores that are normalised at a time; they stay in a processor's cache.
ROWS = 1024
#: Marks between 0 and 1 (a power of two) from which the noise words that were drawn are looked for.
GUIDE = 1 << 16
#: Noise groups of a batch, and noise words of a token.
NOISE, NOISE_WORDS = 32, 2
RATE, LEAST_SQUARE = 0.05, 1.0
ROUNDS, SHARD = 4, 2_000_000
#: Endings of words that are remembered with their groups.
REMEMBERED = 300_000
#: Distinct words that a counting task holds before it hands partial counts on.
HELD = 200_000
#: Text bytes that are read into arrays at a time.
READ_BYTES = 3 << 20
END = xxhash.xxh64_intdigest(b"\n", 11) - (1 << 63)


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash; no word has the white space that stands for the end of a text."""
    return xxhash.xxh64_intdigest(word, 11) - (1 << 63)


def group_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-ENDING:], 12) % GROUPS


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Lower-cased words of texts (null: none): of each its place among the distinct ones, these, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    there = pc.binary_length(words).to_numpy() > 0  # nothing stands before white space that begins a text, and after white space that ends it
    if not there.all():
        kept, ends = np.append(0, np.cumsum(there)), np.cumsum(n)
        words, n = words.filter(pa.array(there)), kept[ends] - kept[ends - n]
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), n


def count_tokens(texts: DataFrame) -> DataFrame:
    """From (text) to h, c, g: how often each token occurs, ends included, and its group; written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counts: Counter[bytes] = Counter()
        ends = 0
        out = lambda: {"h": [word_hash(w) for w in counts], "c": list(counts.values()), "g": [group_of(w) for w in counts]}
        for part in slices(batches):
            ends += part.num_rows
            own, words, _ = words_of(part.column("text"))
            for w, c in zip(words, np.bincount(own, minlength=len(words)).tolist(), strict=True):
                counts[w] += c
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()
        if ends:
            yield {"h": [END], "c": [ends], "g": [group_of(b"\n")]}

    return materialise(map_rows(texts, "h long, c long, g int", task).groupBy("h").agg(F.sum("c").alias("c"), F.min("g").alias("g")), "lm-counts")


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), counts and groups of all words from some count on, as many classes of counts as fit into ``most``."""
    cell = F.floor(F.log2("c") * 8).cast("int")
    cells = sorted(counts.groupBy(cell.alias("cell")).count().collect(), reverse=True)  # at most 8 * 64 rows
    total, lowest = 0, None
    for r in cells:
        if total + r["count"] > most:
            break
        total, lowest = total + r["count"], r["cell"]
    if lowest is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.where(cell >= lowest).toPandas().sort_values("h")
    return tuple(table[c].to_numpy(np.int64) for c in "hcg")


class Vocabulary:
    """What tasks know of words: the head's counts, and model numbers.

    Numbers go by group: of each group its words with parameters of their own, then the common place of all others.
    ``first`` has where each group begins. ``pad`` stands before a text's beginning, and is no output.
    """

    def __init__(self, h: np.ndarray, c: np.ndarray, g: np.ndarray, totals: np.ndarray, model: int = MODEL):
        """``totals``: tokens of each group."""
        self.h, self.c = h, c
        chosen = np.lexsort((h, -c))[:model]
        chosen = chosen[np.lexsort((h[chosen], -c[chosen], g[chosen]))]
        sizes = np.bincount(g[chosen], minlength=GROUPS) + 1
        self.first = np.append(0, np.cumsum(sizes))
        self.rest = self.first[1:] - 1
        self.pad = self.outputs = int(self.first[-1])
        self.group = np.repeat(np.arange(GROUPS), sizes)
        own = np.ones(self.outputs, bool)
        own[self.rest] = False
        self.number = np.full(len(h), -1, np.int64)  # -1: the common place of its group
        self.number[chosen] = np.flatnonzero(own)
        self.count = np.zeros(self.outputs)
        self.count[own] = c[chosen]
        modelled = np.bincount(self.group[own], self.count[own], GROUPS)
        self.count[self.rest] = totals - modelled


class Reader:
    """Texts to numbers. Each distinct word of some texts is looked up once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.groups: dict[bytes, int] = {}  # of endings

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place in the head (-1: not there) and model number of each word."""
        v, digest = self.v, xxhash.xxh64_intdigest
        h = (np.array([digest(w, 11) for w in words], np.uint64) ^ np.uint64(1 << 63)).view(np.int64)  # word_hash
        at, number = np.full(len(h), -1), np.full(len(h), -1)
        if len(v.h):
            near = np.minimum(np.searchsorted(v.h, h), len(v.h) - 1)
            found = v.h[near] == h
            at[found], number[found] = near[found], v.number[near[found]]
        other = np.flatnonzero(number < 0)
        endings = [words[i][-ENDING:] for i in other.tolist()]
        if len(self.groups) > REMEMBERED:
            self.groups.clear()
        for x in set(endings).difference(self.groups):
            self.groups[x] = group_of(x)
        number[other] = v.rest[[self.groups[x] for x in endings]]
        return h, at, number

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens, ends included, which distinct one each is; the distinct ones' hashes, places in the head and model numbers; where each text begins."""
        place, words, n = words_of(texts)
        n += 1
        first = np.cumsum(n) - n
        own = np.full(int(n.sum()), len(words))
        word = np.ones(len(own), bool)
        word[first + n - 1] = False
        own[word] = place
        return own, *self.look_up([*words, b"\n"]), first  # no word has the white space that stands for the end of a text

    def contexts(self, number: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The tokens before each token, nearest first; ``pad`` before a text's beginning."""
        found, begins = [], np.zeros(len(number), bool)
        begins[first] = True
        before, outside = number, np.zeros(len(number), bool)
        for _ in range(CONTEXT):
            outside = begins | np.append(True, outside[:-1])
            before = np.where(outside, self.v.pad, np.append(self.v.pad, before[:-1]))
            found.append(before)
        return found


class LogBilinear:
    """Parameters as one matrix: rows of groups and of words with their biases, context rows, and the element-wise context maps."""

    def __init__(self, v: Vocabulary, seed: int = 5):
        self.v = v
        count = v.count + 0.5
        self.words = count / count.sum()
        self.groups = np.add.reduceat(self.words, v.first[:-1])
        self.inside = self.words / self.groups[v.group]
        self.ladder = np.append(0, np.cumsum(self.words))
        self.guide = np.searchsorted(self.ladder, np.arange(GUIDE + 2) / GUIDE, "right") - 1  # the last rung that is not above each mark
        self.strides = [1 << i for i in reversed(range(int(np.diff(self.guide).max()).bit_length()))]  # their sum reaches from any mark to the next
        self.rungs = np.append(self.ladder, np.full(2 * max([1, *self.strides]), np.inf))
        self.log_inside = np.log(NOISE_WORDS * self.inside).astype(np.float32)
        self.log_noise = np.log(NOISE * self.groups).astype(np.float32)
        self.cuts = np.cumsum([GROUPS, v.outputs, v.outputs + 1])
        rng = np.random.default_rng(seed)
        self.matrix = (rng.standard_normal((int(self.cuts[-1]) + CONTEXT, DIMENSIONS + 1)) * 0.1).astype(np.float32)
        groups, words, rows, maps = self.views(self.matrix)
        groups[:, -1], words[:, -1], rows[:, -1], maps[:, :-1] = np.log(self.groups), np.log(self.inside), 0, 1 / CONTEXT
        self.squares = np.full_like(self.matrix, LEAST_SQUARE)
        self.changed, self.place = np.zeros(len(self.matrix), bool), np.empty(len(self.matrix), np.int64)
        self.held: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is written anew each time: memory from the system would have to be cleared each time."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)

    def rows_of(self, name: str, matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(matrix, at, axis=0, out=self.room(name, len(at), matrix.shape[1]), mode="clip")

    def views(self, m: np.ndarray) -> list[np.ndarray]:
        """Rows of groups, words and contexts (one more than words), and the maps; the last column is the bias."""
        return np.split(m, self.cuts)

    def drawn_words(self, g: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """NOISE_WORDS words for each token, each from the token's group by its share there."""
        first, after = self.v.first.take(g), self.v.first.take(g + 1)
        low = self.ladder.take(first)
        drawn = low + rng.random((NOISE_WORDS, len(g))) * (self.ladder.take(after) - low)
        at = self.guide.take((drawn * GUIDE).astype(np.int64), mode="clip")
        for stride in self.strides:  # the last rung that is not above what was drawn
            at += stride * (self.rungs.take(at + stride) <= drawn)
        return np.clip(at, first, after - 1)

    def step(self, token: np.ndarray, contexts: list[np.ndarray], rng: np.random.Generator) -> None:
        """One Adagrad step on the noise-contrastive losses of a batch, for its groups (noise shared by the batch) and for its words in their groups."""
        groups, words, rows, maps = self.views(self.matrix)
        n, g = len(token), self.v.group.take(token)
        r = [self.rows_of(f"context {i}", rows, x) for i, x in enumerate(contexts)]
        h, back, part = (self.room(x, n, DIMENSIONS + 1) for x in ("h", "back", "part"))
        np.multiply(r[0], maps[0], out=h)
        for i in range(1, CONTEXT):
            np.multiply(r[i], maps[i], out=part)
            h += part
        h[:, -1] = 1
        # the rows of the matrix that change, and their gradients by column: groups and noise, the token and noise words, contexts, maps
        many = (2 + NOISE_WORDS + CONTEXT) * n + NOISE + CONTEXT
        at, grads, done = np.empty(many, np.int64), self.room("gradients", DIMENSIONS + 1, many), 0
        across = self.room("across", DIMENSIONS + 1, n)
        across[:] = h.T

        def more(x: np.ndarray, start: int) -> np.ndarray:
            nonlocal done
            a, done = done, done + len(x)
            np.add(x, start, out=at[a:done])
            return grads[:, a:done]

        with np.errstate(over="ignore"):
            noise = rng.choice(GROUPS, NOISE, p=self.groups)
            chosen, unlike = self.rows_of("part", groups, g), groups[noise]
            d_up = -1 / (1 + np.exp(np.einsum("nd,nd->n", h, chosen) - self.log_noise.take(g)))
            d_down = np.matmul(h, unlike.T, out=self.room("noise", n, NOISE))
            np.subtract(self.log_noise[noise], d_down, out=d_down)
            np.exp(d_down, out=d_down)
            d_down += 1
            np.reciprocal(d_down, out=d_down)
            np.matmul(d_down, unlike, out=back)
            chosen *= d_up[:, None]
            back += chosen
            np.multiply(d_up, across, out=more(g, 0))
            more(noise, 0)[:] = np.matmul(d_down.T, h).T
            for x, sign in [(token, 1), *((o, -1) for o in self.drawn_words(g, rng))]:
                chosen = self.rows_of("part", words, x)
                u = np.einsum("nd,nd->n", h, chosen) - self.log_inside.take(x)
                d = -sign / (1 + np.exp(sign * u))
                chosen *= d[:, None]
                back += chosen
                np.multiply(d, across, out=more(x, int(self.cuts[0])))
        across[:] = back.T
        for i, x in enumerate(contexts):
            m = more(np.array([i]), int(self.cuts[2]))
            np.einsum("nd,nd->d", back, r[i], out=m[:, 0])
            down = more(x, int(self.cuts[1]))
            np.multiply(maps[i][:, None], across, out=down)
            m[-1], down[-1] = 0, 0
        self.changed[:] = False
        self.changed[at] = True
        rows_changed = np.flatnonzero(self.changed)
        self.place[rows_changed] = np.arange(len(rows_changed))
        place, at = self.place.take(at), rows_changed
        grad = np.empty((len(at), DIMENSIONS + 1), np.float32)
        for i, x in enumerate(grads):
            grad[:, i] = np.bincount(place, x, len(at))
        squares = self.squares.take(at, axis=0)
        squares += grad * grad
        self.squares[at] = squares
        np.sqrt(squares, out=squares)
        grad *= RATE
        grad /= squares
        self.matrix[at] = self.matrix.take(at, axis=0) - grad

    @staticmethod
    def log_sum(s: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of exp of each row; ``s`` is used up."""
        np.exp(s, out=s)
        return np.log(s @ np.ones(s.shape[1], np.float32))

    def log_sums(self, s: np.ndarray, reach: float) -> np.ndarray:
        """``log_sum`` where no score is beyond ``reach`` on either side: if that is too far for exp, each row is brought below its highest score."""
        if reach <= 60 or not s.size or max(s.max(), -s.min()) <= 60:
            return self.log_sum(s)
        top = s.max(axis=1)
        s -= top[:, None]
        return top + self.log_sum(s)

    def log_probabilities(self, token: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Normalised natural log probabilities: of a token's group among all groups, and of the token among all of its group.

        What stands before a token often stands before others as well: the sum over all groups is made once for each such context.
        """
        groups, words, rows, maps = self.views(self.matrix)
        g = self.v.group.take(token)
        key = contexts[0].astype(np.int64)
        for x in contexts[1:]:
            key = key * (self.v.pad + 1) + x
        order = np.argsort(key)
        begins = np.append(True, np.diff(key.take(order)) > 0)[: len(key)]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(begins) - 1
        one = order[begins]
        each, part = (self.room(x, len(one), DIMENSIONS + 1) for x in ("each", "part"))
        for i, x in enumerate(contexts):
            np.take(rows, x.take(one), axis=0, out=part if i else each, mode="clip")
            np.multiply(part if i else each, maps[i], out=part if i else each)
            if i:
                each += part
        each[:, -1] = 1
        # no score is beyond the product of the greatest lengths and the greatest bias
        length = lambda m: float(np.sqrt(np.einsum("nd,nd->n", m[:, :-1], m[:, :-1]).max(initial=0)))
        longest = length(each)
        reach = lambda m: longest * length(m) + float(np.abs(m[:, -1]).max())
        total, across, far = np.empty(len(one), np.float32), np.ascontiguousarray(groups.T), reach(groups)
        for i in range(0, len(one), ROWS):
            part = each[i : i + ROWS]
            total[i : i + ROWS] = self.log_sums(np.matmul(part, across, out=self.room("scores", len(part), GROUPS)), far)
        found = -total.take(which)
        order = np.argsort(g.astype(np.uint16), kind="stable")
        edge = np.searchsorted(g.take(order), np.arange(GROUPS + 1))
        which, inside = which.take(order), (token - self.v.first.take(g)).take(order)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            of = words[self.v.first[k] : self.v.first[k + 1]]
            far = reach(of)
            for i in range(edge[k], edge[k + 1], ROWS):
                to = min(i + ROWS, edge[k + 1])
                h = self.rows_of("h", each, which[i:to])
                more = h @ groups[k]
                if len(of) > 1:
                    s = np.matmul(h, of.T, out=self.room("scores", len(h), len(of)))
                    more += s[np.arange(len(s)), inside[i:to]]
                    more -= self.log_sums(s, far)
                found[order[i:to]] += more
        return found


def train(docs: DataFrame, shared, tokens: int) -> LogBilinear:
    """From (doc_id, text) of ``tokens`` tokens in all: ROUNDS rounds over different shards, each from the last average."""
    v, width = shared.value, DIMENSIONS + 1
    model = LogBilinear(v)
    many = ROUNDS * max(1, round(tokens / ROUNDS / SHARD))
    dealt = docs.withColumn("order", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod("order", F.lit(many)).cast("int"))
    ddl = "row int, tokens long, " + ", ".join(f"p{i} double" for i in range(width))
    spark = docs.sparkSession
    for number in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.matrix)  # as many rows as words with parameters of their own, twice

        def task(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[dict[str, list]]:
            reader, lbl, now, seen, rng = Reader(shared.value), LogBilinear(shared.value), None, 0, None
            held: list[np.ndarray] = []  # tokens of the shard, and what stands before them, that are no full batch yet

            def steps(least: int) -> None:
                nonlocal held
                while len(held[0]) >= least:
                    lbl.step(held[0][:BATCH], [x[:BATCH] for x in held[1:]], rng)
                    held = [x[BATCH:] for x in held]

            def done() -> Iterator[dict[str, list]]:
                if seen:
                    steps(1)
                    scaled = lbl.matrix.astype(np.float64) * seen
                    yield {"row": list(range(len(scaled))), "tokens": [seen] * len(scaled)} | {f"p{i}": scaled[:, i].tolist() for i in range(width)}

            for part in slices(batches, limit=READ_BYTES):
                shard = part.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if shard[a] != now:
                        yield from done()
                        now, seen, rng = int(shard[a]), 0, np.random.default_rng([7, number, int(shard[a])])
                        held = [np.zeros(0, np.int64)] * (1 + CONTEXT)
                        lbl.matrix, lbl.squares = start.value.copy(), np.full_like(start.value, LEAST_SQUARE)
                    own, _, _, number_of, first = reader.read(part.slice(a, b - a).column("text"))
                    token = number_of.take(own)
                    held = [np.append(x, y) for x, y in zip(held, [token, *reader.contexts(token, first)], strict=True)]
                    seen += len(token)
                    steps(BATCH)
            yield from done()

        rows = dealt.where(F.pmod("shard", F.lit(ROUNDS)) == number).repartition(many // ROUNDS, "shard").sortWithinPartitions("shard", "order", "doc_id", "text").select("shard", "text")
        sums = map_rows(rows, ddl, task).groupBy("row").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(width)], F.sum("tokens").alias("tokens")).toPandas().sort_values("row")
        if len(sums):
            model.matrix = (sums[[f"p{i}" for i in range(width)]].to_numpy(np.float64) / sums["tokens"].to_numpy()[:, None]).astype(np.float32)
        start.unpersist()
    return model


def score(docs: DataFrame, folds: int = 5, held: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows outside fold ``held`` (crc32 of doc_id as text; a null doc_id is in a training fold). A null
    text counts as empty and has one token, its end. Without training rows all counts are 0 and each token has the
    probability of an unseen one. Repeated rows count and score one by one; an empty table gives no rows; other
    columns are ignored. Scores are base-10 logarithms.
    """
    spark = docs.sparkSession
    docs = columns(docs, doc_id=doc_id, text=text)
    training = docs.where(fold(F.col("doc_id"), folds) != held)
    counts = count_tokens(training.select("text"))
    totals, types = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in counts.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect():  # at most GROUPS rows
        totals[r["g"]], types[r["g"]] = r["c"], r["types"]
    n, v = int(totals.sum()), int(types.sum())
    vocabulary = Vocabulary(*head_of(counts), totals)
    shared = spark.sparkContext.broadcast(vocabulary)  # at most HEAD words
    model = train(training, shared, n)
    trained = spark.sparkContext.broadcast(model)  # about 2 * MODEL * DIMENSIONS numbers
    # of each group: all types without parameters of their own, and one place for the unseen
    sizes = np.diff(vocabulary.first) - 1
    rest_mass = np.log10(vocabulary.count[vocabulary.rest] + 0.5 * (types - sizes + 1))
    whole_mass = float(n + 0.5 * (v + 1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        voc, lbl = shared.value, trained.value
        reader, number_of_task, row = Reader(voc), TaskContext.get().partitionId(), 0
        log_count = np.append(np.log10(voc.c + 0.5), 0.0)
        for part in slices(batches, limit=READ_BYTES):
            own, h, at, number, first = reader.read(part.column("text"))
            token = number.take(own)
            log_p = lbl.log_probabilities(token, reader.contexts(token, first)).astype(np.float64) / np.log(10)
            group, known, logs = voc.group[number], at >= 0, log_count[at]
            share = np.where(number == voc.rest[group], logs - rest_mass[group], 0.0)  # of a group's common place
            total = lambda x: np.add.reduceat(x, first)
            n_tokens, known_tokens = np.diff(np.append(first, len(own))), known.take(own)
            out = {"n_tokens": n_tokens, "known": total(known_tokens.astype(np.int64)), "base": total(logs.take(own)), "model": total(log_p + share.take(own))}
            tail = np.flatnonzero(~known_tokens)
            pairs, times = np.unique(np.repeat(np.arange(len(first)), n_tokens)[tail] * len(h) + own[tail], return_counts=True)  # of a text and a word
            edge = pa.array(np.searchsorted(pairs, np.arange(len(first) + 1) * len(h)), pa.int32())
            lists = {k: pa.ListArray.from_arrays(edge, pa.array(x, pa.int64())) for k, x in (("tail", h[pairs % len(h)]), ("times", times))}
            ids = (number_of_task << 40) + row + np.arange(len(first))
            row += len(first)
            yield {"doc_id": part.column("doc_id"), "row": ids} | out | lists

    scored = materialise(map_rows(docs, "row long, doc_id long, n_tokens long, known long, base double, model double, tail array<long>, times array<long>", task), "lm-scores")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    tail = tail.join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = scored.drop("tail", "times").join(tail, "row", "left")
    more = F.coalesce("tail_sum", F.lit(0.0))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(whole_mass)))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
