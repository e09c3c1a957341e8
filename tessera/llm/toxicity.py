"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding makes one form of what readers see as one word: case, accents, look-alike letters of other scripts, digits and
signs that stand for letters inside words, invisible characters. ``i``, ``l``, ``1``, ``|`` and ``!`` look alike, so all
become ``i``. A lexicon is learned in that form. Its entries are whole words and word beginnings; an entry's weight is
its log odds of standing in a toxic document, held back by pseudo-documents, so that a word seen twice says little.
The automaton finds all entries in one pass over a text; of those that begin at one place the heaviest counts, and none
inside an exception phrase (two words, given or learned, in which an entry mostly stands in clean documents). A logistic
curve of the weight found and the number of words turns both into a probability.

Examples are at most ``EXAMPLES`` labelled rows, the least by hash of their doc_id; all else reads all rows and whole texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text, columns, map_rows, materialise, remembered, slices

#: Labelled documents that the lexicon is learned from, at most.
EXAMPLES = 200_000
#: Entries of a lexicon, and exception phrases, at most.
ENTRIES, PHRASES = 50_000, 10_000
#: Lengths of word beginnings that can be entries.
BEGINNINGS = (4, 5, 6)
#: Toxic documents that an entry needs; pseudo-documents of the common share; least log odds; standard deviations above none.
LEAST_DOCS, PSEUDO, LEAST_WEIGHT, LEAST_Z = 4, 10.0, 1.5, 3.0
#: Words that are added to a text's length, so that one hit in a very short text is not everything.
PAD = 20.0
#: Different keys that a task counts before it hands them on.
KEYS = 300_000
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, each beside the letter that it looks like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
# Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}


class _Fold(dict):
    """Translation table of ``str.translate`` that works out a character when it first meets it."""

    def __missing__(self, code: int):
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Cf"):
            out = None
        elif c in SIGNS:
            out = c
        elif c in LOOK_ALIKES:
            out = LOOK_ALIKES[c]
        else:
            base = unicodedata.normalize("NFKD", c).lower()
            base = "".join(LOOK_ALIKES.get(x, x) for x in base if not unicodedata.combining(x))
            out = base if base and all(x.isalnum() for x in base) else " "
        if out:
            out = out.replace("l", "i")
        self[code] = out
        return out


_TABLE = _Fold()
_SIGNS = str.maketrans(SIGNS)


def _plain(word: str) -> str:
    """Signs inside a word become letters; numbers stay, and marks at the end of a sentence go."""
    word = word.strip("!|").rstrip("@")
    if any(c.isalpha() for c in word):
        return word.translate(_SIGNS)
    return "".join(c for c in word if c.isdigit())


def fold(text: str) -> list[str]:
    """The words of a text in folded form."""
    out = []
    for w in text.lower().translate(_TABLE).split():
        if not w.isalpha():
            w = _plain(w)
            if not w:
                continue
        out.append(w)
    return out


class Lexicon(NamedTuple):
    """``weights``: entry -> weight; an entry is `` word `` or the beginning `` wor``. ``exceptions``: phrases `` two words ``.

    ``curve`` gives the probability: 1 / (1 + exp(-(a + b * log(weight + 1/2) - c * log(words + PAD)))).
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def probability(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log(weight + 0.5) - c * np.log(words + PAD), -30, 30)))


def given(weights: dict[str, float], exceptions: list[str] = (), curve: tuple[float, float, float] = (0.0, 2.0, 1.0)) -> Lexicon:
    """A lexicon of one's own: words (a trailing ``*`` marks a beginning) with weights, and phrases in which they do not count."""
    entry = lambda w: " " + "".join(fold(w.rstrip("*"))) + ("" if w.endswith("*") else " ")
    return Lexicon({entry(w): x for w, x in weights.items()}, tuple(f" {' '.join(fold(p))} " for p in exceptions), curve)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, joined: str) -> dict[int, float]:
        """Place of a hit -> its weight, in a text of folded words with a blank before, between and after them."""
        if not len(self.automaton):
            return {}
        found, shielded = {}, []
        for end, (n, weight) in self.automaton.iter(joined):
            start = end - n + 1
            if weight is None:
                shielded.append((start, end))
            elif weight > found.get(start, 0):
                found[start] = weight
        for low, high in shielded:
            for at in [x for x in found if low <= x < high]:
                del found[at]
        return found


def _joined(words: list[str]) -> str:
    return f" {' '.join(words)} "


def held_out(doc_id: Column) -> Column:
    """A row without an id is none of the test rows."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES) -> DataFrame:
    """text, toxic, fit: labelled documents outside the test rows; ``fit`` marks the fifth that the curve is fitted on.

    A document with several labels is toxic if one of them says so, and so is a text that several documents have: it
    teaches once. Rows without id, label or text teach nothing.
    """
    known = columns(labels, doc_id="doc_id", toxic=label).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = columns(docs, doc_id="doc_id", text="text").where("doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    # at most EXAMPLES rows of a number and a flag
    met = texts.join(F.broadcast(known), "doc_id").groupBy(F.xxhash64("text").alias("h"), F.octet_length("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return materialise(met.select("text", "toxic", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("fit")), "toxic-examples")


def _handed_on(counts: dict[int, Counter]) -> dict[str, list]:
    keys = list(counts[0].keys() | counts[1].keys())
    out = {"k": keys, "clean": [counts[0][x] for x in keys], "toxic": [counts[1][x] for x in keys]}
    for c in counts.values():
        c.clear()
    return out


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    counts = {0: Counter(), 1: Counter()}
    for batch in slices(batches):
        for text, toxic in zip(as_text(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            words = set(fold(text))
            found = {f" {w} " for w in words}
            for n in BEGINNINGS:
                found.update(f" {w[:n]}" for w in words if len(w) > n)
            counts[1 if toxic else 0].update(found)
        if len(counts[0]) + len(counts[1]) > KEYS:
            yield _handed_on(counts)
    yield _handed_on(counts)


def _odds(toxic: Column, clean: Column, share: float) -> Column:
    return F.log((toxic + PSEUDO * share) / (clean + PSEUDO * (1 - share))) - float(np.log(share / (1 - share)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES, exceptions: list[str] = ()) -> Lexicon:
    """A lexicon from labelled documents. Without toxic and clean examples it is empty and gives all texts the same small score."""
    seen = examples(docs, labels, label, most)
    total = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    own = tuple(f" {' '.join(fold(p))} " for p in exceptions)
    if not 0 < total.t < total.n:
        rate = (total.t + 0.5) / (total.n + 10)
        return Lexicon({}, own, (float(np.log(rate / (1 - rate))), 0.0, 0.0))
    share = total.t / total.n
    learning = seen.where("NOT fit") if seen.where("fit AND toxic = 1").limit(1).count() else seen
    counts = map_rows(learning.select("text", "toxic"), "k string, clean long, toxic long", _entry_counts)
    counts = counts.groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCS)
    weight = _odds(F.col("toxic"), F.col("clean"), share)
    z = weight / F.sqrt(1 / (F.col("toxic") + PSEUDO * share) + 1 / (F.col("clean") + PSEUDO * (1 - share)))
    entries = counts.select("k", weight.alias("w"), z.alias("z")).where((F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
    weights = {r.k: r.w for r in entries.orderBy(F.desc("z"), "k").limit(ENTRIES).collect()}  # at most ENTRIES rows
    lexicon = Lexicon(weights, own, (0.0, 0.0, 0.0))
    phrases = _exceptions(learning, lexicon, share)
    lexicon = lexicon._replace(exceptions=own + phrases)
    return lexicon._replace(curve=_curve(seen.where("fit") if learning is not seen else seen, lexicon))


def _exceptions(learning: DataFrame, lexicon: Lexicon, share: float) -> tuple[str, ...]:
    """Two-word phrases around hits that speak for a clean document."""
    sent = learning.sparkSession.sparkContext.broadcast(lexicon)  # at most ENTRIES entries

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        matcher = remembered("matcher", lambda: Matcher(sent.value))
        counts = {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for text, toxic in zip(as_text(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                joined = _joined(fold(text))
                found = set()
                for at in matcher.hits(joined):
                    end = joined.find(" ", at + 1)
                    before, after = joined.rfind(" ", 0, at) if at else -1, joined.find(" ", end + 1)
                    if before >= 0:
                        found.add(joined[before : end + 1])
                    if after > 0:
                        found.add(joined[at : after + 1])
                counts[1 if toxic else 0].update(found)
            if len(counts[0]) + len(counts[1]) > KEYS:
                yield _handed_on(counts)
        yield _handed_on(counts)

    counts = map_rows(learning.select("text", "toxic"), "k string, clean long, toxic long", task)
    counts = counts.groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") >= LEAST_DOCS)
    counts = counts.where(_odds(F.col("toxic"), F.col("clean"), share) < 0)
    return tuple(r.k for r in counts.orderBy(F.desc("clean"), "k").limit(PHRASES).collect())  # at most PHRASES rows


def _measured(df: DataFrame, lexicon: Lexicon, ddl: str) -> DataFrame:
    """The other columns of ``df``, then weight and words of its ``text``."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)  # at most ENTRIES entries
    others = [c for c in df.columns if c != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        matcher = remembered("matcher", lambda: Matcher(sent.value))
        for batch in slices(batches):
            weight, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(as_text(batch.column("text"))):
                folded = fold(text)
                words[i] = len(folded)
                weight[i] = sum(matcher.hits(_joined(folded)).values())
            yield {c: batch.column(c) for c in others} | {"weight": pa.array(weight), "words": pa.array(words)}

    return map_rows(df, f"{ddl}, weight double, words long", task)


def _curve(seen: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression on log weight and log length; the examples meet as a histogram of at most some thousand cells."""
    cells = _measured(seen.select("toxic", "text"), lexicon, "toxic int").select("toxic", F.log(F.col("weight") + 0.5).alias("x"), F.log(F.col("words") + PAD).alias("y"))
    cells = cells.groupBy(F.round("x", 1).alias("bx"), F.round("y", 1).alias("by")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rows = np.array([[r.x, r.y, r.n, r.t] for r in cells.orderBy("bx", "by").collect()])
    x = np.column_stack([np.ones(len(rows)), rows[:, 0], -rows[:, 1]])
    n, t = rows[:, 2], rows[:, 3]
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    beta = np.array([0.0, 1.0, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (t - n * p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0)  # more weight is never less toxic, more words never more
        if abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null text counts as empty; repeated rows are scored each; rows without an id have none and are not held out.
    """
    out = _measured(columns(docs, doc_id="doc_id", text="text"), lexicon, "doc_id long")
    a, b, c = lexicon.curve
    x = F.lit(a) + F.lit(b) * F.log(F.col("weight") + 0.5) - F.lit(c) * F.log(F.col("words") + PAD)
    score = 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))
    out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
