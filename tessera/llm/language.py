"""Language labels for mixed texts: script ranges, scores by word, Viterbi with a switching penalty.

Training counts hashed letter trigrams (bytes of the lower-cased word, with its borders) and the scripts of words for
each language, over all labelled rows of the training folds; the counts are summed by Spark, and what comes to the
driver has at most languages * (BUCKETS + scripts) numbers whatever the corpus.

Prediction: a word's score for a language is the sum of its trigrams' log probabilities. Languages that are (almost)
never written in the word's script are no candidates for it and are not scored. The best path through all words, where each change of
language costs SWITCH, labels the spans; the language with the most bytes of words is the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text, columns, give_back, map_rows, slices, small_batches

BUCKETS = 1 << 15
#: Cost in nats of one change of language inside a text.
SWITCH = 14.0
#: A language is a candidate for a script that has at least this share of its training words.
SHARE = 0.002
#: What a word costs in a language that is no candidate for its script, beyond its best candidate.
OUTSIDE = 60.0
SMOOTHING = 0.5

# First code points of the Unicode blocks that are told apart, with the name of the script.
SCRIPTS = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_FIRST = np.array([x for x, _ in SCRIPTS])
_NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(x) for _, x in SCRIPTS])

#: Text bytes that a task turns into arrays at a time (about thirty times as many bytes of arrays).
READ_BYTES = 3 << 20
#: Letters and all bytes of other characters stand for themselves, anything else is a border.
_CODE = np.zeros(256, np.uint8)
_CODE[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


class Words:
    """The words of several texts, one behind the other, and their hashed trigrams."""

    def __init__(self, texts: list[str]):
        raw = [x.lower().encode() for x in texts]
        data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
        code = _CODE[data]
        inside = code > 0
        edge = np.diff(inside.view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        gram = code[:-2].astype(np.uint32)
        for later in (code[1:-1], code[2:]):
            gram <<= np.uint32(8)
            gram |= later
        gram = gram[inside[1:-1]]
        gram *= np.uint32(2654435761)
        gram >>= np.uint32(32 - 15)
        self.gram = gram.view(np.int32)
        self.length = self.end - self.start
        self.first_gram = np.cumsum(self.length) - self.length
        bounds = np.cumsum([1, *(len(x) + 1 for x in raw)])
        self.first = np.searchsorted(self.start, bounds)  # words of text i: first[i] .. first[i + 1]
        self.data = data

    def scripts(self) -> np.ndarray:
        last = len(self.data) - 1
        a, b, c, e = (self.data[np.minimum(self.start + i, last)].astype(np.int32) for i in range(4))
        b, c, e = b & 63, c & 63, e & 63
        point = np.where(a < 128, a, np.where(a < 0xE0, ((a & 31) << 6) | b, np.where(a < 0xF0, ((a & 15) << 12) | (b << 6) | c, ((a & 7) << 18) | (b << 12) | (c << 6) | e)))
        return _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1]

    def sums(self, weights: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """For each word and language the sum of ``weights`` (languages x buckets) over its trigrams, where ``inside`` (words x languages) has the language as a candidate.

        Other languages are not looked up; they cost OUTSIDE more than the best candidate.
        """
        found = np.full((len(self.start), len(weights)), -np.inf, np.float32)
        for i, w in enumerate(weights):
            words = inside[:, i]
            if words.all() and len(words):
                found[:, i] = np.add.reduceat(w[self.gram], self.first_gram)
            elif words.any():
                length = self.length[words]
                found[words, i] = np.add.reduceat(w[self.gram[np.repeat(words, self.length)]], np.cumsum(length) - length)
        outside = ~np.isfinite(found)
        return np.where(outside, found.max(axis=1, initial=-np.inf, keepdims=True) - np.float32(OUTSIDE), found)


def best_paths(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi for all texts at once: the label of each word. Staying ties win over changing, then the lower label."""
    labels = np.zeros(len(scores), np.int16)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    if not len(n) or not n[0]:
        return labels
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
    total = scores[at[: active[0]]].astype(np.float64)
    changed = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    last = {}
    for t in range(1, n[0]):
        k = active[t]
        if k < len(total):
            last[t] = total[k:]
            total = total[:k]
        best = total.argmax(axis=1)
        move = total[np.arange(k), best] - switch
        rows = at[:k] + t
        change = move[:, None] > total
        changed[rows], source[rows] = change, best
        total = np.where(change, move[:, None], total) + scores[rows]
    ends = np.concatenate([total, *(last[t] for t in sorted(last, reverse=True))]).argmax(axis=1)
    now = ends.astype(np.int64)
    for t in range(n[0] - 1, -1, -1):
        k = active[t]
        rows = at[:k] + t
        labels[rows] = now[:k]
        if t:
            now[:k] = np.where(changed[rows, now[:k]], source[rows], now[:k])
    return labels


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def train(labelled: DataFrame) -> Model:
    """From (text, lang), all rows of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches, limit=READ_BYTES):
            by: dict[str, list[str]] = {}
            for text, lang in zip(as_text(part.column("text")), part.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                words = Words(texts)
                counts.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                counts[lang][:BUCKETS] += np.bincount(words.gram, minlength=BUCKETS)
                counts[lang][BUCKETS:] += np.bincount(words.scripts(), minlength=len(_NAMES))
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield {"lang": [lang] * len(at), "at": at.tolist(), "n": c[at].tolist()}

    rows = map_rows(labelled, "lang string, at int, n long", task).groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    table = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    table[[langs.index(x) for x in rows["lang"]], rows["at"].astype(int)] = rows["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    weights = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)
    candidates = scripts >= SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    candidates[:, ~candidates.any(axis=0)] = True  # an unseen script excludes nobody
    return Model(langs, weights, candidates)


class Model:
    """What training leaves: languages by code point, log probabilities (languages x BUCKETS), candidates by script."""

    def __init__(self, langs: list[str], weights: np.ndarray, candidates: np.ndarray, switch: float = SWITCH):
        self.langs, self.weights, self.candidates, self.switch = langs, weights, candidates, switch

    def label(self, texts: list[str]) -> dict[str, list]:
        """lang_pred, score, and the spans as arrays of word numbers and labels."""
        out: dict[str, list] = {"lang_pred": [], "score": [], "span_start": [], "span_end": [], "span_lang": []}
        words = Words(texts)
        labels = np.zeros(len(words.start), np.int16)
        if self.langs:
            labels = best_paths(words.sums(self.weights, self.candidates.T[words.scripts()]), words.first, self.switch)
        for i, text in enumerate(texts):
            a, b = words.first[i], words.first[i + 1]
            own = labels[a:b]
            if not self.langs or a == b or not has_letter(text):
                found, share, edges = "und", 0.0, np.zeros(0, int)
            else:
                size = np.bincount(own, weights=words.length[a:b], minlength=len(self.langs))
                found, share = self.langs[int(size.argmax())], float(size.max() / size.sum())
                edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            out["lang_pred"].append(found)
            out["score"].append(share)
            out["span_start"].append(edges.tolist())
            out["span_end"].append([*edges[1:].tolist(), b - a] if len(edges) else [])
            out["span_lang"].append([self.langs[x] for x in own[edges]] if len(edges) else [])
        return out


def label(docs: DataFrame, model: Model) -> DataFrame:
    """From (doc_id, text): doc_id and what ``Model.label`` gives."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches, limit=READ_BYTES):
            yield model.label(as_text(part.column("text"))) | {"doc_id": part.column("doc_id")}

    return map_rows(docs, "doc_id long, lang_pred string, score double, span_start array<long>, span_end array<long>, span_lang array<string>", task)


def training_rows(named: DataFrame, folds: int, held: int) -> DataFrame:
    return named.where((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, span_start, span_end, span_lang.

    Learns from rows outside fold ``held`` with a text and a language. ``und`` with score 0 where the text is null,
    empty or without a letter, and everywhere if no row has a language. The score is the share of the words' bytes
    in spans of the predicted language; ties go to the language that is first by code point. Repeated rows are
    labelled alike, null doc_ids belong to a training fold, an empty table gives no rows, other columns are ignored.
    """
    named = columns(docs, doc_id=doc_id, text=text, lang=lang)
    out = label(named.select("doc_id", "text"), train(training_rows(named, folds, held)))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "span_start", "span_end", "span_lang")


def identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those that ``identify`` rejects (``und``): one pass, no shuffle."""
    model = train(training_rows(columns(docs, doc_id="doc_id", text="text", lang="lang"), folds, held))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=READ_BYTES):
            found = model.label(as_text(part.column("text")))["lang_pred"]
            yield part.filter(pa.array([x != "und" for x in found]))
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)
