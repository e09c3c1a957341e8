"""Secrets in whole texts: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates of the battery are runs of letters, digits and ``+/_-`` of MIN_LENGTH characters or more. For each:

* The encoding is inferred from the characters that occur (decimal, hex, base32, one-case letters and digits,
  letters and digits, base64). Under the hypothesis "uniformly random in that alphabet" a chi-squared test over its
  characters, a runs test (above and below the alphabet's middle) and a lag-1 serial correlation give three p-values.
  Fisher's method combines them, and a candidate that is rejected at BATTERY is not random: its p-value below is 1.
* Under the opposite hypothesis, "text of this corpus", each of the three p-values has another distribution. Both
  distributions are known from strings of the candidate's length class, drawn from the inferred alphabets and from the
  corpus's own character pairs; the ratio of the two at the candidate's p-value is an e-value. So is the likelihood
  ratio of the uniform alphabet to the corpus's character pairs. A weighted geometric mean of e-values is one too
  (Hoelder), and its inverse bounds a p-value (Markov). It shrinks by itself as a run grows.
* Benjamini-Hochberg over all candidates of the corpus, separately for each length class, turns these p-values into
  spans with a false-discovery rate of FDR in each class.

The corpus counts of character pairs and the histograms of p-values are sums over all documents with a fixed number
of cells, so what comes to the driver does not grow.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text, columns, map_rows, materialise, slices

# The patterns that the base spans follow, with the least length of what they find, in order of kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
FDR = 0.01
BATTERY = 0.001
#: Length classes of the false-discovery control, by their least length.
LENGTHS = (20, 28, 40, 64)
#: Cells of a p-value histogram: whole units of -log10 p * 10, the last for all beyond.
CELLS = 400

RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: A character's number in the alphabet of candidates; len(_ALPHABET) is any other, a border.
_NUMBER = np.full(256, len(_ALPHABET), np.int64)
_NUMBER[[ord(x) for x in _ALPHABET]] = range(len(_ALPHABET))
_N = len(_ALPHABET) + 1
_LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order; per kind leftmost and without overlap, short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # runs are maximal, so asking for the least length at once finds the same ones
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


# Inferred encodings: name and characters, narrowest first.
_UPPER, _LOWER, _DIGITS = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
_ENCODINGS = [
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("lower", _LOWER + _DIGITS),
    ("upper", _UPPER + _DIGITS),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "_-"),
    ("mixed", _ALPHABET),
]
_SETS = [frozenset(x) for _, x in _ENCODINGS]
_PLACES = [{c: i for i, c in enumerate(x)} for _, x in _ENCODINGS]
#: Share of the character pairs in the combined evidence; the three tests of the battery have the rest.
PAIRS = 0.7
#: Cells of a test's p-value, by their lower ends, and strings that are drawn for each length class and hypothesis.
P_CELLS = np.array([0.0, 1e-4, 1e-3, 0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8])
DRAWN = 2000


def encoding_of(run: str) -> int:
    """The first (narrowest) alphabet that has all characters of ``run``."""
    own = frozenset(run)
    return next(i for i, s in enumerate(_SETS) if own <= s)


def _log_gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma for whole and half a, by its recurrence."""
    from math import erfc, exp, lgamma, log, sqrt

    if x <= 0:
        return 1.0
    q, k = (exp(-x), 1.0) if a == int(a) else (erfc(sqrt(x)), 0.5)
    while k < a:
        q += exp(k * log(x) - x - lgamma(k + 1))
        k += 1
    return min(1.0, q)


def chi_squared_p(value: float, freedom: int) -> float:
    return _log_gamma_q(freedom / 2, value / 2)


def normal_p(z: float) -> float:
    from math import erfc, sqrt

    return erfc(abs(z) / sqrt(2))


def tests(run: str) -> list[float]:
    """p-values under uniform randomness in the inferred encoding: chi-squared over its characters, runs, serial correlation."""
    from math import sqrt

    e = encoding_of(run)
    n, k = len(run), len(_PLACES[e])
    x = np.array([_PLACES[e][c] for c in run], float)
    counts = np.bincount(x.astype(np.int64), minlength=k)
    # few characters for each cell: the factor gives the statistic the variance that it has under the hypothesis
    p = [chi_squared_p(float(((counts - n / k) ** 2).sum() * k / n) * n / (n - 1), k - 1)]
    above = x >= k / 2
    n1, n2 = int(above.sum()), int(n - above.sum())
    if n1 and n2:
        runs, mean = 1 + int((above[1:] != above[:-1]).sum()), 1 + 2 * n1 * n2 / n
        spread = sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p.append(normal_p((runs - mean) / spread))
    else:
        p.append(2.0 ** (1 - n))
    d = x - x.mean()
    p.append(normal_p((float((d[1:] * d[:-1]).sum() / (d * d).sum()) + 1 / n) * sqrt(n)) if (d * d).sum() else 2.0 ** (1 - n))
    return p


def fisher(p: list[float]) -> float:
    from math import log

    return chi_squared_p(-2 * sum(log(max(x, 1e-300)) for x in p), 2 * len(p))


def battery(run: str) -> float:
    """Fisher's combination of the three tests."""
    return fisher(tests(run))


def calibration(pairs: np.ndarray, seed: int = 11) -> np.ndarray:
    """For each length class, test and cell: log10 of the cell's share among random strings over its share among strings of the corpus's character pairs."""
    rng = np.random.default_rng(seed)
    inner = pairs[:, :-1] + 0.5
    ladder = np.cumsum(inner / inner.sum(axis=1, keepdims=True), axis=1)
    found = np.zeros((len(LENGTHS), 3, len(P_CELLS)))
    for k, n in enumerate(LENGTHS):
        code, text = np.full(DRAWN, _N - 1), np.zeros((DRAWN, n), np.int64)
        for i in range(n):
            code = (ladder[code] < rng.random((DRAWN, 1))).sum(axis=1).clip(max=_N - 2)
            text[:, i] = code
        strings = ["".join(_ALPHABET[c] for c in x) for x in text.tolist()]
        alphabets = [x for _, x in _ENCODINGS]
        random = ["".join(alphabets[i % len(alphabets)][c] for c in rng.integers(0, len(alphabets[i % len(alphabets)]), n)) for i in range(DRAWN)]
        for sign, of in ((1, random), (-1, strings)):
            cells = np.array([np.searchsorted(P_CELLS, tests(x), side="right") - 1 for x in of])
            for t in range(3):
                share = np.bincount(cells[:, t], minlength=len(P_CELLS)) + 0.5
                found[k, t] += sign * np.log10(share / share.sum())
    return found


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each character of the alphabet follows each (or a border), over all texts: _N * _N numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total = np.zeros(_N * _N, np.int64)
        for part in slices(batches):
            code = _NUMBER[np.frombuffer(b"\n".join([b"", *(x.encode() for x in as_text(part.column("text"))), b""]), np.uint8)]
            total += np.bincount(code[:-1] * _N + code[1:], minlength=_N * _N)
        at = np.flatnonzero(total)
        yield {"at": at.tolist(), "n": total[at].tolist()}

    rows = map_rows(docs.select("text"), "at int, n long", task).groupBy("at").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(_N * _N)
    table[[r["at"] for r in rows]] = [r["n"] for r in rows]
    return table.reshape(_N, _N)


def surprise(pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each character after each, within runs: borders are no outcome."""
    inner = pairs[:, :-1] + 0.5
    return np.log10(inner / inner.sum(axis=1, keepdims=True))


def evidence(run: str, log_pairs: np.ndarray, ratios: np.ndarray) -> float:
    """log10 of the combined e-value of a run against "text of this corpus"; 0 if it is not random either."""
    code = _NUMBER[np.frombuffer(run.encode(), np.uint8)]
    before = np.concatenate([[_N - 1], code[:-1]])
    by_pairs = float(-len(run) * np.log10(len(_ENCODINGS[encoding_of(run)][1])) - log_pairs[before, code].sum())
    if by_pairs <= 0:  # the battery has no vote large enough to outweigh this
        return 0.0
    p = tests(run)
    if fisher(p) < BATTERY:
        return 0.0
    cells = np.searchsorted(P_CELLS, p, side="right") - 1
    by_tests = sum(ratios[length_class(len(run)), t, c] for t, c in enumerate(cells)) / 3
    return PAIRS * by_pairs + (1 - PAIRS) * float(by_tests)


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def cut_cells(histogram: dict[tuple[int, int], int], rate: float = FDR) -> list[int]:
    """Benjamini-Hochberg for each length class: the least cell whose candidates are discoveries (CELLS: none).

    A cell holds p-values of at most 10 ** (-cell / 10), so taking that for all of them is on the safe side.
    """
    cuts = []
    for k in range(len(LENGTHS)):
        counts = np.array([histogram.get((k, c), 0) for c in range(CELLS)])
        m, above = counts.sum(), np.cumsum(counts[::-1])[::-1]  # candidates in this cell or a higher one
        good = np.flatnonzero((counts > 0) & (10.0 ** (-np.arange(CELLS) / 10) * m <= rate * above))
        cuts.append(int(good[0]) if len(good) else CELLS)
    return cuts


def secrets(docs: DataFrame, rate: float = FDR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty: no spans, and the digest of the empty string. Positions are code points, ends
    exclusive. A run that a base span covers in full is not added again. Repeated rows and null doc_ids give a row
    each, an empty table none; other columns are ignored.
    """
    docs = columns(docs, doc_id=doc_id, text=text)
    pairs = pair_counts(docs)
    log_pairs, ratios = surprise(pairs), calibration(pairs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "start", "end", "cell")}
            for text in as_text(part.column("text")):
                base = base_spans(text)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
                out["base"].append([f"{s}:{e}:{k}" for s, e, k in base])
                own: list[tuple[int, int, int]] = []
                for m in RUN.finditer(text):
                    own.append((m.start(), m.end(), max(0, min(CELLS - 1, int(evidence(m.group(), log_pairs, ratios) * 10)))))
                for i, k in enumerate(("start", "end", "cell")):
                    out[k].append([x[i] for x in own])
            yield out | {"doc_id": part.column("doc_id")}

    found = materialise(map_rows(docs, "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, start array<long>, end array<long>, cell array<long>", scan), "secrets")
    each = found.select(F.explode(F.arrays_zip(F.col("start"), F.col("end"), F.col("cell"))).alias("c"))
    length = F.col("c.end") - F.col("c.start")
    kind = sum(F.when(length >= x, 1).otherwise(0) for x in LENGTHS) - 1
    histogram = {(r["k"], r["cell"]): r["count"] for r in each.groupBy(kind.alias("k"), F.col("c.cell").alias("cell")).count().collect()}
    cuts = cut_cells(histogram, rate)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"base_sha256": [], "spans": []}
            for base, starts, ends, cells in zip(*(batch.column(k).to_pylist() for k in ("base", "start", "end", "cell")), strict=True):
                spans = [(int(s), KINDS.index(k), int(e)) for s, e, k in (x.split(":") for x in base)]
                name = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
                added = [(s, 3, e) for s, e, c in zip(starts, ends, cells, strict=True) if c >= max(1, cuts[length_class(e - s)]) and not any(x <= s and e <= y for x, _, y in spans)]
                out["base_sha256"].append(hashlib.sha256(name(spans).encode()).hexdigest())
                out["spans"].append(name(sorted(spans + added)))
            yield out | {k: batch.column(k) for k in ("doc_id", "n_assign", "n_access", "n_hex")}

    return map_rows(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", decide)
