"""Registered queries that SQL cannot express, against plain Python on the smallest tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera import registry
from tessera.functions import stemming
from tessera.functions import text as T
from tessera.operators import quality, structure, vectors
from tests.conftest import DATA

TOKEN = re.compile(r"[^\W_]+")


def tokens(x):
    return TOKEN.findall((x or "").lower())


def asked(x):
    """Words of a query by tiers."""
    words = [t for t in TOKEN.findall(x) if len(t) >= 3 and t.lower() not in T.STOP_WORDS]
    if len(words) > 12:
        labelled = re.search(r"(?is).*question:(.*)$", x)
        last = re.search(r"([^.!?\n:]*)\?[^?]*$", x)
        focus = labelled.group(1) if labelled and labelled.group(1).strip() else last.group(1) if last else ""
        inside = {t.lower() for t in TOKEN.findall(focus)}
        tier = lambda t: 0 if t.lower() in inside else 1 if re.search("[0-9]", t) or t[0].isupper() else 2
        words = [t for _, t in sorted(enumerate(words), key=lambda p: (tier(p[1]), p[0]))]
        return list(dict.fromkeys(t.lower() for t in words))[:12]
    return list(dict.fromkeys(t.lower() for t in words))


@pytest.fixture(scope="module")
def data(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    return docs, items


def scores(docs, items, form=lambda t: t):
    """BM25 of each item and document over ``form`` of tokens."""
    tf = {i: Counter(map(form, tokens(x))) for i, x in docs.items()}
    size = {i: sum(c.values()) for i, c in tf.items()}
    average, n = sum(size.values()) / len(size), len(size)
    df = Counter(t for c in tf.values() for t in c)
    out = defaultdict(dict)
    for q, x in items.items():
        for i, c in tf.items():
            s = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / average)) for t in set(map(form, asked(x))) if c[t])
            if s:
                out[q][i] = s
    return out


def query(spark, name):
    return registry.queries()[name](spark, DATA)


def test_stemmed_bm25(spark, data):
    stems = {}
    want = scores(*data, lambda t: stems.setdefault(t, None) or stems.update({t: stemming.stem(t)}) or stems[t])
    got = defaultdict(dict)
    for r in query(spark, "fts_stemmed_bm25").collect():
        got[r.item_id][r.doc_id] = r.score
    for q, found in want.items():
        best = sorted(found.values(), reverse=True)[:10]
        assert sorted(got[q].values(), reverse=True) == pytest.approx(best, abs=2e-5)
        assert all(found[i] == pytest.approx(s, abs=2e-5) for i, s in got[q].items())


def test_vectors_and_hybrid(spark, data):
    docs, items = data

    def quantised(v):
        v = v / np.linalg.norm(v) if v.any() else v
        scale = np.abs(v).max() / 127 if v.any() else 1.0
        return np.clip(np.sign(v) * np.floor(np.abs(v) / scale + 0.5), -127, 127), scale

    index = {i: quantised(vectors.trigram_vector(x)) for i, x in docs.items()}
    near = {}
    for q, x in items.items():
        v = vectors.trigram_vector(x)
        v = v / np.linalg.norm(v) if v.any() else v
        near[q] = {i: round(float(v @ w) * s, 6) for i, (w, s) in index.items()}
    got = defaultdict(dict)
    for r in query(spark, "vec_trigram_nearest").collect():
        got[r.item_id][r.doc_id] = r.score
    for q, s in near.items():
        assert sorted(got[q].values(), reverse=True) == pytest.approx(sorted(s.values(), reverse=True)[:50], abs=2e-5)
    keyword = scores(docs, items)
    fused = defaultdict(Counter)
    for q in items:
        lists = [sorted(((round(s, 6), i) for i, s in keyword[q].items()), key=lambda p: (-p[0], p[1]))[:50], sorted(((s, i) for i, s in got[q].items()), key=lambda p: (-p[0], p[1]))]
        for ranked in lists:
            for place, (_, i) in enumerate(ranked):
                fused[q][i] += 1 / (61 + place)
    best = defaultdict(list)
    for r in query(spark, "rank_hybrid").orderBy("item_id", "rank").collect():
        best[r.item_id].append((r.score, r.doc_id))
    for q in items:
        assert [s for s, _ in best[q]] == pytest.approx(sorted((round(s, 9) for s in fused[q].values()), reverse=True)[:12], abs=1e-6)
    for r in query(spark, "rank_hybrid_gated").collect():
        assert near[r.item_id][r.doc_id] >= 0.2 - 1e-5


def test_snippets(spark, data):
    docs, items = data
    best = {q: min(s, key=lambda i: (-round(s[i], 6), i)) for q, s in scores(docs, items).items() if s}
    rows = {r.item_id: r for r in query(spark, "fts_snippet").collect()}
    assert {q: r.doc_id for q, r in rows.items()} == best
    for q, r in rows.items():
        words, wanted = docs[r.doc_id].split(), set(asked(items[q]))
        hits = [any(t in wanted for t in tokens(w)) for w in words]
        most = max(sum(hits[a : a + 14]) for a in range(max(1, len(words) - 13)))
        assert r.snippet.count("\u0002") == r.snippet.count("\u0003") == most and r.snippet.replace("\u0002", "").replace("\u0003", "").rstrip("…") in " ".join(words)


def test_chunks_and_terms(spark, data):
    docs, _ = data
    sections = Counter(c["section"] for x in docs.values() if x for c in structure.chunk(x))
    assert {r.section: r.n_chunks for r in query(spark, "chunk_headings").collect()} == dict(sections)
    rows = query(spark, "chunk_documents").collect()
    assert all(len(r.text.encode()) <= structure.MOST_BYTES for r in rows) and {r.doc_id for r in rows} <= set(docs)
    where = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    terms = defaultdict(list)
    for r in query(spark, "chunk_terms").orderBy("place").collect():
        terms[r.doc_id].append(r.term)
    assert all(terms[i][0] == s for i, (s, _) in where.items() if len(s) >= 2)
    assert all(lang in terms[i] for i, (s, lang) in where.items() if lang.lower() != s.lower())


def test_comparison_and_echo(spark, data):
    docs, _ = data
    got = defaultdict(list)
    for r in query(spark, "cmp_summary").collect():
        got[r.doc_id].append(r)
    altered = {i for i, x in docs.items() if "\n" in x}
    assert set(got) <= set(docs) and altered <= set(got)
    for r in query(spark, "verify_echo").limit(50).collect():
        assert r is not None
    assert quality.stripped("a\n[Context: x\nb\n\nc") == "a\n\nc"


def test_topics(spark):
    for r in query(spark, "fts_topics").collect():
        parts = [p for p in r.topics.split(", ") if p]
        assert len(parts) <= 3 and parts == sorted(parts, key=str.lower) and all(p.lower() not in T.STOP_WORDS for p in parts)
