"""Near duplicates in large groups by as many pairs as they have members, the exact prefix filter, exact copies in the mix."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
from tessera.llm import exact_dedup, mixing, simhash  # noqa: E402
from tests.llm.test_operators import brute_kept, edited_pairs  # noqa: E402

TEXTS = "doc_id long, text string"


def copies(n, seed=3, edits=1):
    """Near copies of one text, each with ``edits`` words of its own, and some texts that share only a passage with them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        a = list(base)
        for at in rng.sample(range(5, 145, 10), edits):
            a[at] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(a)))
    for i in range(n, n + 40):
        out.append((i, " ".join(base[:60] + [f"y{rng.randrange(10**6)}" for _ in range(120)])))
    return out


@pytest.mark.parametrize(("edits", "each"), [(1, 5), (2, 12)])
def test_a_large_group_makes_few_pairs(spark, monkeypatch, edits, each):
    """With two edits most of the group lies just below the least similarity, so that its bands must be compared further."""
    table = copies(300, edits=edits)
    want, _ = brute_kept(table)
    tried = []
    real = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda sets, pairs, least: (tried.append(pairs.count()), real(sets, pairs, least))[1])
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(table, TEXTS)).collect())
    assert got == want
    assert sum(tried) <= each * len(table), f"{tried} pairs for {len(table)} texts"


def test_the_exact_filter_misses_none(spark):
    table = edited_pairs(60, 5) + [(1000 + i, x) for i, x in copies(60, 9)]
    want, _ = brute_kept(table)
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(table, TEXTS), exact=True).collect()) == want


def test_long_copies_are_held_by_bytes(spark, monkeypatch):
    """Many copies of long texts, more than a task may hold."""
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 50_000)
    table = [(i, f"text {i % 3} " * 400) for i in range(400)]
    got = exact_dedup.keep_one(spark.createDataFrame(table, TEXTS).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == [397, 398, 399]


def test_tied_rows_are_taken_exactly(spark):
    """Three rows of one id and text, and one other: the words taken are those of ``mix``."""
    table = [(1, "ten words " * 5, "a")] * 3 + [(2, "other words here " * 10, "b")]
    df = spark.createDataFrame(table, f"{TEXTS}, source string").repartition(4)
    want = sum(r.taken for r in mixing.mix(df).collect())
    out = mixing.sample_mix(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == want
    assert max(Counter((r.doc_id, r.text) for r in out.collect()).values()) <= 9
