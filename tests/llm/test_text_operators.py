"""Toxicity, spelling variants and source divergence against brute-force versions and planted cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tessera.llm import divergence, spelling, toxicity  # noqa: E402
from tests.llm.test_operators import LOWER, SCHEMA, docs, nothing, rows, text  # noqa: E402, F401

EXTRA = (7, 1, 1, 1, 1, 1, 1, 1, 1, "x", 1, 1)


# --- toxicity --------------------------------------------------------------------------------------------------------

BAD = ["wretchface", "dumbolo", "craphead", "grumblat"]


def labelled(n=900):
    """Texts of invented words; one in six is toxic and holds bad words, plain or disguised; clean ones hold ``grumblat`` in a phrase."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioutrns") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    disguise = lambda w: rng.choice([w, w.upper(), w.replace("a", "а"), w.replace("e", "3"), w.replace("o", "0"), w[:2] + "​" + w[2:], w.replace("u", "ü")])
    texts, marks = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        toxic = int(i % 6 == 0)
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words.insert(rng.randrange(len(words)), disguise(rng.choice(BAD)))
        if not toxic and i % 23 == 0:
            at = rng.randrange(len(words))
            words[at:at] = ["gentle", "grumblat"]
        texts.append((i, " ".join(words), "en", "a", *EXTRA))
        marks.append((i, toxic))
    return texts, marks


@pytest.fixture(scope="module")
def judged(spark):
    texts, marks = labelled()
    df = spark.createDataFrame(texts, SCHEMA).repartition(4)
    lexicon = toxicity.learn(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(df, lexicon).collect()}
    return texts, dict(marks), lexicon, got


def test_folding():
    assert toxicity.fold("IDIOT 1d10t idi­ot ídïöt іԁіот!") == ["idiot"] * 5
    assert toxicity.fold("c1own CLOWN сlоwn") == ["ciown"] * 3
    assert toxicity.fold("$tupid 2024, 3rd ... —") == ["stupid", "2024", "erd"]


def test_held_out_toxic_texts_are_found(judged):
    texts, marks, lexicon, got = judged
    assert len(got) == len(texts)
    held = {i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == held
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    right = sum(got[i].predicted == marks[i] for i in held)
    assert right >= 0.97 * len(held)
    assert sum(got[i].predicted for i in held if marks[i]) >= 0.95 * sum(marks[i] for i in held)


def test_exception_phrases_are_learned(judged):
    _, _, lexicon, _ = judged
    assert " gentie grumbiat " in lexicon.exceptions
    m = toxicity.Matcher(lexicon)
    assert m.hits(" so grumbiat ") and not m.hits(" gentie grumbiat ")


def test_labels_of_test_rows_teach_nothing(spark, judged):
    texts, marks, lexicon, _ = judged
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in marks.items()]
    df = spark.createDataFrame(texts, SCHEMA)
    assert toxicity.learn(df, spark.createDataFrame(wrong, "doc_id long, toxic int")) == lexicon


def test_longer_texts_need_more(spark):
    lexicon = toxicity.given({"clown": 3.0, "dimw*": 2.0}, ["clown fish"], (0.0, 2.0, 1.0))
    got = [(1, "you clown"), (2, "you clown " + "word " * 500), (3, "a clown fish"), (4, "DIMWITS"), (5, None), (6, "word " * 300_000 + "clown")]
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(got, "doc_id long, text string"), lexicon).collect()}
    assert got[1] > got[2] > got[6] and got[3] < got[4] < got[1] and got[5] == pytest.approx(got[5])


def test_toxicity_edge_rows(spark, docs, nothing):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (105, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert Counter(r.doc_id for r in toxicity.toxicity(docs, lexicon).collect()) == Counter(r[0] for r in rows())
    assert toxicity.toxicity(nothing, lexicon).count() == 0
    none = toxicity.learn(docs, labels.where("false"))
    assert not none.weights and {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert not toxicity.learn(nothing, labels).weights


# --- spelling --------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(table):
    count = Counter()
    for r in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text(r[1])):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 5 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return Counter(out)


def word_table():
    rng = random.Random(8)
    stems = ["haus", "garten", "straße", "élève", "mañana", "mente", "ción", "tion", "über", "ñandú"]
    words = [rng.choice(stems) + rng.choice(stems) for _ in range(60)]
    common = ["aaaaaa" + "b" * k for k in range(5)] + words
    out = []
    for i in range(500):
        said = []
        for _ in range(rng.randrange(5, 60)):
            w = common[min(int(rng.expovariate(0.12)), len(common) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeb") + w[at:], w[:at] + rng.choice("aeb") + w[at + 1 :]])
            said.append(rng.choice([w, w.capitalize(), w.upper()]))
        out.append((None if i % 50 == 0 else i, rng.choice([" ", ", ", "-", "1"]).join(said) + " Ωmega ÷×÷×÷× x́", "en", "a", *EXTRA))
    chain = "kettenxy " * 6 + "kettenxyz " * 40 + "kettenxyzz " * 300
    return out + out[:30] + [(900, chain, "de", "b", *EXTRA)] + rows()


@pytest.mark.parametrize(("shard", "hot"), [(50_000, 20_000), (40, 20_000), (40, 8)])
def test_spelling_against_brute_force(spark, shard, hot):
    table = word_table()
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = spelling.variants(df, shard, hot)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = spelled(table)
    assert Counter(map(tuple, got.collect())) == want
    assert any(x[1] and x[1] != x[2] for x in want), "a chain of forms is wanted in the fixture"


def test_spelling_of_nothing(nothing):  # noqa: F811
    assert spelling.variants(nothing).count() == 0


def test_one_segment_shared_by_most_words(spark):
    """A beginning that all words share: rows follow the words, not their pairs."""
    rng = random.Random(2)
    words = sorted({"commonhead" + "".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(1500)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {r.word: r.n_near for r in spelling.near_words(df, 200, 100).collect()}
    assert got == {w: n for w in words if (n := sum(one_edit(w, x) for x in words))}


# --- divergence ------------------------------------------------------------------------------------------------------


def diverging(table, least):
    count, held = defaultdict(Counter), defaultdict(Counter)
    for r in table:
        lang, source = r[2] or "", r[3] or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text(r[1]).translate(LOWER))
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        total = Counter()
        for (x, _), c in count.items():
            if x == lang:
                total.update(c)
        p, q = {s: share(c) for (x, s), c in count.items() if x == lang}, share(total)
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return Counter(out)


@pytest.mark.parametrize(("least", "block", "chunk", "span"), [(2, 32, 4096, 8), (2, 1, 4, 1), (3, 2, 5, 2), (30, 2, 3, 1), (10**6, 2, 4, 1)])
def test_divergence_against_brute_force(spark, docs, least, block, chunk, span):  # noqa: F811
    got = divergence.divergence(docs, least, block, chunk, span)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert Counter(map(tuple, got.collect())) == diverging(rows(), least)


def test_divergence_of_nothing(nothing):  # noqa: F811
    assert divergence.divergence(nothing).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    counts = [(10**12, 3 * 10**13, 7), (10**15 + 3, 10**16 + 1, 10**6), (0, 0, 1)]
    got = spark.createDataFrame(counts, "c long, t long, v long").select(divergence._share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in counts]
