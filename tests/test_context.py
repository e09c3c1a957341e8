"""Past context, briefs and folded blocks on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import brief, past

FILES = [(1, "Lease.pdf", "The rent is due monthly. " * 3, True, 10), (2, "old lease.pdf", "Rent was due weekly.", True, 5), (3, "Lease.pdf.bak", "x", False, 50), (4, "notes.txt", "rent rent rent due", True, 20), (5, "other.txt", "nothing of that", True, 30), (6, "big.txt", "word " * 4000, True, 40)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "doc long, name string, text string, ok boolean, day long")


def found(spark, files, asked, named, hits, scope=None):
    a = spark.createDataFrame(asked, "q long, question string, first_day long, last_day long")
    n = spark.createDataFrame(named, "q long, file string")
    h = spark.createDataFrame(hits, "q long, doc long, ord int, score double")
    s = spark.createDataFrame(scope or [(x[0], f[0]) for x in asked for f in FILES], "q long, doc long")
    out = past.found_documents(a, "q", "question", n, files, s, h)
    return sorted((r.q, r["rank"], r.doc, r.named) for r in out.collect())


def test_named_files_come_first(spark, files):
    hits = [(1, 4, 0, 3.0), (1, 4, 1, 1.0), (1, 5, 0, 9.0), (1, 1, 0, 0.5)]
    got = found(spark, files, [(1, "when is the rent due", None, None)], [(1, "lease.PDF")], hits)
    # both leases are named, newest first; 5 has none of the words, the third place is the best other one
    assert got == [(1, 1, 1, True), (1, 2, 2, True), (1, 3, 4, False)]


def test_scope_and_time(spark, files):
    hits = [(1, 1, 0, 3.0), (1, 2, 0, 2.0), (1, 4, 0, 1.0)]
    ask = lambda first, last: [(1, "when is the rent due", first, last)]
    assert [x[2] for x in found(spark, files, ask(None, None), [], hits)] == [1, 2, 4]
    assert [x[2] for x in found(spark, files, ask(8, 15), [], hits)] == [1]
    assert [x[2] for x in found(spark, files, ask(None, 8), [], hits)] == [2]
    assert [x[2] for x in found(spark, files, ask(None, None), [(1, "lease.pdf")], hits, [(1, 4)])] == [4]


def context(spark, files, budget, refers=True, docs=(), hits=(), lines=(), chunks=()):
    asked = spark.createDataFrame([(1, budget)], "q long, budget long")
    d = spark.createDataFrame(list(docs), "q long, doc long, rank int")
    h = spark.createDataFrame(list(hits), "q long, doc long, ord int, score double")
    c = spark.createDataFrame(list(chunks), "doc long, ord int, citation string, text string")
    m = spark.createDataFrame(list(lines), "q long, rank int, line string")
    return past.past_context(asked, "q", F.lit(refers), "budget", d, files, c, h, m).first()


def test_a_block_of_everything(spark, files):
    r = context(spark, files, 4000, docs=[(1, 4, 2), (1, 1, 1)], lines=[(1, 2, "second\n"), (1, 1, "first\n")])
    assert r.block == past.INTRO + past.COMPLETE + "\n--- From document 'Lease.pdf' (10) ---\n" + FILES[0][2].strip() + "\n" + "\n--- From document 'notes.txt' (20) ---\nrent rent rent due\n" + "\n--- From earlier conversations ---\nfirst\nsecond\n"
    assert (r.documents, r.messages, r.reason) == (2, 2, "2 documents and 2 messages")


def test_a_large_document_gives_its_matching_passages(spark, files):
    chunks = [(6, n, f"p. {n}", f"passage {n} " + "z" * 150) for n in range(9)]
    hits = [(1, 6, 5, 9.0), (1, 6, 2, 8.0), (1, 6, 7, 7.0), (1, 6, 8, 0.1)]
    r = context(spark, files, 1500, docs=[(1, 6, 1)], hits=hits, chunks=chunks, lines=[(1, 1, "said\n")])
    assert past.EXCERPTED in r.block and len(r.block.encode()) <= 1500
    at = [r.block.index(f"p. {n} passage {n}") for n in (2, 5, 7) if f"passage {n} " in r.block]
    assert at == sorted(at) and len(at) >= 2 and "passage 5 " in r.block, "the best ones that fit, in the text's order"
    assert r.block.endswith("said\n")
    plain = context(spark, files, 1500, docs=[(1, 6, 1)])
    assert "excerpt ends here" in plain.block and len(plain.block.encode()) <= 1500


def test_exchanges_get_what_documents_leave(spark, files):
    lines = [(1, n, "m" * 99 + "\n") for n in range(1, 9)]
    alone, beside = context(spark, files, 1200, lines=lines), context(spark, files, 1200, docs=[(1, 6, 1)], lines=lines)
    assert alone.messages == past.MESSAGES and 0 < beside.messages < alone.messages


@pytest.mark.parametrize(("budget", "refers", "reason"), [(9000, False, "no reference to the past"), (300, True, "too little room"), (9000, True, "nothing matched")])
def test_no_block_says_why(spark, files, budget, refers, reason):
    r = context(spark, files, budget, refers)
    assert r.block is None and r.reason == reason


def test_nothing_fits(spark, files):
    r = context(spark, files, 700, lines=[(1, 1, "l" * 5000)])
    assert r.block is None and r.reason == "nothing fitted"


# --- briefs ----------------------------------------------------------------------------------------------------------


def test_sections_share_the_budget(spark):
    owners = spark.createDataFrame([(1,), (2,)], "o long")
    many = spark.createDataFrame([(1, n, f"row {n:02d}") for n in range(40)], "o long, n long, line string")
    few = spark.createDataFrame([(1, 1, "only")], "o long, n long, line string")
    kinds = {"Many": (many, [F.col("n")], F.col("line")), "Few": (few, [F.col("n")], F.col("line"))}
    got = {r.o: r.inventory for r in brief.inventory(owners, "o", kinds, 400, F.lit("d")).collect()}
    first = "WORKSPACE (today is d): 40 many, 1 few.\n"
    share = (400 * 55 // 100 - len(first)) // 2
    rows = [f"row {n:02d}\n" for n in range((share - len("Many:\n")) // 7)]
    assert got[1] == first + "Many:\n" + "".join(rows[:12]) + "Few:\nonly\n" + brief.FOOT
    assert got[2] == "WORKSPACE (today is d): 0 many, 0 few.\nMany:\n- (none)\nFew:\n- (none)\n" + brief.FOOT


def test_matches_stop_by_kind(spark):
    hits = [(1, 0, 1, "a" * 90), (1, 0, 2, "b" * 120), (1, 0, 3, "c"), (1, 1, 1, "d")]
    df = spark.createDataFrame(hits, "q long, kind int, n int, line string")
    head = "[Matches in the workspace]\n"
    assert brief.matches(df, "q", "n", "kind", "line", 210).first().matches == head + "a" * 90 + "\nd\n"
    assert brief.matches(df, "q", "n", "kind", "line", 150).count() == 0


def test_folding_and_back(spark):
    df = spark.createDataFrame([("say", "block"), ("say", " "), ("", "block"), (None, None)], "m string, b string")
    out = df.select(brief.folded(F.col("m"), F.col("b"), "\n##\n").alias("f"))
    assert [r.f for r in out.collect()] == ["block\n##\nsay", "say", "block", None]
    assert [r.u for r in out.select(brief.unfolded(F.col("f"), "\n##\n").alias("u")).collect()] == ["say", "say", "block", None]
