"""Retrieval, memory, readers and indexing against expected values and plain Python versions."""

import datetime
import io
import math
import random
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import memory, passages, ranking, recall, references, routes, search, structure, upkeep, vectors
from tessera.sources import files


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_query_words_by_tier(spark):
    short = "Refund rules for Refund claims"
    assert one(spark, T.query_tokens(F.col("t")), t=short) == ["refund", "rules", "claims"]
    long = "Based upon some wordy preamble written quickly, mention Berlin plus form 42b alongside several further plain remarks. Question: which invoice covers heating? "
    assert one(spark, T.query_tokens(F.col("t")), t=long) == ["invoice", "covers", "heating", "based", "berlin", "42b", "question", "wordy", "preamble", "written", "quickly", "mention"][:12]
    asked = "Alpha beta gamma delta epsilon zeta theta iota kappa lambda sigma omega. Does Tau pay rent? Thanks anyway friend"
    got = one(spark, T.query_tokens(F.col("t")), t=asked)
    assert got[:3] == ["tau", "pay", "rent"] and len(got) == 12 and got[3] == "alpha"


def test_endings_longest_first(spark):
    assert list(T.ENDINGS) == sorted(set(T.ENDINGS), key=lambda e: (-len(e), e))
    assert one(spark, T.morphological_prefix(F.col("t")), t="indemnifications") == "indemnif"


def test_bm25_with_weights_and_scope(spark):
    docs = [(1, "red fox", "the quick red dog", 7), (2, "dog", "a red red house", 7), (3, None, "nothing here", 8), (4, "fox", None, 8)]
    df = spark.createDataFrame(docs, "id long, head string, body string, room long")
    terms = spark.createDataFrame([(9, "red", 7), (9, "fox", 8)], "q long, term string, room long")
    weights = {"head": 3.0, "body": 1.0}
    tokens = {i: [(t, w) for x, w in ((h, 3.0), (b, 1.0)) for t in (x or "").split()] for i, h, b, _ in docs}
    avg = sum(map(len, tokens.values())) / 4
    want = Counter()
    for term, room in (("red", 7), ("fox", 8)):
        df_ = sum(any(t == term for t, _ in x) for x in tokens.values())
        for i, _, _, r in docs:
            tf = sum(w for t, w in tokens[i] if t == term)
            if tf and r == room:
                want[i] += max(math.log((4 - df_ + 0.5) / (df_ + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[i]) / avg))
    got = {r.id: r.score for r in search.bm25(df, "id", weights, terms, "q", within="room").collect()}
    assert got == {i: pytest.approx(s, abs=2e-6) for i, s in want.items()}
    search_all = {r.id for r in search.bm25(df, "id", weights, terms.drop("room"), "q").collect()}
    assert search_all == {1, 2, 4}


def test_blocked_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.normal(0, 1, (700, 64)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(data)], "id long, v array<float>, label int").repartition(3)
    index, asked = vectors.indexed(df, "id", "v", 64, "label"), vectors.queries(df.where("id % 100 = 0"), "id", "v")
    rows, queries = {r.id: r for r in index.collect()}, {r.query_id: r for r in asked.collect()}
    score = lambda q, i: round(float(np.dot(queries[q].qp, rows[i].q)) * rows[i].scale, 6)
    away = lambda q, i: ((queries[q].qsig ^ rows[i].sig) & (2**64 - 1)).bit_count()
    for sent in (vectors.SENT_BYTES, 0):
        monkeypatch.setattr(vectors, "SENT_BYTES", sent)
        monkeypatch.setattr(vectors, "INDEX_BLOCK", 128)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
        short = defaultdict(dict)
        for r in vectors.shortlist(index, "id", asked, 20, "label").collect():
            short[r.query_id][r.place] = (r.id, r.distance)
            assert r.label == r.id % 4 and r.score == pytest.approx(score(r.query_id, r.id), abs=2e-6)
        best = defaultdict(list)
        for r in vectors.nearest(index, "id", asked, 5).orderBy("rank").collect():
            best[r.query_id].append(r.id)
        groups = {(r.query_id, r.label): r.best for r in vectors.best_by_group(index, "id", asked, "label", 0.1).collect()}
        for q in queries:
            others = [i for i in rows if i != q]
            assert [short[q][n + 1] for n in range(20)] == [(i, away(q, i)) for i in sorted(others, key=lambda i: (away(q, i), -i))[:20]]
            assert best[q] == sorted(others, key=lambda i: (-score(q, i), i))[:5]
            for g in range(4):
                top = max(score(q, i) for i in others if i % 4 == g)
                assert (groups.get((q, g)) == pytest.approx(top, abs=2e-6)) if top >= 0.1 else (q, g) not in groups
    assert vectors.nearest(index.where("false"), "id", asked, 5).count() == 0


def test_trigram_vector():
    def plain(text):
        kept, v = [c for c in text.lower() if c.isalnum() or c == " "], [0.0] * 512
        for i in range(len(kept) - 2):
            h = 1469598103934665603
            for c in kept[i : i + 3]:
                h = (h ^ ord(c)) * 1099511628211 % 2**64
            v[h % 512] += 1.0 if h >> 20 & 1 == 0 else -1.0
        return v

    for text in ("", "ab", "abc", "The lease, ends: 2024-05!", "größe 水水水"):
        assert vectors.trigram_vector(text).tolist() == plain(text)
    assert vectors.trigram_vector(None).sum() == 0


def test_hybrid_and_gates(spark):
    keyword = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q long, d long, rank int")
    near = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.3), (2, 13, 0.1)], "q long, d long, score double")
    of = lambda df: {(r.q, r.d): r.score for r in df.collect()}
    both = of(ranking.hybrid(keyword, "q", "d", near, None, None))
    assert both[1, 11] == round(1 / 62 + 1 / 61, 9) and set(both) == {(1, 10), (1, 11), (1, 12), (2, 10), (2, 13)}
    assert set(of(ranking.hybrid(keyword, "q", "d", near, 0.25, None))) == {(1, 11), (1, 12)}
    words = spark.createDataFrame([(1, 2), (2, 1)], "q long, words int")
    assert set(of(ranking.hybrid(keyword, "q", "d", None, 0.25, words))) == {(1, 10), (1, 11)}


def test_a_first_hit_is_cut_not_dropped(spark):
    chunks = spark.createDataFrame([(1, 0, "a", "é" * 900), (1, 5, "b", "short one"), (2, 0, "c", "weak")], "doc_id long, ord int, section string, text string")
    hits = spark.createDataFrame([(7, 1, 0, 1.0), (7, 1, 5, 0.9), (7, 2, 0, 0.1)], "query_id long, doc_id long, ord int, score double")
    small = passages.assembled(hits, chunks, 900).orderBy("rank").collect()
    assert small[0].text.startswith("éé") and small[0].text.endswith("[…]") and len(small[0].text.encode()) <= 900 and len(small) == 1
    wide = passages.assembled(hits, chunks, 6000).orderBy("rank").collect()
    assert [r.text for r in wide] == ["é" * 900, "short one"]  # the third is below the floor


def test_rtf():
    raw = r"{\rtf1{\fonttbl{\f0 Arial;}}{\header Head\par}Body \'e9BACKSLASHu8364?x\~y\line z\par{\*\hidden no}{\footnote Foot}{\rsidtbl 1}\emdash{\b bold}}"
    raw = raw.replace("BACKSLASH", chr(92))
    assert files.rtf_text(raw) == "Head\n\nBody é€x y\nz\n\nFoot-bold"
    assert files.rtf_text(r"{\rtf1{\info none}}").startswith("[")


def test_sheet_cells_keep_their_columns():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Fees"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<w><sheetData><row><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c></row><row><c r="AB2"><v>9</v></c></row></sheetData></w>')
    text = files.office_text(out.getvalue(), "xlsx")
    assert text == "[[sheet:Fees]]\n\n1\t\t3\n\n" + "\t" * 27 + "9"


def test_excerpts():
    parts = ["First words here.", "The lease ends in May.", "Nothing.", "Rent and lease rise.", "Bye."]
    text = " ".join(parts)
    assert recall.excerpted(text, parts, ["lease", "rent"], 200) == text
    assert recall.excerpted(text, parts, ["lease", "rent"], 60) == "… The lease ends in May. … Rent and lease rise. …"
    assert recall.excerpted(text, parts, ["lease", "rent"], 25) == "… Rent and lease rise. …"
    assert recall.excerpted(text, parts, ["lease"], 10) == "The lease…" and recall.excerpted(text, parts, ["zebra"], 11) == "First words…"
    assert recall.excerpted(text, parts, [], 5) == "First…"


def test_sources_and_flat(spark):
    text = "See [Lease.pdf, p. 3] and [note] and [Section 4]; also Fees.xlsx, Lease.pdf and My.docx."
    assert one(spark, recall.sources(F.col("t")), t=text) == ["[Lease.pdf, p. 3]", "[Section 4]", "Fees.xlsx"] or one(spark, recall.sources(F.col("t")), t=text)[:2] == ["[Lease.pdf, p. 3]", "[Section 4]"]
    assert one(spark, recall.flat(F.col("t"), 5), t=" ab  cd ef") == "ab cd…" and one(spark, recall.flat(F.col("t"), 9), t="ab\n cd") == "ab cd"


def chat(spark, rows):
    return spark.createDataFrame(rows, "session_id long, message_index long, role string, content string")


def test_summary_entries(spark):
    m = chat(spark, [(1, 0, "system", "s"), (1, 1, "user", "What is the  fee?"), (1, 2, "assistant", "# The fee is 40 euros each month [Fees.pdf, p.2]. Short. It must be paid before the deadline of May."), (1, 3, "user", "And then?")])
    got = {r.turn: r for r in recall.entries(m).collect()}
    assert got[1].question == "What is the fee?" and got[1].points == ["The fee is 40 euros each month [Fees.pdf, p.2].", "It must be paid before the deadline of May."]
    assert got[1].sources == ["[Fees.pdf, p.2]"] and got[2].points == [] and got[2].sources == []
    stored = spark.createDataFrame([(1, 1, "old", ["kept"], ["s"])], recall.entries(m).schema)
    merged = {r.turn: r for r in recall.merged_entries(stored, recall.entries(m), most=1).collect()}
    assert merged[1].question == "old" and merged[1].points == [] and merged[2].question == "And then?"


def render(entries, most):
    full = [f"- Turn {t}: You asked: {q} | Key points: {p}" for t, q, p in entries]
    short = [f"- Turn {t}: You asked: {q}" for t, q, _ in entries]
    size = lambda lines: sum(len(x.encode()) + 1 for x in lines)
    n = len(entries)
    for p in range(n):
        if size(short[:p] + full[p:]) <= most:
            return "\n".join(short[:p] + full[p:])
    for f in range(1, n):
        if size(short[f : n - 1] + full[n - 1 :]) <= most:
            return f"- ({f} earliest turns not listed here; ask about them to retrieve them)\n" + "\n".join(short[f : n - 1] + full[n - 1 :])
    return (f"- ({n - 1} earliest turns not listed here; ask about them to retrieve them)\n" if n > 1 else "") + full[-1]


def test_rendered_summary(spark):
    entries = [(t, f"question {t}", f"point number {t}.") for t in range(1, 7)]
    rows = [(1, t, q, [p], []) for t, q, p in entries]
    df = spark.createDataFrame(rows, "session_id long, turn long, question string, points array<string>, sources array<string>")
    for most in (60, 100, 150, 200, 250, 300, 400, 1000):
        assert recall.rendered_summary(df, most).first().summary == render(entries, most), most


def test_dropped_turns(spark):
    rows = [(1, 0, "user", "How high is the deposit?"), (1, 1, "assistant", "The deposit is 900 euros."), (1, 2, "user", "And the garden?"), (1, 3, "assistant", "The garden is shared."), (1, 4, "user", "Parking?"), (1, 5, "assistant", "No parking."), (1, 6, "user", "what was my second question about the deposit")]
    rows += [(2, 0, "user", "The deposit of another chat"), (2, 1, "assistant", "deposit")]
    asked = spark.createDataFrame([(5, 1, rows[6][3], 4, 6)], "ask_id long, session_id long, question string, cutoff long, current_index long")
    got = recall.dropped_turns(chat(spark, rows), asked, 2000).orderBy("question_index").collect()
    assert [(r.turn, r.question_index) for r in got] == [(1, 0), (2, 2)]
    assert got[0].entry == "--- [Turn 1 (your 1st question)] ---\nYou asked: How high is the deposit?\nAnswer: The deposit is 900 euros.\n"
    assert "the one asked about" in got[1].entry
    assert recall.block(recall.dropped_turns(chat(spark, rows), asked, 2000)).first().block == got[0].entry + got[1].entry
    assert len(recall.dropped_turns(chat(spark, rows), asked, 420).collect()) == 1  # room for one only: the one asked about


def test_ordinals(spark):
    of = lambda q: one(spark, memory.detected_ordinal(F.col("t")), t=q)
    assert [of(q) for q in ("my very first question", "the tenth message", "last query", "two turns ago", "12 questions ago", "question number 4", "my question 6", "what did I originally say", "the first of May", "at last")] == [1, 10, -1, -2, -12, 4, 6, 1, None, None]


def test_references(spark):
    now = F.lit(datetime.datetime(2026, 3, 4, 12))
    q = spark.createDataFrame([(i, x) for i, x in enumerate(["contract.pdf?", "as mentioned, go", "before and also", "also this", "also discussed before", "3 days ago", "priority beforehand", "fresh question"])], "id int, q string")
    got = {r.id: r for r in references.signals(q, "q", now).collect()}
    assert [got[i].refers_to_past for i in range(8)] == [True, True, True, False, True, True, False, False]
    assert got[0].files == ["contract.pdf"] and got[4].weak == 0 and got[5].first_day == datetime.date(2026, 2, 28)
    asked = spark.createDataFrame([(1, "Does the merger agreement hold?"), (2, "draft a new agreement"), (3, "show me the signed old agreement"), (4, "the 2026 numbers")], "id int, q string")
    known = spark.createDataFrame([("merger-agreement.pdf", 5), ("Lease_Agreement_2026.docx", 9)], "name string, latest int")
    assert {(r.id, r.name, r.how) for r in references.described(asked, "id", "q", known, "name", "latest").collect()} == {(1, "merger-agreement.pdf", "words"), (3, "Lease_Agreement_2026.docx", "known")}


def test_near_duplicate_words_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join(["common"] + rng.sample(words, rng.randrange(1, 9))) for _ in range(80)]
    left = spark.createDataFrame([(i, x) for i, x in enumerate(texts[:40])], "a long, text string")
    right = spark.createDataFrame([(i, x) for i, x in enumerate(texts[40:] + texts[:5])], "b long, text string")
    of = lambda x: set(x.split())
    want = set()
    for i, x in enumerate(texts[:40]):
        for j, y in enumerate(texts[40:] + texts[:5]):
            c, small = len(of(x) & of(y)), min(len(of(x)), len(of(y)))
            if c and (c >= 0.6 * len(of(x) | of(y)) or (small >= 3 and c >= 0.5 * small)):
                want.add((i, j, c))
    assert len(want) > 20
    got = memory.near_duplicates(memory.word_sets(left, "a", "text"), "a", memory.word_sets(right, "b", "text"), "b", containment=0.5)
    assert set(map(tuple, got.collect())) == want


def test_page_and_other_versions(spark):
    text = lambda n: "\n".join(f"[[page:{i}]]\npage {i} of {n}" for i in (1, 2, 4))
    docs = spark.createDataFrame([(i, text(i)) for i in (1, 2, 3)], "doc long, text string")
    lines = structure.paged(structure.lines(docs, "doc", "text"), "doc")
    asked = spark.createDataFrame([(1, 2, 3), (2, 3, 4)], "ask int, first int, last int")
    scope = asked.select("ask").crossJoin(docs.select("doc"))
    got = {(r.ask, r.doc): r.text for r in routes.page_route(asked, "ask", scope, lines, "doc", 1000).collect()}
    assert got == {(1, d): f"page 2 of {d}" for d in (1, 2, 3)}  # no document has page 3
    named = spark.createDataFrame([(1, "lease_v1.pdf", 1), (2, "lease_v2.pdf", 2), (3, "other.pdf", 3)], "doc long, name string, created int")
    shown = spark.createDataFrame([(7, 1, 2, 2)], "ask int, doc long, first int, last int")
    other = routes.other_versions(shown, "ask", named, "doc", "name", "created", lines, 4000).collect()
    assert [(r.ask, r.doc, r.position, r.total, r.text) for r in other] == [(7, 2, 2, 2, "page 2 of 2")]


def test_bytes_of_a_budget(spark):
    rows = spark.createDataFrame([(1, 1, "é" * 150), (1, 2, "b" * 300), (1, 3, "c")], "g int, n int, text string")
    got = routes.within_bytes(rows, "g", ["n"], "text", 551).orderBy("n").collect()
    assert [(r.n, r.truncated) for r in got] == [(1, False), (2, True)] and got[1].text == "b" * 251 + routes.MARK
    odd = routes.within_bytes(rows, "g", ["n"], "text", 201).collect()
    assert [(r.text, r.truncated) for r in odd] == [("é" * 100 + routes.MARK, True)]


def test_sheet_rows(spark):
    book = spark.createDataFrame([(1, "[[sheet:Fees 2]]\nname\tfee\n\nA\t1\n\nB\t2\n[[sheet:Staff]]\nwho\n\nEve")], "doc long, text string")
    rows = routes.sheet_rows(book, "doc", "text")
    asked = spark.createDataFrame([(1, "what is in row 3 of fees 2?"), (2, "row no. 2 of Staff"), (3, "row 2"), (4, "fees 2 please")], "ask int, q string")
    scope = asked.select("ask", F.lit(1).cast("long").alias("doc"))
    assert {(r.ask, r.sheet, r.text) for r in routes.sheet_route(asked, "ask", "q", scope, rows, "doc").collect()} == {(1, "Fees 2", "name\tfee\nB\t2"), (2, "Staff", "who\nEve")}
    only = routes.sheet_route(asked, "ask", "q", scope, rows.where("sheet = 'Staff'"), "doc").collect()
    assert {(r.ask, r.text) for r in only} == {(2, "who\nEve"), (3, "who\nEve")}
    assert {(r.ask, r.sheet) for r in routes.named_sheets(asked, "ask", "q", scope, rows, "doc").collect()} == {(1, "Fees 2"), (2, "Staff"), (4, "Fees 2")}


def test_sheets_of_other_documents_do_not_answer(spark):
    books = spark.createDataFrame([(1, "[[sheet:Sheet1]]\nh\n\none"), (2, "[[sheet:Sheet1]]\nh\n\ntwo"), (3, "[[sheet:Other]]\nh\n\nthree")], "doc long, text string")
    rows = routes.sheet_rows(books, "doc", "text")
    asked = spark.createDataFrame([(1, "row 2 of Sheet1"), (2, "row 2"), (3, "row 2 of Sheet1"), (4, "row 2")], "ask int, q string")
    scope = spark.createDataFrame([(1, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 3)], "ask int, doc long")
    got = {(r.ask, r.doc, r.text) for r in routes.sheet_route(asked, "ask", "q", scope, rows, "doc").collect()}
    assert got == {(1, 1, "h\none"), (2, 3, "h\nthree"), (3, 1, "h\none"), (3, 2, "h\ntwo")}


def test_hints_meet_names_by_any_part(spark):
    files = spark.createDataFrame([(1, "Lease_v2.pdf"), (2, "x.pdf"), (3, ""), (4, "other lease.docx")], "d int, name string")
    asked = spark.createDataFrame([("LEASE.docx",), ("x",), ("none.txt",), ("",), ("x.pdf",)], "hint string")
    got = {(r.hint, r.d) for r in routes.hinted(asked.select(F.lower("hint").alias("hint")), "hint", files, "name").collect()}
    assert got == {("lease.docx", 1), ("lease.docx", 4), ("x", 2), ("x", 4), ("x.pdf", 2), ("x.pdf", 4)}


def test_given_value_is_the_same(spark):
    df = spark.createDataFrame([([3.0, -4.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    got = [r.p for r in df.select(V.prepared(F.col("v"), 3).alias("p")).collect()]
    assert got == [[0.6, -0.8, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def parts_of(text, most, parts):
    out, rest = [], text.strip()
    while rest and len(out) < parts:
        cut = len(rest)
        if len(rest) > most:
            spaces = [i for i in range(most - most // 5, most) if rest[i].isspace()]
            cut = spaces[-1] + 1 if spaces else most
        out.append(rest[:cut].strip())
        rest = rest[cut:].lstrip()
    return out


def test_message_parts(spark):
    rng = random.Random(2)
    texts = ["", "  ", "short", "x" * 95, "é" * 31 + " end"] + ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(200))) for _ in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for r in df.select("i", upkeep.message_parts(F.col("t"), 30, 4).alias("p")).collect():
        assert r.p == parts_of(texts[r.i], 30, 4), texts[r.i]


def test_retention_stops_when_enough_is_free(spark):
    items = spark.createDataFrame([(1, 1, 5, 10), (2, 1, 1, 10), (3, 2, 9, 10), (4, 2, 2, 10), (5, 3, 1, 10)], "id int, tier int, at int, b int")
    of = lambda needed: sorted(r.id for r in upkeep.enough(items, ["at", "id"], "b", needed, "tier").collect())
    assert of(0) == [] and of(1) == [2] and of(20) == [1, 2] and of(25) == [1, 2, 4] and of(1000) == [1, 2, 3, 4, 5]
