"""Operators on small literals: what the SQL comparison cannot show."""

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import stemming
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import memory, quality, ranking, routing, store, structure
from tessera.sources import files


def test_porter_examples():
    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "generalizations": "gener", "oscillators": "oscil", "Éclair": "eclair"}
    assert {w: stemming.stem(w) for w in known} == known


def test_porter_column(spark):
    rows = spark.createDataFrame([("running",), (None,), ("running",)], "w string").select(stemming.porter("w").alias("s")).collect()
    assert [r.s for r in rows] == ["run", None, "run"]


def test_fusion_ties_by_id(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "q int, id int, rank int")
    out = ranking.ranked(ranking.fused([a, b], "q", "id"), "q", "id").orderBy("rank").collect()
    assert [r.id for r in out] == [10, 20]


def test_fitting_skips_what_is_too_large():
    assert ranking.fitting([5, 9, 4, 1], 10) == [0, 2, 3]


def test_scope_none_and_empty(spark):
    rows = spark.range(5).withColumnRenamed("id", "k")
    assert store.scoped(rows, None, "k").count() == 5
    assert store.scoped(rows, rows.where("false"), "k").count() == 0


def test_upsert_fills_and_bumps(spark):
    old = spark.createDataFrame([(1, None, 5), (2, "b", 1)], "k int, path string, seen int")
    new = spark.createDataFrame([(1, "a", 3), (2, "z", 9), (3, "c", 1), (3, "d", 2)], "k int, path string, seen int")
    assert sorted(map(tuple, store.upsert(old, new, "k", ["path"], ["seen"]).collect())) == [(1, "a", 5), (2, "b", 9), (3, "c", 1)]


def test_families(spark):
    f = spark.createDataFrame([(1, "Lease final.docx", 1), (2, "lease v2.docx", 2), (3, "memo.txt", 1)], "id int, name string, at int")
    out = store.families(f, "id", "name", "at").orderBy("position").collect()
    assert [(r.id, r.position, r.is_latest) for r in out] == [(1, 1, False), (2, 2, True)]


def test_tree_with_cycle_ends(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("b", "c")], "id string, parent_id string")
    assert sorted(r.node for r in store.descendants(edges, F.col("id") == "a").collect()) == ["a", "b", "c"]


def test_cascade(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 1), (2, 2)], "child int, parent int")
    out = store.delete_with_children(p, p.where("id = 1"), "id", {"c": (c, "parent")})
    assert [r.id for r in out["parents"].collect()] == [2] and [r.child for r in out["c"].collect()] == [2]


def test_vector_forms(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    out = df.select(V.prepared(F.col("v"), 4).alias("p"), V.quantised(F.col("v")).alias("q"), V.signature(F.col("v")).alias("s")).collect()
    assert out[0].p == pytest.approx([0.6, 0.8, 0, 0]) and list(out[0].q) == [95, 127] and out[0].s == 3
    assert out[1].p == [0, 0, 0, 0] and list(out[1].q) == [0, 0] and out[1].s == 0


def test_chunks_cover_the_text():
    rng = random.Random(3)
    words = ["alpha", "beta", "größe", "契約", "delta."]
    body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(30))
    text = "[[page:1]]\nSECTION 1\n" + body + "\n[[page:2]]\n2.1 Terms\n" + body
    raw = text.encode()
    covered = bytearray(len(raw))
    for c in structure.chunk(text):
        part = raw[c["byte_start"] : c["byte_end"]].decode()
        assert part.strip() == c["text"].strip()
        assert len(c["text"].encode()) <= structure.MOST_BYTES
        covered[c["byte_start"] : c["byte_end"]] = b"\1" * (c["byte_end"] - c["byte_start"])
    left = bytes(b for b, k in zip(raw, covered, strict=True) if not k).decode()
    assert set(left.split("\n")) <= {"", "[[page:1]]", "SECTION 1", "[[page:2]]", "2.1 Terms"}
    assert {c["page"] for c in structure.chunk(text)} == {1, 2}
    assert {c["section"] for c in structure.chunk(text)} == {"SECTION 1", "SECTION 1 › 2.1 Terms"}


def test_headings():
    assert structure.heading_level("Section 4.2 Payment") == 2
    assert structure.heading_level("GENERAL TERMS") == 1
    assert structure.heading_level("第 3 章 总则") is not None
    assert structure.heading_level("Payment ..... 12") is None
    assert structure.heading_level("This is prose, and it goes on.") is None


def test_empty_documents_have_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert [r.doc_id for r in structure.chunks(df, "doc_id", "text").collect()] == [3]


def test_page_of_lines_carries_on(spark):
    df = spark.createDataFrame([(1, "a\n[[page:4]]\nb\r\nc")], "doc_id long, text string")
    rows = structure.paged(structure.lines(df, "doc_id", "text"), "doc_id").orderBy("line_no").collect()
    assert [(r.line, r.page) for r in rows] == [("a", None), ("b", 4), ("c", 4)]


@pytest.mark.parametrize(
    ("phrase", "start", "end"),
    [("on 2024-02-03", "2024-02-03", "2024-02-03"), ("2 weeks ago", "2024-05-07", "2024-05-09"), ("yesterday", "2024-05-21", "2024-05-21"), ("last wednesday", "2024-05-15", "2024-05-15"), ("nothing", None, None)],
)
def test_date_windows(spark, phrase, start, end):
    now = spark.createDataFrame([(phrase, datetime.datetime(2024, 5, 22, 9))], "p string, now timestamp")
    a, b = routing.date_window(F.col("p"), F.col("now"))
    row = now.select(a.cast("string"), b.cast("string")).first()
    assert row[:] == ((start, end) if phrase != "2 weeks ago" else ("2024-05-07", "2024-05-09"))


def test_exchange_without_answer(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "user", "r"), (1, 2, "assistant", "a")], "session_id int, message_index int, role string, content string")
    assert [(r.question, r.answer) for r in memory.exchanges(m).orderBy("question_index").collect()] == [("q", None), ("r", "a")]


def test_ordinals(spark):
    q = spark.createDataFrame([("my first question",), ("3 questions ago",), ("message number 12",), ("the last question",), ("hello",)], "q string")
    assert [r.o for r in q.select(memory.detected_ordinal(F.col("q")).alias("o")).collect()] == [1, -3, 12, -1, None]


def test_myers_is_shortest():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        ops = quality.myers(a, b)
        assert [a[x] for op, x, _ in ops if op != "insert"] == a and [b[y] for op, _, y in ops if op != "delete"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert sum(op == "equal" for op, _, _ in ops) == best[-1][-1]


def test_changed_paragraph_is_one_change():
    assert [op for op, _, _ in quality.differences(["a b c d", "same"], ["a b c e", "same", "new"])] == ["change", "equal", "insert"]


def test_echo_is_stripped():
    assert quality.stripped("## Context\nprompt text\n\nAnswer.") == "Answer."


def test_eviction(spark):
    e = spark.createDataFrame([(1, "a", 5, 10), (2, "a", 5, 20), (3, "b", 5, 30), (4, "b", 5, 40)], "id int, s string, b int, used int")
    assert sorted(r.id for r in quality.evicted(e, "b", F.col("used"), 10).collect()) == [1, 2]
    assert sorted(r.id for r in quality.evicted(e, "b", F.col("used"), 100, 1, "s").collect()) == [1, 3]


def test_rtf_and_html():
    assert files.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par \u228?\'e9\tab x}") == "Hello\n\näé\tx"
    assert files.html_text("<head><title>t</title></head><p>A &amp; B</p><script>x</script><p>C") == "A & B\n\nC"
    assert files.decoded("﻿ä".encode()) == "ä" and files.decoded("ä".encode("utf-16")) == "ä" and files.decoded(b"\xe4") == "ä"


def test_read_files(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.md").write_text("text")
    rows = {r["name"]: (r.text, r.status) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"] == ("One\ttwo", "ok") and rows["b.docx"][1] == "failed" and rows["c.md"] == ("text", "ok")


def test_text_helpers(spark):
    row = spark.range(1).select(T.ordinal(F.lit(12)), T.ordinal(F.lit(23)), T.human_bytes(F.lit(1536)), T.token_estimate(F.lit("12345678")), T.file_stem(F.lit("a.b.pdf"))).first()
    assert row[:] == ("12th", "23rd", "1.5 KB", 10, "a.b")


def test_quotes_are_checked_on_the_cited_pages(spark):
    far = "filler " * 40
    answer = f'{far}It says "The tenant may end, this lease" [Lease.pdf, p. 4], "The tenant may end this lease" [Lease.pdf, p. 7], "notice is six months long" [lease.pdf, pp. 4-5] and "never stood anywhere at all". Too short: "six months".'
    shown = [(1, "Lease.pdf", 4, 4, "The TENANT may end this lease; notice is"), (1, "Lease.pdf", 5, 5, "six months long."), (1, "Lease.pdf", 7, 7, "Rent."), (2, "Lease.pdf", 7, 7, "the tenant may end this lease")]
    out = quality.verified_quotes(spark.createDataFrame([(1, answer)], "k int, answer string"), "k", "answer", spark.createDataFrame(shown, "k int, file string, page_from int, page_to int, text string"))
    assert [(r.n, r.page_from, r.found) for r in out.orderBy("n").collect()] == [(0, 4, True), (1, 7, False), (2, 4, True), (3, None, False)]


def test_tree_deeper_than_its_bound_is_an_error(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "id string, parent_id string")
    assert store.descendants(edges, F.col("id") == "a", 4).count() == 4
    with pytest.raises(RuntimeError):
        store.descendants(edges, F.col("id") == "a", 2)
