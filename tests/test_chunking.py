"""Chunks of paged texts, sheets and lists with expected values; section numbers in Arabic, Roman and Chinese."""

import pytest

from tessera.operators import structure


def brief(text):
    return [(c["text"], c["page"], c["section"], c["location"]) for c in structure.chunk(text)]


@pytest.mark.parametrize(("line", "want"), [
    ("When must I register my company?", (9, "When must I register my company?")),
    ("when must i?", None),
    ("Section 4.2(b) Payment", (3, "Section 4.2(b): Payment")),
    ("Section 5 of the Act applies", None),
    ("ARTICLE IV", (1, "ARTICLE IV")),
    ("Article IV - Term and Termination", (1, "Article IV: Term and Termination")),
    ("§ 12 Fristen", (1, "§ 12: Fristen")),
    ("Artículo 3. Objeto", (1, "Artículo 3: Objeto")),
    ("第十二条 租金", (2, "第十二条 租金")),
    ("第三章 总则", (1, "第三章 总则")),
    ("WHEREAS the parties have agreed as follows", (1, "WHEREAS the parties have agreed as follows")),
    ("GENERAL TERMS", (1, "GENERAL TERMS")),
    ("2.1 Terms of use", (2, "2.1 Terms of use")),
    ("3. Scope", (1, "3. Scope")),
    ("(a) Scope", (3, "(a) Scope")),
    ("(a) the tenant pays;", None),
    ("3. the tenant pays", None),
    ("Payment ..... 12", None),
    ("Articles are fine", None),
    ("Part of the plan", None),
    ("", None),
])
def test_headings(line, want):
    assert structure.heading(line) == want


def test_units_of_a_page_without_blank_lines():
    text = "Intro line one\nline two\nWhat is due?\nMoney.\n- first item\n- second item\ngoes on\n\nEnd"
    got = [(u.kind, text.encode()[u.start : u.end].decode()) for u in structure.units(text)]
    assert got == [("text", "Intro line one\nline two"), ("heading", "What is due?"), ("text", "Money."), ("text", "- first item"), ("text", "- second item\ngoes on"), ("text", "End")]


def test_a_title_over_two_lines():
    text = "3. CERTIFY THAT YOUR COMPANY\nMEETS THE REQUIREMENTS\nBody."
    heads = [u for u in structure.units("CERTIFY THAT YOUR COMPANY\nMEETS THE REQUIREMENTS\nBody.") if u.kind == "heading"]
    assert [u.label for u in heads] == ["1\tCERTIFY THAT YOUR COMPANY MEETS THE REQUIREMENTS"]
    assert structure.chunk(text)[-1]["text"].endswith("Body.")


def test_paged_text():
    page = lambda n, body: f"[[page:{n}]]\nACME Lease 2024 - page {n}\n{body}\n{n}"
    text = "\n".join([page(1, "Section 1 Rent\nRent is due monthly."), page(2, "It may rise once a year."), page(3, "Section 2 End\nNotice takes three months."), page(4, "Signed.")])
    assert brief(text) == [
        ("Section 1 Rent\nRent is due monthly.", 1, "Section 1: Rent", None),
        ("It may rise once a year.", 2, "Section 1: Rent", None),
        ("Section 2 End\nNotice takes three months.", 3, "Section 2: End", None),
        ("Signed.", 4, "Section 2: End", None),
    ]


def test_sheets_are_numbered_and_carry_their_header():
    rows = [f"item {i}\t{'x' * 60}" for i in range(2, 40)]
    text = "[[sheet:Fees]]\nname\tfee\n\n" + "\n\n".join(rows) + "\n[[sheet:Staff]]\nwho\n\nEve\n[[clear:]]\nAfter"
    raw, got = text.encode(), structure.chunk(text)
    fees = [c for c in got if c["location"] == "Sheet: Fees"]
    assert len(fees) > 2 and fees[0]["row_from"] == 1 and fees[-1]["row_to"] == 39
    assert all(b["row_from"] == a["row_to"] + 1 for a, b in zip(fees, fees[1:]))
    assert fees[0]["prefix_start"] is None and not fees[0]["text"].startswith("name\tfee\nname\tfee")
    for c in fees[1:]:
        assert raw[c["prefix_start"] : c["prefix_end"]] == b"name\tfee" and c["text"].startswith(f"name\tfee\nitem {c['row_from']}\t")
        assert c["byte_end"] - c["byte_start"] <= structure.SHEET_BYTES
    staff = [c for c in got if c["location"] == "Sheet: Staff"]
    assert [(c["row_from"], c["row_to"], c["text"]) for c in staff] == [(1, 2, "who\n\nEve")]
    assert got[-1]["text"] == "After" and got[-1]["location"] is None and got[-1]["row_from"] is None


def test_long_paragraphs_overlap_by_whole_words():
    words = " ".join(f"word{i:04d}" for i in range(900))
    got = structure.chunk("Section 1 Long\n" + words)
    body = [c for c in got if "word" in c["text"]]
    assert len(body) > 4 and all(len(c["text"].encode()) <= structure.TARGET_BYTES for c in body)
    assert all(w.startswith("word") and len(w) == 8 for c in body for w in c["text"].replace("Section 1 Long", "").split())
    ends = [(c["byte_start"], c["byte_end"]) for c in body]
    assert all(b[0] < a[1] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("text", ["契約" * 4000, "x" * 9000, ("é " * 3000).strip()])
def test_texts_without_sentences(text):
    got = structure.chunk(text)
    raw, covered = text.encode(), bytearray(len(text.encode()))
    for c in got:
        assert raw[c["byte_start"] : c["byte_end"]].decode() == c["text"]
        covered[c["byte_start"] : c["byte_end"]] = b"\1" * (c["byte_end"] - c["byte_start"])
    assert not bytes(b for b, k in zip(raw, covered, strict=True) if not k).strip()


@pytest.mark.parametrize(("label", "want"), [
    ("Section 12.3 (b)", "12.3.(b)"), ("12.3(b)", "12.3.(b)"), ("Article IV", "iv"), ("Article IV: Civil terms", "iv"), ("第十二条", "12"), ("第一百零三条", "103"),
    ("第二千三百四十五章", "2345"), ("第7款", "7"), ("第二十章", "20"), ("Civil code", ""), ("general", ""), ("Clause civil", ""),
])
def test_section_keys(spark, label, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(structure.section_key(F.lit(label)).alias("k")).first().k == want


def test_citations(spark):
    from pyspark.sql import functions as F

    c = lambda *x: spark.range(1).select(structure.citation(*[F.lit(v) for v in x]).alias("c")).first().c
    none = None
    assert c(3, 5, "Rent") == "pp. 3-5, Rent" and c(3, 3, none) == "p. 3"
    assert c(none, none, none, "Sheet: Fees", 2, 9) == "Sheet: Fees, rows 2-9" and c(none, none, none, "Sheet: Fees", 4, 4) == "Sheet: Fees, row 4"
    assert c(none, none, "Rent", "Slide: 2", none, none) == "Slide: 2, Rent"
