"""Citations that are resolved to documents, and rankings that are judged by pages."""

from tessera.operators import quality


def test_citations_find_their_document(spark):
    cited = [(1, 0, "lease.pdf", 2, 3), (1, 1, "old.docx", None, None), (1, 2, None, 9, 9), (1, 3, "gone.txt", 1, 1), (1, 4, "LEASE.PDF", 8, 8), (1, 5, "lease.pdf", 1, 1), (2, 0, None, 4, 4), (2, 1, "", None, None), (3, 0, None, 1, 1), (4, 0, "a.pdf", 1, 1)]
    known = [(1, 10, 0, "Lease.pdf", 5, False), (1, 11, 1, "very old.pdf", None, True), (2, 20, 0, "only.pdf", 4, False), (3, 30, 0, "a.pdf", 9, False), (3, 31, 1, "b.pdf", 9, False)]
    shown = [(1, 10, 2, 3), (2, 20, 4, None), (3, 30, 2, 9)]
    out = quality.resolved_citations(
        spark.createDataFrame(cited, "k long, n int, file string, page_from int, page_to int"), "k",
        spark.createDataFrame(known, "k long, doc long, place int, name string, pages int, full boolean"),
        spark.createDataFrame(shown, "k long, doc long, page_from int, page_to int"),
    )
    got = {(r.k, r.n): (r.doc, r.verdict) for r in out.collect()}
    assert got == {
        (1, 0): (10, "ok"), (1, 1): (11, "ok"), (1, 2): (11, "ok"), (1, 3): (None, "not provided"), (1, 4): (10, "no such page"), (1, 5): (10, "page not shown"),
        (2, 0): (20, "ok"), (2, 1): (20, "ok"), (3, 0): (None, "ambiguous"), (4, 0): (None, "not provided"),
    }


def test_hits_by_page(spark):
    ranked = spark.createDataFrame([(1, 7, 1, 1, 2), (1, 7, 2, 3, 4), (2, 7, 1, None, None), (3, 8, 1, 5, 5)], "q long, d long, rank int, page_from int, page_to int")
    relevant = spark.createDataFrame([(1, 7, 4), (2, 7, None), (3, 9, 5), (4, 7, 1)], "q long, d long, page int")
    assert {r.q: r.first for r in quality.hits_on_pages(ranked, relevant, "q", "d").collect()} == {1: 2, 2: 1, 3: None, 4: None}
