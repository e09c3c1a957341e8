"""Work that must not grow with the square of the input, and memory that must not grow with a batch."""

import tracemalloc

from pyspark.sql import functions as F

from tessera.operators import memory, past, positions, quality, references, routes, search, vectors


def shuffled(spark, make) -> int:
    """Rows that the stages of ``make`` write to shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        listed = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (listed.apply(i) for i in range(listed.size()))}

    before = stages()
    make().collect()
    return sum(n for at, n in stages().items() if at not in before)


def _versions(spark, many):
    files = spark.range(many).select(F.col("id").alias("doc"), F.concat(F.lit("lease_v"), "id", F.lit(".pdf")).alias("name"), F.col("id").alias("created"))
    lines = spark.range(many).select(F.col("id").alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.repeat(F.lit("x"), 700).alias("line"))
    shown = files.select(F.col("doc").alias("ask"), "doc", F.lit(1).alias("first"), F.lit(1).alias("last"))
    return routes.other_versions(shown, "ask", files, "doc", "name", "created", lines, 8000)


def test_other_versions_of_a_large_family_are_not_all_met(spark):
    assert shuffled(spark, lambda: _versions(spark, 600)) < 40 * 600  # pairs would be 359,400


def test_other_versions_pass_over_what_was_seen(spark):
    """One question has seen the first three versions, with different pages, and a fourth one of another family."""
    rows = [(i, f"lease_v{i}.pdf", i) for i in range(8)] + [(i, f"deed_v{i}.pdf", i) for i in range(8, 11)]
    files = spark.createDataFrame(rows, "doc long, name string, created long")
    lines = spark.createDataFrame([(i, p, p, f"{i}/{p} " + "y" * 400) for i in range(11) for p in (1, 2)], "doc long, page int, line_no int, line string")
    shown = spark.createDataFrame([(1, 0, 2, 2), (1, 1, 1, 1), (1, 2, 1, 2), (1, 9, 1, 1), (2, 7, 1, 2)], "ask long, doc long, first int, last int")
    got = [(r["ask"], r["doc"], r["text"][:3], r["truncated"]) for r in routes.other_versions(shown, "ask", files, "doc", "name", "created", lines, 8000).orderBy("ask", "position", "doc").collect()]
    assert got == [(1, 8, "8/1", False), (1, 10, "10/", False), (1, 3, "3/2", False), (1, 4, "4/2", False), (1, 5, "5/2", True)] + [(2, 0, "0/1", False), (2, 1, "1/1", False), (2, 2, "2/1", True)]


def test_described_names_meet_questions_over_their_rarest_word(spark):
    n = 400
    asked = spark.range(n).select(F.col("id").alias("q"), F.concat(F.lit("please show the contract of firm"), "id").alias("text"))
    files = spark.range(n).select(F.concat(F.lit("contract_firm"), "id", F.lit(".pdf")).alias("name"), F.col("id").alias("latest"))
    work = lambda: references.described(asked, "q", "text", files, "name", "latest").where("how = 'words'")
    assert sorted((r["q"], r["name"]) for r in work().collect()) == sorted((i, f"contract_firm{i}.pdf") for i in range(n))
    assert shuffled(spark, work) < 40 * n  # pairs over "contract" would be 160,000


def test_an_edit_script_needs_no_square_of_its_length():
    left, right = list(range(500)), list(range(-500, 0))
    tracemalloc.start()
    ops = quality.myers(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [op for op, _, _ in ops].count("delete") == [op for op, _, _ in ops].count("insert") == 500
    assert peak < 8 << 20  # all states of 1,000 rounds took more than 30 MB


def test_postings_are_grouped_without_a_shuffle_of_tokens(spark):
    docs = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i % (F.col("id") % 7 + 20))), " ")).alias("text"))
    plain = lambda df: sorted((r["term"], r["id"], r["n"], tuple(r["gaps"])) for r in df.collect())
    every = docs.select(F.explode(F.split("text", " ")).alias("term")).distinct()
    assert plain(positions.positional(docs, "id", "text")) == plain(positions.positional(docs, "id", "text", every))
    assert shuffled(spark, lambda: positions.positional(docs, "id", "text")) < 200  # 5,400 tokens
    twice = docs.unionByName(docs)
    assert plain(positions.positional(twice, "id", "text")) == plain(positions.positional(twice, "id", "text", every))


def test_contained_sets_meet_over_few_words(spark):
    """Ten words of which four stand in all texts: two of the six others are enough to find whoever has nine of the ten."""
    common = [f"c{i}" for i in range(4)]
    left = spark.createDataFrame([(i, common + [f"q{i}_{j}" for j in range(6)]) for i in range(20)], "q long, words array<string>")
    fill = lambda i: [f"f{i}_{j}" for j in range(60)]
    right = spark.createDataFrame([(i, common + fill(i) + [f"q{i}_{j}" for j in range(6 - i % 3)]) for i in range(300)], "d long, words array<string>")
    work = lambda: memory.near_duplicates(left, "q", right, "d")
    assert sorted((r["q"], r["d"], r["common"]) for r in work().collect()) == [(i, i, 10 - i % 3) for i in range(20) if i % 3 < 2]
    assert shuffled(spark, work) < 39_000  # 82,692 before


def steps_in_python(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") + plan.count("ArrowEvalPython")


def _texts(spark, many):
    return spark.range(many).select("id", F.concat(F.lit("text of number "), "id").alias("text"))


def test_a_task_of_the_vector_search_has_one_python_process(spark):
    """Each step in Python is a process for each task at the same time; packing and meeting were two."""
    index = vectors.indexed(spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i * F.col("id") % 7).cast("float")).alias("v")), "id", "v")
    asked = vectors.queries(index.select("id", F.col("q").alias("v")).where("id % 20 = 0"), "id", "v")
    near = vectors.nearest(index, "id", asked, 3)
    assert steps_in_python(near) == 1
    assert near.count() == 6


def test_products_within_a_label_need_no_python(spark):
    """Only the two embeddings are steps in Python."""
    own = vectors.trigram_embedded(_texts(spark, 20), "id", "text")
    asked = vectors.queries(vectors.trigram_embedded(_texts(spark, 2), "id", "text"), "id", "embedding", 512).withColumn("label", F.col("query_id"))
    near = vectors.near_of_same(vectors.indexed(own, "id", "embedding", 512).withColumn("label", F.col("id") % 2), "id", asked, "label", 0.2)
    assert steps_in_python(near) == 2
    got = {(r["query_id"], r["id"]): r["score"] for r in near.collect()}
    assert got[0, 0] > 0.99 and got[1, 1] > 0.99 and all(q == i % 2 for q, i in got)


def test_scores_are_summed_where_their_document_is(spark):
    """60 questions that share a word with 300 documents: 18,000 scores, of which the three best of each question leave a task."""
    docs = spark.range(300).select("id", F.concat(F.lit("lease of house "), "id").alias("text"))
    terms = spark.range(60).select(F.col("id").alias("q"), F.lit("lease").alias("term"))
    work = lambda: search.best(search.bm25(docs, "id", "text", terms, "q"), "q", "id", 3)
    assert [(r["q"], r["id"]) for r in work().orderBy("q", "rank").collect()] == [(q, d) for q in range(60) for d in range(3)]
    assert shuffled(spark, work) < 5_000  # 18,000 pairs and more


def test_what_a_question_sees_is_no_list_of_pairs(spark):
    n = 300
    asked = spark.range(n).select(F.col("id").alias("q"), F.lit("rent of the house").alias("question"), F.lit(None).cast("long").alias("first_day"), F.lit(None).cast("long").alias("last_day"), (F.col("id") % 2).alias("user"))
    files = spark.range(n).select(F.col("id").alias("doc"), F.concat("id", F.lit(".pdf")).alias("name"), F.lit("the rent of a house").alias("text"), F.lit(True).alias("ok"), F.col("id").alias("day"), (F.col("id") % 2).alias("user"))
    named = asked.where("q < 10").select("q", F.concat("q", F.lit(".pdf")).alias("file"))
    hits = asked.select("q", F.explode(F.array(F.col("q"), (F.col("q") + 1) % n, (F.col("q") + 2) % n)).alias("doc"), F.lit(1.0).alias("score"))
    pairs = asked.select("q", "user").join(files.select("doc", "user"), "user").select("q", "doc")
    plain = lambda scope: sorted((r["q"], r["doc"], r["rank"], r["named"]) for r in past.found_documents(asked, "q", "question", named, files, scope, hits).collect())
    assert plain("user") == plain(pairs)
    assert shuffled(spark, lambda: past.found_documents(asked, "q", "question", named, files, "user", hits)) < 20_000  # 45,000 pairs, twice
