"""Positional postings, clauses, isolated failures, draft histories, field merges and budgets, against plain versions."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import stemming
from tessera.operators import budget, fields, history, isolation, positions, routes

# --- positional postings ---------------------------------------------------------------------------------------------


def corpus():
    rng = random.Random(6)
    return [(i, " ".join(rng.choice("a b ab abc act of god force majeure ünder".split()) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(90, ""), (91, None), (92, "a " * 5000), (93, "of of of of")]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    path = f"file://{tmp_path_factory.mktemp('positions')}/index"
    positions.save(positions.positional(docs, "doc_id", "text"), path, 4)
    return docs, positions.stored(spark, path)


def test_places_come_back(indexed):
    want = {}
    for i, t in corpus():
        for at, w in enumerate((t or "").split()):
            want.setdefault((w, i), []).append(at)
    got = {(r.term, r.doc_id): (r.places, r.n) for r in positions.places(indexed[1]).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_beginnings(indexed):
    for p in ("a", "ab", "abc", "z", "ü", "ac"):
        want = {(w, i) for i, t in corpus() for w in (t or "").split() if w.startswith(p)}
        assert {(r.term, r.doc_id) for r in positions.prefix_matches(indexed[1], p).collect()} == want
    assert "term >= " in (plan := positions.prefix_matches(indexed[1], "ab")._jdf.queryExecution().toString()) or "GreaterThanOrEqual(term,ab)" in plan


def test_phrases(spark, indexed):
    wanted = ["act of god", "of of", "a a a", "force majeure", "god", "missing word", "of act"]
    got = {(r.phrase, r.doc_id): r.tf for r in positions.phrase_matches(indexed[1], "doc_id", spark.createDataFrame([(p, p.split()) for p in wanted], "phrase string, words array<string>")).collect()}
    want = {}
    for i, t in corpus():
        words = (t or "").split()
        for p in wanted:
            n = sum(words[k : k + len(p.split())] == p.split() for k in range(len(words)))
            if n:
                want[p, i] = n
    assert got == want


def test_clauses_of_every_kind(spark, indexed):
    docs, postings = indexed
    c = spark.createDataFrame([(1, "exact", "act"), (1, "prefix", "abc"), (1, "synonym", "act of god"), (2, "synonym", "god"), (2, "exact", "act"), (3, "exact", "nowhere")], "q long, kind string, term string")
    got = Counter((r.kind, r.term) for r in positions.clause_matches(postings, "doc_id", c).collect())
    has = lambda f: sum(f((t or "").split()) for _, t in corpus())
    assert got == Counter({("exact", "act"): has(lambda w: "act" in w), ("prefix", "abc"): has(lambda w: "abc" in w), ("synonym", "act of god"): has(lambda w: "act of god" in " ".join(w)), ("synonym", "god"): has(lambda w: "god" in w)})
    scores = positions.clause_scores(docs, "doc_id", "text", postings, c, "q")
    assert {r.q for r in scores.collect()} == {1, 2}


def test_the_word_itself_stands_above_its_relatives(spark):
    docs = spark.createDataFrame([(1, "we terminated leases " + "x " * 6), (2, "termination leases " + "x " * 7), (3, "the force of nature came " + "x " * 4), (4, "x " * 9), (5, "x " * 9), (6, "x " * 9), (7, "x " * 9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "terminated everything"), (2, "storm damage")], "q long, text string")
    c = routes.clauses(asked, "q", "text", spark.createDataFrame(stemming.synonym_pairs(), "word string, syn string"))
    postings = positions.positional(docs, "doc_id", "text")
    got = {(r.q, r.doc_id): r.score for r in positions.clause_scores(docs, "doc_id", "text", postings, c, "q").collect()}
    assert got[1, 1] > got[1, 2] > 0
    assert (2, 3) in got, "a phrase stands for a word"


def test_synonyms_are_bounded():
    pairs = stemming.synonym_pairs()
    assert max(Counter(w for w, _ in pairs).values()) == stemming.MOST_SYNONYMS
    assert ("due date", "deadline") in pairs and ("storm", "force of nature") in pairs and not any(w == "force of nature" for w, _ in pairs)


# --- isolation -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=70))
def test_halving_finds_the_bad_ones(values):
    calls = []

    def call(part):
        calls.append(len(part))
        if 0 in part:
            raise ValueError("zero")
        return [10 * x for x in part]

    bad = values.count(0)
    if values and bad == len(values):
        with pytest.raises(ValueError):
            isolation.isolated(call, values)
        return
    assert isolation.isolated(call, values) == [(None, "ValueError: zero") if x == 0 else (10 * x, None) for x in values]
    assert len(calls) <= 1 + 2 * bad * (len(values).bit_length() + 1)


def test_a_wrong_number_of_results_is_a_failure():
    with pytest.raises(ValueError):
        isolation.isolated(lambda part: [], [1, 2])
    assert isolation.isolated(lambda part: part[:1], [5, 6]) == [(5, None), (6, None)]


def test_nulls_are_errors_of_their_own(spark):
    got = isolation.applied(spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "k long, t string"), "k", "t", lambda: lambda part: [len(x) for x in part], "long")
    assert sorted(map(tuple, got.collect())) == [(1, 2, None), (2, None, "no input"), (3, 0, None)]


# --- histories -------------------------------------------------------------------------------------------------------


def plain(events, steps):
    """Contents on stacks, as an editor would keep them."""
    undo, redo, now, versions, out = [], [], None, [], []
    for n, op, wanted in events:
        done = True
        if op in ("edit", "save"):
            if now is not None:
                undo = (undo + [now])[-steps:]
                redo = []
            now = n
            if op == "save" or not versions:
                versions.append(None)
        elif op == "undo" and undo:
            redo, now, undo = (redo + [now])[-steps:], undo[-1], undo[:-1]
        elif op == "redo" and redo:
            undo, now, redo = (undo + [now])[-steps:], redo[-1], redo[:-1]
        elif op == "restore" and wanted is not None and 1 <= wanted <= len(versions):
            old = versions[wanted - 1]
            if old != now:
                undo, redo = (undo + [now])[-steps:], []
            now = old
            versions.append(None)
        else:
            done = False
        if versions:
            versions[-1] = now
        out.append((done, now, len(versions), len(undo), len(redo)))
    return out


OPS = st.tuples(st.sampled_from(["edit", "edit", "save", "undo", "undo", "redo", "restore", "other"]), st.one_of(st.none(), st.integers(0, 6)))


@settings(max_examples=200, deadline=None)
@given(st.lists(OPS, max_size=40), st.sampled_from([2, 100]))
def test_machine_against_plain_stacks(ops, steps):
    events = [(n, *x) for n, x in enumerate(ops)]
    m = history.Machine(steps)
    got = [(m.take(*e), m.shown, len(m.versions), len(m.undo), len(m.redo)) for e in events]
    assert got == plain(events, steps)


def test_histories_of_many_drafts(spark):
    rng = random.Random(9)
    rows = [(d, n, rng.choice(["edit", "save", "undo", "redo", "restore"]), rng.choice([None, 1, 2, 3]), f"{d}-{n}") for n in range(60) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "draft long, n long, op string, wanted long, body string").repartition(4)
    got = history.contents(history.replayed(df, "draft", "n", "op", "wanted"), df, "draft", "n", "body")
    got = {(r.draft, r.n): (r.done, r.shown, r.version, r.undo, r.redo, r.body) for r in got.collect()}
    for d in (1, 2, 3):
        events = [(n, op, w) for x, n, op, w, _ in rows if x == d]
        for (n, *_), want in zip(events, plain(events, history.UNDO_STEPS), strict=True):
            assert got[d, n] == (*want, None if want[1] is None else f"{d}-{want[1]}")


# --- fields ----------------------------------------------------------------------------------------------------------


def test_fields_are_merged_one_by_one(spark):
    records = spark.createDataFrame([(1, "old", "open", None, 5), (2, "same", "closed", 3, 5)], "id long, name string, status string, closed_at long, updated_at long")
    changes = [(1, 1, 10, {"name": "new"}), (1, 2, 20, {"status": "closed"}), (1, 3, 30, {"name": None}), (1, 4, 40, {"pinned": "x"}), (2, 5, 50, {"status": "open"}), (9, 6, 60, {"name": "nobody"}), (2, 7, 4, {})]
    c = spark.createDataFrame(changes, "id long, n long, at long, sets map<string,string>")
    out = fields.closed_at(fields.merged(records, c, "id", "n", "at", "sets", ["name", "status"]), c, "id", "n", "at", "sets")
    assert sorted(map(tuple, out.collect())) == [(1, None, "closed", 20, 30), (2, "same", "open", None, 50)]
    assert [r.n for r in fields.unknown(records, c, "id").collect()] == [6]


def test_titles_create_and_pins_do_not_touch(spark):
    s = spark.createDataFrame([(1, 1, 1, '{"title":"a","lang":"en"}'), (2, 1, 1, None)], "id long, created_at long, last_accessed long, metadata string")
    c = spark.createDataFrame([(1, 1, 10, "pinned", "true"), (3, 2, 20, "pinned", "true"), (3, 3, 30, "title", "t"), (3, 4, 40, "pinned", "false"), (4, 5, 50, "pinned", "true"), (2, 6, 60, "title", "b")], "id long, n long, at long, field string, value string")
    got = {r.id: tuple(r)[1:] for r in fields.titled(s, c, "id", "n", "at").where("created_at IS NOT NULL").collect()}
    assert got[1] == (1, 1, '{"lang":"en","pinned":"true","title":"a"}')
    assert got[2] == (1, 60, '{"title":"b"}')
    assert got[3] == (30, 30, '{"pinned":"false","title":"t"}')
    assert 4 not in got


def test_published_links_stay(spark):
    links = spark.createDataFrame([(1, 1, "published"), (1, 2, "saved")], "draft long, document long, kind string")
    new = spark.createDataFrame([(1, 1, "saved"), (1, 2, "published"), (2, 5, "saved")], "draft long, document long, kind string")
    assert sorted(map(tuple, fields.linked(links, new).collect())) == [(1, 1, "published"), (1, 2, "published"), (2, 5, "saved")]


# --- budgets ---------------------------------------------------------------------------------------------------------


def poured(sizes, total):
    """Max-min shares by pouring a unit at a time into whoever has least and still needs some."""
    have = [0] * len(sizes)
    for _ in range(total):
        open_ = [i for i, s in enumerate(sizes) if have[i] < s]
        if not open_:
            break
        have[min(open_, key=lambda i: (have[i], i))] += 1
    return have


@pytest.mark.parametrize("seed", range(3))
def test_fair_shares_add_up(spark, seed):
    rng = random.Random(seed)
    groups = {g: ([rng.choice([0, 3, 10, 40, 200]) for _ in range(rng.randrange(1, 9))], rng.choice([0, 20, 100, 1000])) for g in range(12)}
    rows = [(g, i, s, b) for g, (sizes, b) in groups.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g long, i long, size long, budget long")
    got = {(r.g, r.i): r.share for r in budget.fair_shares(df, "g", "size", "budget", "i", floor=0).collect()}
    for g, (sizes, b) in groups.items():
        mine, want = [got[g, i] for i in range(len(sizes))], poured(sizes, b)
        assert all(abs(x - y) <= 1 for x, y in zip(mine, want, strict=True))
        assert sum(mine) <= b and sum(want) - sum(mine) < len(sizes), "what is left is less than a unit for each"
    floors = {(r.g, r.i): r.share for r in budget.fair_shares(df, "g", "size", "budget", "i", floor=15).collect()}
    assert all(floors[g, i] >= min(15, s) for g, i, s, _ in rows)


def block(spark, docs, most, fair=False):
    df = spark.createDataFrame(docs, "s long, d long, name string, status string, text string, error string, at long")
    return {r.s: (r.block, r.complete) for r in budget.session_blocks(df, "s", "d", "name", "status", "text", "error", "at", most, fair).collect()}


def test_session_block_in_full_and_in_part(spark):
    docs = [(1, 1, "a.txt", "ok", "alpha", None, 2), (1, 2, "b", "ok", "beta", None, 1), (2, 3, "c.pdf", "failed", "x", "scan", 1), (2, 4, "d.pdf", "ok", "whole", None, 2), (3, 5, "e.txt", "ok", " ", None, 1), (4, 6, "big.txt", "ok", "é" * 3000, None, 1), (4, 7, "small.txt", "ok", "tiny", None, 2)]
    got = block(spark, docs, 2000)
    assert got[1] == ("Attached files:\n  - b (FILE)\n  - a.txt (TXT)\nAll documents are shown in full.\n\n--- b [FILE] ---\nbeta\n--- end ---\n\n--- a.txt [TXT] ---\nalpha\n--- end ---\n", True)
    assert got[2][0].startswith("Attached files:\n  - c.pdf (PDF)\n  - d.pdf (PDF)\n[Could not read 'c.pdf' (PDF): scan]\nAll readable documents") and not got[2][1]
    assert got[3] == ("[Could not read 'e.txt' (TXT): no reason recorded]\nNothing could be read.\n", False)
    head = "Attached files:\n  - big.txt (TXT)\n  - small.txt (TXT)\n"
    share = (2000 - len(head)) // 2
    assert f"(PARTIAL: the first {share + share % 2} of 6000 bytes) ---\n{'é' * ((share + 1) // 2)}\n--- end" in got[4][0] and "tiny" in got[4][0] and not got[4][1]
    wide = block(spark, docs, 2000, fair=True)[4][0]
    assert wide.count("é") == (2000 - len(head) - 4 + 1) // 2, "what the small one leaves goes to the large one"


def test_a_later_file_changes_nothing_before_it(spark):
    one = [(1, 1, "a.txt", "ok", "alpha", None, 1), (1, 2, "b.txt", "ok", "beta", None, 2)]
    two = [*one, (1, 3, "c.txt", "ok", "gamma", None, 3)]
    body = lambda d: block(spark, d, 9000)[1][0].split("full.\n")[1]
    assert body(two).startswith(body(one))


@pytest.mark.parametrize(("row", "mode", "evidence", "floor", "note"), [
    ((10_000, 2, 3_000, "about", True, 5, 9), "full", 0, None, None),
    ((10_000, 2, 4_001, "unrelated", True, 5, 9), "listed", 0, None, "unrelated"),
    ((10_000, 2, 4_000, "unrelated", True, 5, 9), "full", 0, None, "unrelated"),
    ((10_000, 2, 90_000, "about", True, 5, 9), "search", 14_000, None, None),
    ((10_000, 2, 90_000, "unclear", True, 5, 9), "search", 14_000, 0.45, None),
    ((1_000, 2, 90_000, "about", True, 5, 9), "search", 4_800, None, None),
    ((1_000_000, 1, 9_000_000, "about", True, 5, 9), "search", 48_000, None, None),
    ((10_000, 0, 0, "about", True, 2, 9), "matter", 6_000, 0.55, None),
    ((10_000, 0, 0, "about", True, 1, 9), "none", 0, None, None),
    ((10_000, 0, 0, "about", False, 2, 9), "none", 0, None, None),
    ((10_000, 0, 0, "about", True, 2, 0), "none", 0, None, None),
])
def test_plan_of_a_prompt(spark, row, mode, evidence, floor, note):
    df = spark.createDataFrame([row], "budget long, attached long, total long, intent string, allowed boolean, words int, pool long")
    r = budget.plan(df, "budget", "attached", "total", "intent", "allowed", "words", "pool").first()
    assert (r.mode, r.evidence, r.least_similarity, r.note) == (mode, evidence, floor, note)


def test_question_words_in_order_of_tiers(spark):
    from tessera.functions import text as T

    long = "Alpha beta " + " ".join(f"filler{chr(97 + i)}" for i in range(20)) + ". Where is Omega 2024?"
    got = spark.createDataFrame([(long,), ("short text",), (None,), ("",)], "t string").select(T.query_tokens(F.col("t")).alias("q")).collect()
    assert got[0].q[:2] == ["omega", "2024"] and len(got[0].q) == T.QUERY_WORDS and "alpha" in got[0].q
    assert got[1].q == ["short", "text"] and got[2].q is None and got[3].q == []
