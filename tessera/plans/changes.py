"""Queries over logs of changes: drafts, records, sessions, links; admission of requests; failing inputs; budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import budget, fields, history, isolation
from tessera.registry import query
from tessera.sources.shared import working_folder, written
from tessera.sources.tables import table
from tessera.streaming import indexer, limits

# --- drafts ----------------------------------------------------------------------------------------------------------

_OPS = "CASE event_type WHEN 'view' THEN 'edit' WHEN 'signup' THEN 'save' WHEN 'click' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'restore' END"


@query(
    "drf_undo_redo",
    f"""WITH RECURSIVE e AS (SELECT user_id AS draft, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {_OPS} AS op, 1 + event_id % 3 AS wanted FROM events),
    s AS (SELECT draft, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS n, false AS done, CAST(NULL AS BIGINT) AS shown, CAST([] AS BIGINT[]) AS u, CAST([] AS BIGINT[]) AS r, CAST([] AS BIGINT[]) AS v FROM (SELECT DISTINCT draft FROM e)
        UNION ALL
        SELECT draft, i, n, done, CASE WHEN done THEN now ELSE shown END,
            CASE WHEN NOT done OR keep THEN u WHEN op = 'undo' THEN u[:-2] ELSE list_append(u, shown) END,
            CASE WHEN NOT done OR keep THEN r WHEN op = 'undo' THEN list_append(r, shown) WHEN op = 'redo' THEN r[:-2] ELSE [] END,
            CASE WHEN NOT done THEN v WHEN op IN ('save', 'restore') OR len(v) = 0 THEN list_append(v, now) ELSE list_append(v[:-2], now) END
        FROM (SELECT s.draft, e.i, e.n, e.op, shown, u, r, v,
                CASE op WHEN 'undo' THEN len(u) > 0 WHEN 'redo' THEN len(r) > 0 WHEN 'restore' THEN len(v) >= wanted ELSE true END AS done,
                CASE op WHEN 'undo' THEN u[-1] WHEN 'redo' THEN r[-1] WHEN 'restore' THEN v[wanted] ELSE e.n END AS now,
                CASE op WHEN 'restore' THEN v[wanted] IS NOT DISTINCT FROM shown WHEN 'edit' THEN shown IS NULL WHEN 'save' THEN shown IS NULL ELSE false END AS keep
              FROM s JOIN e ON e.draft = s.draft AND e.i = s.i + 1))
    SELECT draft, s.n, done, shown, CAST(len(v) AS INTEGER) AS version, CAST(len(u) AS INTEGER) AS undo, CAST(len(r) AS INTEGER) AS redo, o.value AS content
    FROM s LEFT JOIN events o ON o.event_id = shown WHERE s.i > 0""",
)
def drf_undo_redo(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events as edits, saves, steps back and forward and restored versions of one draft."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("draft"), F.col("event_id").alias("n"), F.expr(_OPS).alias("op"), (1 + F.col("event_id") % 3).alias("wanted"), F.col("value").alias("content"))
    return history.contents(history.replayed(e, "draft", "n", "op", "wanted"), e, "draft", "n", "content").select("draft", "n", "done", "shown", "version", "undo", "redo", "content")


# --- records ---------------------------------------------------------------------------------------------------------

_SETS = """CASE event_type WHEN 'view' THEN map('name', concat('n', event_id)) WHEN 'click' THEN map('status', 'closed')
    WHEN 'purchase' THEN map('status', 'open', 'name', CAST(NULL AS STRING)) WHEN 'signup' THEN map('pinned', 'true') ELSE map('client', CAST(event_id AS STRING), 'status', 'archived') END"""


@query(
    "snk_fields",
    """WITH m AS (SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id),
    n AS (SELECT user_id, arg_max({'v': CASE event_type WHEN 'view' THEN 'n' || event_id END}, event_id) AS x FROM events WHERE event_type IN ('view', 'purchase') GROUP BY user_id),
    s AS (SELECT user_id, arg_max({'v': CASE event_type WHEN 'click' THEN 'closed' WHEN 'purchase' THEN 'open' ELSE 'archived' END, 't': ts}, event_id) AS x FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id),
    c AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS x, bool_or(event_type = 'signup') AS pinned, max(ts) FILTER (WHERE event_type <> 'signup') AS touched FROM events GROUP BY user_id)
    SELECT m.user_id AS matter, CASE WHEN n.x IS NULL THEN 'matter' ELSE n.x.v END AS name, coalesce(s.x.v, 'open') AS status, CAST(c.x AS VARCHAR) AS client, CASE WHEN pinned THEN 'true' END AS pinned,
        CASE WHEN s.x.v <> 'open' THEN epoch_us(s.x.t) END AS closed_at, epoch_us(greatest(opened, coalesce(touched, opened))) AS updated_at
    FROM m LEFT JOIN n USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN c USING (user_id) WHERE m.user_id % 5 <> 0""",
)
def snk_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Four of five users are matters; events rename, close, reopen, archive and pin them. Closing stamps, reopening clears, a pin touches nothing."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("matter"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.expr(_SETS).alias("sets"))
    none = F.lit(None).cast("string")
    matters = e.groupBy("matter").agg(F.min("at").alias("updated_at")).where("matter % 5 <> 0").select("matter", F.lit("matter").alias("name"), F.lit("open").alias("status"), none.alias("client"), none.alias("pinned"), F.lit(None).cast("long").alias("closed_at"), "updated_at")
    out = fields.merged(matters, e, "matter", "event_id", "at", "sets", ["name", "status", "client", "pinned"], quiet=("pinned",))
    return fields.closed_at(out, e, "matter", "event_id", "at", "sets")


@query(
    "snk_unknown_changes",
    "SELECT user_id AS matter, event_id FROM events WHERE user_id % 5 = 0",
)
def snk_unknown_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of matters that do not exist."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("matter"), "event_id")
    return fields.unknown(e.where("matter % 5 <> 0").select("matter").distinct(), e, "matter")


@query(
    "snk_titles",
    """WITH s AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id % 2 = 0),
    e AS (SELECT user_id AS id, event_id, epoch_us(ts) AS tm, CASE WHEN event_type IN ('view', 'error') THEN 'title' ELSE 'pinned' END AS field, CASE event_type WHEN 'click' THEN 'true' WHEN 'purchase' THEN 'false' WHEN 'signup' THEN 'true' ELSE 't' || event_id END AS value FROM events),
    born AS (SELECT id, min(event_id) AS born FROM e WHERE field = 'title' GROUP BY id),
    k AS (SELECT e.* FROM e LEFT JOIN born USING (id) WHERE field = 'title' OR id IN (SELECT id FROM s) OR event_id > born),
    f AS (SELECT id, arg_max(value, event_id) FILTER (WHERE field = 'title') AS title, arg_max(value, event_id) FILTER (WHERE field = 'pinned') AS pinned, min(tm) FILTER (WHERE field = 'title') AS born_at, max(tm) FILTER (WHERE field = 'title') AS touched FROM k GROUP BY id)
    SELECT id, CASE WHEN s.id IS NOT NULL THEN 1000 ELSE born_at END AS created_at, CASE WHEN s.id IS NOT NULL THEN greatest(2000, coalesce(touched, 2000)) ELSE touched END AS last_accessed,
        '{' || CASE WHEN s.id IS NOT NULL THEN '"lang":"en",' ELSE '' END || CASE WHEN pinned IS NOT NULL THEN '"pinned":"' || pinned || '",' ELSE '' END || '"title":"' || coalesce(title, 'old') || '"}' AS metadata
    FROM s FULL JOIN f USING (id)""",
)
def snk_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every second conversation is a session; events set titles and pins, of others too."""
    s = table(spark, sf, "conversations").where("conv_id % 2 = 0").select(F.col("conv_id").alias("id")).distinct()
    s = s.select("id", F.lit(1000).cast("long").alias("created_at"), F.lit(2000).cast("long").alias("last_accessed"), F.lit('{"title":"old","lang":"en"}').alias("metadata"))
    titles = F.col("event_type").isin("view", "error")
    value = F.when(titles, F.concat(F.lit("t"), "event_id")).when(F.col("event_type") == "purchase", "false").otherwise("true")
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(titles, "title").otherwise("pinned").alias("field"), value.alias("value"))
    out = fields.titled(s, e, "id", "event_id", "at")
    return out.where("metadata <> '{}'")


@query(
    "snk_append",
    """WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
    b AS (SELECT item_id % 40 AS session_id, item_id AS n, text FROM benchmark),
    n AS (SELECT session_id, last + row_number() OVER (PARTITION BY session_id ORDER BY n) AS message_index, 'user' AS role, text AS content FROM b JOIN last ON conv_id = session_id),
    a AS (SELECT conv_id AS session_id, turn AS message_index, role, text AS content FROM conversations UNION ALL SELECT * FROM n)
    SELECT session_id, CAST(count(*) AS BIGINT) AS messages, CAST(max(message_index) AS BIGINT) AS last, max_by(content, message_index) AS content, CAST(CASE WHEN session_id IN (SELECT session_id FROM n) THEN 9 ELSE 1 END AS BIGINT) AS last_accessed FROM a GROUP BY session_id""",
)
def snk_append(spark: SparkSession, sf: str) -> DataFrame:
    """The items of the benchmark as one batch of messages at the end of conversations, which are touched."""
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("message_index"), "role", F.col("text").alias("content"), F.lit(1).cast("long").alias("at"))
    sessions = m.select("session_id", F.lit(1).cast("long").alias("last_accessed")).distinct()
    b = table(spark, sf, "benchmark").select((F.col("item_id") % 40).alias("session_id"), F.col("item_id").alias("n"), F.lit("user").alias("role"), F.col("text").alias("content"))
    out = fields.appended(m, sessions, b.unionByName(b), "session_id", F.lit(9).cast("long"))
    each = out["messages"].groupBy("session_id").agg(F.count("*").alias("messages"), F.max("message_index").alias("last"), F.max_by("content", "message_index").alias("content"))
    return each.join(out["sessions"], "session_id")


_LINKS = "l AS (SELECT o_custkey AS draft, o_orderkey // 64 AS document, CASE max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END) WHEN 2 THEN 'published' WHEN 1 THEN 'saved' ELSE 'saved' END AS kind FROM orders GROUP BY ALL)"


@query(
    "snk_superseded_copies",
    f"""WITH {_LINKS}, fresh AS (SELECT DISTINCT draft, 10000000 + draft AS document FROM l WHERE draft % 3 <> 0),
    a AS (SELECT * FROM l UNION ALL SELECT draft, document, 'saved' FROM fresh)
    SELECT dd.document FROM a dd JOIN fresh f ON f.draft = dd.draft WHERE dd.kind = 'saved' AND dd.document <> f.document AND dd.document % 11 <> 0 AND dd.document % 13 <> 0 AND dd.document % 17 <> 0
    AND NOT EXISTS (SELECT 1 FROM a o WHERE o.document = dd.document AND (o.kind = 'published' OR o.draft <> dd.draft))""",
)
def snk_superseded_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three drafts get a new saved copy; their older ones go where no session, library, local file or other draft uses them."""
    status = F.expr("CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END")
    links = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("draft"), F.floor(F.col("o_orderkey") / 64).cast("long").alias("document")).agg(F.when(F.max(status) == 2, "published").otherwise("saved").alias("kind"))
    new = links.where("draft % 3 <> 0").select("draft", (F.lit(10_000_000) + F.col("draft")).alias("document"), F.lit("saved").alias("kind")).distinct()
    now = written(fields.linked(links, new), "links")
    documents = now.select("document", F.when(F.col("document") % 11 == 0, F.col("document")).alias("local_file")).distinct()
    used = lambda n: now.where(F.col("document") % n == 0).select("document").distinct()
    return fields.superseded_copies(now, new, documents, {"sessions": used(13), "library": used(17)})


# --- failing inputs --------------------------------------------------------------------------------------------------

_LONG = 4000


def _measured():
    """A stand-in for a model that breaks on a batch with a text that is too long for it."""

    def call(texts: list) -> list:
        if any(len(t) > _LONG for t in texts):
            raise ValueError("too long")
        return [len(t.split()) for t in texts]

    return call


@query("vec_embed_isolated", rf"SELECT doc_id, CASE WHEN length(text) <= {_LONG} THEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) END AS result, CASE WHEN length(text) > {_LONG} THEN 'ValueError: too long' END AS error FROM documents")
def vec_embed_isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a batch that a model cannot take are found by halving; the others keep their results."""
    return isolation.applied(table(spark, sf, "documents"), "doc_id", "text", _measured, "long")


@query("str_pending", "SELECT doc_id FROM documents WHERE NOT (doc_id % 4 = 1 OR (doc_id % 4 = 3 AND doc_id % 3 = 0))")
def str_pending(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter is current, a quarter has an older version, a quarter has failed (a third of it too often), the rest is new."""
    d = table(spark, sf, "documents")
    kind = F.col("doc_id") % 4
    state = d.where(kind > 0).select("doc_id", F.when(kind == 2, 1).otherwise(2).alias("version"), F.when(kind == 3, "failed").otherwise("indexed").alias("status"), F.when(kind == 3, F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1)).otherwise(0).alias("attempts"))
    return indexer.pending(d, state, version=2).select("doc_id")


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')".format


@query("str_reindex", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS('t')}) AS term FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN split_part(text, chr(10), 1) ELSE text END AS t FROM documents)) GROUP BY ALL) GROUP BY term")
def str_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """All documents are indexed in several batches; then a new version, through a new checkpoint, sees the first lines of every third."""
    work = working_folder(spark, "reindex")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.repartition(4, "doc_id").write.parquet(f"{work}/in")
    docs.where("doc_id % 3 = 0").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")).write.parquet(f"{work}/newer")
    schema = "doc_id long, text string"
    indexer.run(spark, f"{work}/in", f"{work}/index", f"{work}/first", schema, per_trigger=2, version=1)
    indexer.run(spark, f"{work}/newer", f"{work}/index", f"{work}/second", schema, version=2)
    return indexer.current(spark, f"{work}/index").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@query("str_rate_limit")
def str_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of each user by time, through the keyed stream: one token in a second, one stream, two in line. Tested against a fold."""
    work = working_folder(spark, "limits")
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.abs(F.col("value")) * 60_000_000).cast("long").alias("needs"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()  # two values
    ends = [low + (high - low) * i / 4 for i in range(1, 4)]
    for i in range(4):  # files in order of time, as a log would bring them
        part = e.where((F.lit(True) if i == 0 else F.col("ts") > F.lit(ends[i - 1])) & (F.lit(True) if i == 3 else F.col("ts") <= F.lit(ends[i])))
        part.write.mode("append").parquet(f"{work}/in")
    # a last request of nobody, far ahead, lets time pass for all others
    e.agg(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("id"), (F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(0).cast("long").alias("needs")).write.mode("append").parquet(f"{work}/in")
    return limits.run(spark, f"{work}/in", work, limits.Limits(rate=1, streams=1, queue=2, patience=3_600_000_000), per_trigger=64).where("key >= 0")


# --- budgets ---------------------------------------------------------------------------------------------------------


@query(
    "ctx_fair_shares",
    """WITH r AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, 400000 AS budget FROM orders),
    l AS (SELECT *, floor(greatest(budget - coalesce(sum(size) OVER w, 0), 0) / (count(*) OVER (PARTITION BY custkey) - row_number() OVER (PARTITION BY custkey ORDER BY size, orderkey) + 1)) AS level FROM r WINDOW w AS (PARTITION BY custkey ORDER BY size, orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT custkey, arg_min(level, {'s': size, 'o': orderkey}) FILTER (WHERE size > level) AS cut FROM l GROUP BY custkey)
    SELECT custkey, orderkey, CAST(least(size, greatest(least(size, coalesce(cut, size)), 400)) AS BIGINT) AS share FROM l JOIN c USING (custkey)""",
)
def ctx_fair_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A budget of 400,000 for each customer, shared max-min among the orders."""
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.floor("o_totalprice").cast("long").alias("size"), F.lit(400_000).alias("budget"))
    return budget.fair_shares(r, "custkey", "size", "budget", "orderkey").select("custkey", "orderkey", "share")


_BLOCK_TOP = "CASE WHEN n > 1 THEN 'Attached files:' || chr(10) || list ELSE '' END || failed"


@query(
    "ctx_session_block",
    f"""WITH d AS (SELECT doc_id // 5 AS session, doc_id, 'f' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.txt' END AS name, CASE WHEN doc_id % 4 = 0 THEN 'FILE' ELSE 'TXT' END AS kind, doc_id % 7 > 0 AND trim(text) <> '' AS ok, text, CASE WHEN doc_id % 14 = 0 THEN 'broken' ELSE 'no reason recorded' END AS error FROM documents),
    s AS (SELECT *, CASE WHEN ok THEN strlen(text) ELSE 0 END AS size FROM d),
    h AS (SELECT session, count(*) AS n, count(*) FILTER (WHERE ok) AS good, sum(size) AS total, string_agg('  - ' || name || ' (' || kind || ')' || chr(10), '' ORDER BY ok, doc_id) AS list, coalesce(string_agg('[Could not read ''' || name || ''' (' || kind || '): ' || error || ']' || chr(10), '' ORDER BY doc_id) FILTER (WHERE NOT ok), '') AS failed FROM s GROUP BY session),
    t AS (SELECT *, {_BLOCK_TOP} AS head, greatest(9000 - strlen({_BLOCK_TOP}), 0) AS room FROM h),
    p AS (SELECT s.*, room, total, greatest(room // good, 400) AS share FROM s JOIN t USING (session) WHERE ok),
    q AS (SELECT *, total <= room OR size <= share AS whole, hex(encode(text)) AS x FROM p),
    r AS (SELECT *, decode(unhex(left(x, 2 * share + length(regexp_extract(substring(x, 2 * share + 1, 6), '^((?:[89AB].)*)', 1))))) AS opening FROM (SELECT *, share AS share_ FROM q)),
    b AS (SELECT session, bool_and(whole) AS whole, string_agg(CASE WHEN whole THEN chr(10) || '--- ' || name || ' [' || kind || '] ---' || chr(10) || text || chr(10) || '--- end ---' || chr(10)
          ELSE chr(10) || '--- ' || name || ' [' || kind || '] (PARTIAL: the first ' || strlen(opening) || ' of ' || size || ' bytes) ---' || chr(10) || opening || chr(10) || '--- end ---' || chr(10) END, '' ORDER BY doc_id) AS body FROM r GROUP BY session)
    SELECT session, md5(head || CASE WHEN good = 0 THEN 'Nothing could be read.' WHEN NOT whole THEN 'Of documents marked PARTIAL only the opening is shown.' WHEN good < n THEN 'All readable documents are shown in full; those that could not be read are missing.' ELSE 'All documents are shown in full.' END || chr(10) || coalesce(body, '')) AS block,
        coalesce(whole, false) AND good = n AS complete FROM t LEFT JOIN b USING (session)""",
)
def ctx_session_block(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents attached to each session, every seventh of them unreadable, 9,000 bytes for all."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 5).cast("long").alias("session"), "doc_id", F.concat(F.lit("f"), "doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(".txt")).alias("name"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ok").alias("status"), "text", F.when(F.col("doc_id") % 14 == 0, "broken").alias("error"))
    out = budget.session_blocks(d, "session", "doc_id", "name", "status", "text", "error", "doc_id", 9000)
    return out.select("session", F.md5("block").alias("block"), "complete")


@query(
    "ctx_plan",
    """WITH s AS (SELECT c_custkey AS id, c_custkey * 7 AS budget, CAST(count(o_orderkey) AS BIGINT) AS attached, coalesce(CAST(sum(floor(o_totalprice)) AS BIGINT), 0) // 100 AS total, CASE c_custkey % 3 WHEN 0 THEN 'about' WHEN 1 THEN 'unclear' ELSE 'unrelated' END AS intent, c_custkey % 2 = 0 AS allowed, c_custkey % 5 AS words, c_custkey % 4 AS pool FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
    m AS (SELECT *, CASE WHEN attached > 0 AND total + 4000 <= budget * 4 * 20 // 100 THEN 'full' WHEN attached > 0 AND intent <> 'unrelated' THEN 'search' WHEN attached > 0 THEN 'listed' WHEN allowed AND words >= 2 AND pool > 0 THEN 'matter' ELSE 'none' END AS mode FROM s)
    SELECT id, mode, CAST(CASE mode WHEN 'search' THEN least(least(greatest(budget * 4 * 35 // 100, 4800), 48000), greatest(budget * 4, 4800)) WHEN 'matter' THEN least(greatest(budget * 4 * 15 // 100, 2000), 16000) ELSE 0 END AS BIGINT) AS evidence,
        CASE WHEN mode IN ('search', 'listed') AND intent = 'unclear' THEN 0.45::DOUBLE WHEN mode = 'matter' THEN 0.55::DOUBLE END AS least_similarity, CASE WHEN attached > 0 AND intent = 'unrelated' THEN 'unrelated' END AS note FROM m""",
)
def ctx_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sessions, their orders as attached documents."""
    c = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    n = F.col("c_custkey")
    s = c.groupBy("c_custkey").agg(F.count("o_orderkey").alias("attached"), F.floor(F.coalesce(F.sum(F.floor("o_totalprice")), F.lit(0)).cast("long") / 100).alias("total"))
    intent = F.when(n % 3 == 0, "about").when(n % 3 == 1, "unclear").otherwise("unrelated")
    s = s.select(n.alias("id"), (n * 7).alias("budget"), "attached", "total", intent.alias("intent"), (n % 2 == 0).alias("allowed"), (n % 5).alias("words"), (n % 4).alias("pool"))
    return budget.plan(s, "budget", "attached", "total", "intent", "allowed", "words", "pool").select("id", "mode", "evidence", "least_similarity", "note")
