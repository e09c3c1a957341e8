"""Joins, aggregates, sorts, sets, upserts and trees over the star schema, ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import intervals, store
from tessera.registry import query
from tessera.sources.tables import table


@query("rel_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_left_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("rel_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def rel_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R' OR l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(lines, "p_partkey", "left_anti").select("p_partkey")


@query("rel_semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rel_semi_in(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("rel_left_outer", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_left_outer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("rel_three_way", "SELECT r_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def rel_three_way(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("rel_composite", "SELECT a.conv_id, a.turn, length(b.text) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.role = 'user'")
def rel_composite(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.where("role = 'user'").select("conv_id", "turn").join(c.select("conv_id", "turn", F.length("text").cast("long").alias("n")), ["conv_id", "turn"])


@query("rel_residual", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 2 AND l_linenumber <> 1")
def rel_residual(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return table(spark, sf, "lineitem").where("l_linenumber <> 1").join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") > F.col("o_totalprice") / 2)).select("l_orderkey", "l_linenumber")


@query("rel_range_join", "SELECT l_orderkey, l_linenumber, min(o_orderkey) AS first_order FROM lineitem JOIN orders ON o_custkey = l_partkey AND l_quantity * 1000 BETWEEN o_totalprice - 20000 AND o_totalprice + 20000 GROUP BY ALL")
def rel_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """A point in an interval, inside an equal key."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") - 20000).alias("low"), (F.col("o_totalprice") + 20000).alias("high"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 1000).alias("at"))  # noqa: E741
    met = intervals.overlapping(l.withColumn("upto", F.col("at")), o, [("l_partkey", "o_custkey")], ("at", "upto"), ("low", "high"), 40000)
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.min("o_orderkey").alias("first_order"))


@query("rel_self_offset", "SELECT a.conv_id, a.turn, b.turn AS question_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant' AND b.role = 'user'")
def rel_self_offset(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag(F.struct("turn", "role")).over(w).alias("before"))
    return c.where("role = 'assistant' AND before.role = 'user' AND before.turn = turn - 1").select("conv_id", "turn", F.col("before.turn").alias("question_turn"))


@query(
    "rel_recursive_tree",
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
       t AS (SELECT id AS node, 0 AS depth FROM e WHERE id = 'r1' UNION ALL SELECT e.id, t.depth + 1 FROM e JOIN t ON e.parent_id = t.node) SELECT node, depth FROM t""",
)
def rel_recursive_tree(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return store.descendants(r.unionByName(n).unionByName(c), F.col("id") == "r1")


@query("agg_conditional_sums", "SELECT l_shipdate::DATE::VARCHAR AS day, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS returned, coalesce(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END), 0)::BIGINT AS open, count(*) AS n FROM lineitem GROUP BY 1")
def agg_conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day"))
    return d.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("n"))


@query("agg_max_coalesce", "SELECT source, max(coalesce(quality, 0) + coalesce(toxic, 0))::BIGINT AS most, count(quality) AS n_labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_max_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.max(F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0))).cast("long").alias("most"), F.count("quality").alias("n_labels"))


@query("agg_distinct", "SELECT DISTINCT source, lang FROM documents")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source", "lang").distinct()


@query("agg_next_version", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def agg_next_version(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next_key"))


@query("agg_tree_rollup", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"), F.count("*").alias("n"))


@query("agg_component_sizes", "SELECT event_type, round(sum(value), 4) AS total, round(sum(sum(value)) OVER () - sum(value), 4) AS other FROM events GROUP BY event_type")
def agg_component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    everything = F.sum("v").over(Window.partitionBy(F.lit(0)))  # one row per event type
    return per.withColumn("all", everything).select("event_type", F.round("v", 4).alias("total"), F.round(F.col("all") - F.col("v"), 4).alias("other"))


@query("sort_case_order", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 100")
def sort_case_order(spark: SparkSession, sf: str) -> DataFrame:
    """A sorted report of 100 rows: the limit is the feature."""
    order = [F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2), F.desc("o_totalprice"), F.asc("o_orderkey")]
    top = table(spark, sf, "orders").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("o_orderkey", "place")


@query("sort_nulls_first", "SELECT doc_id, CAST(row_number() OVER (ORDER BY quality ASC NULLS FIRST, doc_id) AS INTEGER) AS place FROM documents LEFT JOIN labels USING (doc_id) QUALIFY place <= 50")
def sort_nulls_first(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    order = [F.asc_nulls_first("quality"), F.asc("doc_id")]
    return d.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("doc_id", "place")


@query("page_offset_limit", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 200")
def page_offset_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy("ts", "event_id").offset(200).limit(100).select("event_id")


@query("flt_time_range", "SELECT event_id FROM events WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def flt_time_range(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = e.agg(F.min("ts")).first()[0]  # one value
    return e.where(F.col("ts").between(F.lit(start) + F.expr("INTERVAL 1 DAY"), F.lit(start) + F.expr("INTERVAL 3 DAY"))).select("event_id")


@query("json_props", "SELECT event_id, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("props IS NOT NULL").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("json_map_merge", "SELECT event_type, k AS prop, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def json_map_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("prop"))
    return e.groupBy("event_type", "prop").agg(F.count("*").alias("n"))


@query("upsert_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, max(n_chars) AS n_chars, count(*) AS seen FROM documents GROUP BY text")
def upsert_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "n_chars")
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.count("*").alias("seen"))


@query("upsert_coalesce_fill", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.source, 'label' || l.quality) AS source, greatest(d.n_chars, l.quality) AS n_chars FROM (SELECT * FROM documents WHERE lang = 'en') d FULL JOIN labels l USING (doc_id)")
def upsert_coalesce_fill(spark: SparkSession, sf: str) -> DataFrame:
    """English documents are stored, labels arrive as new rows."""
    old = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    new = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("label"), "quality").alias("source"), F.col("quality").cast("long").alias("n_chars"))
    return store.upsert(old, new, "doc_id", fill=["source"], bump=["n_chars"])


@query("scope_resolve", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 1)")
def scope_resolve(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    scope = labels.where("toxic = 1").select("doc_id").union(labels.where("quality = 1").select("doc_id")).distinct()
    return store.scoped(table(spark, sf, "documents").select("doc_id"), scope, "doc_id")


@query("scope_beyond", "SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def scope_beyond(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return store.beyond(labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"), "doc_id").distinct()


@query("scope_none_vs_empty", "SELECT 'none' AS scope, count(*) AS n FROM documents UNION ALL SELECT 'empty', 0")
def scope_none_vs_empty(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    count = lambda name, scope: store.scoped(docs, scope, "doc_id").agg(F.lit(name).alias("scope"), F.count("*").alias("n"))
    return count("none", None).unionByName(count("empty", docs.where("false")))


_NAMES = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ' report v' || (doc_id % 7) || '.docx' WHEN 1 THEN source || '_report_final.pdf' ELSE 'memo ' || doc_id || 'x.txt' END AS name, n_chars FROM documents"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN source || ' report v' || (doc_id % 7) || '.docx' WHEN 1 THEN source || '_report_final.pdf' ELSE 'memo ' || doc_id || 'x.txt' END AS name", "n_chars")


_FAMILY = rf"""f AS (SELECT *, CASE WHEN k = '' THEN lower(stem) ELSE k END AS family FROM (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(stem), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0 AND NOT regexp_matches(w, '{store.VERSION_WORD}')), ' ') AS k
    FROM (SELECT *, regexp_replace(name, '\.[A-Za-z0-9]+$', '') AS stem FROM ({_NAMES}))))"""


@query("ver_families", f"WITH {_FAMILY} SELECT doc_id, family, CAST(row_number() OVER (PARTITION BY family ORDER BY n_chars, doc_id) AS INTEGER) AS position, count(*) OVER (PARTITION BY family) AS total FROM f QUALIFY total > 1")
def ver_families(spark: SparkSession, sf: str) -> DataFrame:
    return store.families(_files(spark, sf), "doc_id", "name", "n_chars").select("doc_id", "family", "position", "total")


@query("ver_siblings", f"WITH {_FAMILY}, g AS (SELECT family, max_by(doc_id, (n_chars, doc_id)) AS latest, count(*) AS total FROM f GROUP BY family HAVING count(*) > 1) SELECT doc_id, latest FROM f JOIN g USING (family) WHERE doc_id <> latest")
def ver_siblings(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).withColumn("family", store.family_key(F.col("name")))
    latest = f.groupBy("family").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("latest"), F.count("*").alias("total")).where("total > 1")
    return f.join(latest, "family").where("doc_id <> latest").select("doc_id", "latest")
