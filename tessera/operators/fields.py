"""Records whose fields change one by one: a change log folded into the rows as they stand.

A change names a record, a place in the order of changes, a time and the fields that it sets; a field that it does not
name stays, one that it sets to null is cleared. The last change that sets a field wins, field by field, so a log folds
by one aggregate with partial results, and no record is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(value: Column, sets: Column, order: Column) -> Column:
    """The value of the last change that sets a field, wrapped, so that a null which was set differs from nothing set."""
    return F.max_by(F.when(sets, F.struct(value.alias("v"))), F.when(sets, order))


def folded(changes: DataFrame, key: str, order: str, at: str, sets: str, fields: list[str], quiet: tuple[str, ...] = ()) -> DataFrame:
    """key, one struct (v) per field, first_at, touched_at: what a log sets in the end.

    ``sets`` is a map from field to value. A change that sets fields of ``quiet`` only leaves the time of the last touch alone.
    """
    has = {f: F.map_contains_key(F.col(sets), f) for f in fields}
    loud = F.lit(False)
    for f in fields:
        if f not in quiet:
            loud = loud | has[f]
    return changes.groupBy(key).agg(*[_last(F.element_at(sets, f), has[f], F.col(order)).alias(f) for f in fields], F.min(at).alias("first_at"), F.max(F.when(loud, F.col(at))).alias("touched_at"))


def merged(records: DataFrame, changes: DataFrame, key: str, order: str, at: str, sets: str, fields: list[str], updated: str = "updated_at", quiet: tuple[str, ...] = ()) -> DataFrame:
    """``records`` with the changes of those that exist; changes of unknown records do nothing (``unknown`` names them)."""
    f = folded(changes, key, order, at, sets, fields, quiet).select(key, *[F.col(c).alias(f"__{c}") for c in fields], F.col("touched_at").alias("__touched"))
    value = {c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(F.col(c)) for c in fields}
    value[updated] = F.greatest(updated, "__touched")
    return records.join(f, key, "left").select(*[value.get(c, F.col(c)).alias(c) for c in records.columns])


def unknown(records: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes of records that do not exist: errors of their callers."""
    return changes.join(records.select(key), key, "left_anti")


def closed_at(records: DataFrame, changes: DataFrame, key: str, order: str, at: str, sets: str, status: str = "status", closed: str = "closed_at", still: str = "open") -> DataFrame:
    """``records`` with the stamp of closing: the last change of the status sets it, or clears it where it opens again."""
    has = F.map_contains_key(F.col(sets), status)
    last = changes.where(has).groupBy(key).agg(F.max_by(F.struct(F.element_at(sets, status).alias("s"), F.col(at).alias("t")), F.col(order)).alias("__last"))
    stamp = F.when(F.col("__last").isNull(), F.col(closed)).when(F.col("__last.s") != still, F.col("__last.t"))
    return records.join(last, key, "left").select(*[(stamp if c == closed else F.col(c)).alias(c) for c in records.columns])


def titled(sessions: DataFrame, changes: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """Sessions (key, created_at, last_accessed, metadata as JSON) after changes (key, order, at, field, value).

    A title creates its session if need be and counts as access; ``pinned`` changes the metadata of an existing session
    and leaves recency alone; what else the metadata holds stays. A session that a title creates exists for the pins
    after it, not for those before.
    """
    first_title = changes.where("field = 'title'").groupBy(key).agg(F.min(order).alias("__born"))
    known = changes.join(sessions.select(key, F.lit(True).alias("__old")), key, "left").join(first_title, key, "left")
    counts = known.where((F.col("field") == "title") | F.col("__old") | (F.col(order) > F.col("__born")))
    is_title, is_pin = F.col("field") == "title", F.col("field") == "pinned"
    f = counts.groupBy(key).agg(
        F.max_by(F.when(is_title, F.col("value")), F.when(is_title, F.col(order))).alias("__title"),
        F.max_by(F.when(is_pin, F.col("value")), F.when(is_pin, F.col(order))).alias("__pinned"),
        F.min(F.when(is_title, F.col(at))).alias("__first"),
        F.max(F.when(is_title, F.col(at))).alias("__touched"),
    )
    s = sessions.join(f, key, "full")
    old = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.map_filter(F.create_map(F.lit("title"), F.col("__title"), F.lit("pinned"), F.col("__pinned")), lambda _, v: v.isNotNull())
    both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    ordered = F.map_from_entries(F.array_sort(F.map_entries(both)))
    return s.select(key, F.coalesce("created_at", "__first").alias("created_at"), F.greatest("last_accessed", "__touched").alias("last_accessed"), F.to_json(ordered).alias("metadata"))


def appended(messages: DataFrame, sessions: DataFrame, batch: DataFrame, key: str, at: Column) -> dict[str, DataFrame]:
    """A batch of messages (key, role, content, n within the batch) at the end of their sessions, all at one time; the sessions are touched.

    Places go on after the last one of each session. Messages of unknown sessions are left out, as are repeated ones of
    the same place in the batch.
    """
    last = messages.groupBy(key).agg(F.max("message_index").alias("__last"))
    new = batch.dropDuplicates([key, "n"]).join(sessions.select(key), key, "left_semi").join(last, key, "left")
    place = F.coalesce("__last", F.lit(-1)) + F.row_number().over(Window.partitionBy(key).orderBy("n"))
    new = new.select(key, place.cast(messages.schema["message_index"].dataType).alias("message_index"), "role", "content", at.alias("at"))
    touched = new.groupBy(key).agg(F.max("at").alias("__at"))
    s = sessions.join(touched, key, "left").withColumn("last_accessed", F.greatest("last_accessed", "__at")).drop("__at")
    return {"messages": messages.unionByName(new, allowMissingColumns=True), "sessions": s}


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (draft, document, kind) with ``new`` ones (each pair once): a published one stays published."""
    n = new.select("draft", "document", F.col("kind").alias("__kind"))
    both = links.join(n, ["draft", "document"], "full")
    kind = F.when(F.col("kind") == "published", F.col("kind")).otherwise(F.coalesce("__kind", "kind"))
    return both.select("draft", "document", kind.alias("kind"))


def superseded_copies(links: DataFrame, new: DataFrame, documents: DataFrame, uses: dict[str, DataFrame]) -> DataFrame:
    """document: the saved copies of a draft that a new saved copy replaces and that nothing else uses.

    A copy goes if it belongs to one of the drafts in ``new`` (draft, document, kind; saved ones count) without being its new copy,
    is linked as saved by that draft only and published by none, is no local file (``documents``: document, local_file),
    and stands in no other table (``uses``: name to frame with a document column). ``links`` are those after ``linked``.
    """
    fresh = new.where("kind = 'saved'").select("draft", F.col("document").alias("__new")).distinct()
    # one row per document: how many drafts hold it, whether one has published it, and which draft holds it if one does
    holders = links.groupBy("document").agg(F.count_distinct("draft").alias("drafts"), F.max((F.col("kind") == "published").cast("int")).alias("published"), F.max("draft").alias("draft"))
    old = holders.where((F.col("drafts") == 1) & (F.col("published") == 0)).select("document", "draft").join(fresh.select("draft").distinct(), "draft", "left_semi")
    old = old.join(fresh, (old["document"] == fresh["__new"]) & (old["draft"] == fresh["draft"]), "left_anti")
    old = old.join(documents.where("local_file IS NULL").select("document"), "document", "left_semi")
    for frame in uses.values():
        old = old.join(frame.select("document"), "document", "left_anti")
    return old.select("document")
