"""Facets, histograms, suggestions, thread views, tags and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.functions.display import bar_width
from mailquarry.runtime import broadcast_if

#: Most tags of a message, the shape of a tag, most messages of a batch, rows and columns of an export.
MAX_TAGS = 16
TAG_SHAPE = "^[a-z0-9][a-z0-9-]{0,31}$"
MAX_BATCH = 500
EXPORT_ROWS = 50_000
EXPORT_COLUMNS = ("rank", "id", "message_id", "date", "from", "to", "cc", "subject", "thread_id", "tags")
#: Rows of a small side that are sent to every executor; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def named_values(name: str, values) -> Column:
    """An array of values as structs (facet, key)."""
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("facet"), x.alias("key")))


def facets(docs: DataFrame, by: list[str] | None = None, size: int = 10) -> DataFrame:
    """(by..., facet, key, n): the ten most frequent senders, recipients, folders and mailboxes, and both kinds of attachment.

    Documents are counted, each value once a document; most first, then by key. The documents are read once.
    """
    by = by or []
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    lists = {
        "senders": low(F.array("from_addr")),
        "recipients": low(F.concat(F.coalesce("to_addrs", F.array()), F.coalesce("cc_addrs", F.array()))),
        "folders": F.array("folder"),
        "mailboxes": F.array("mailbox"),
        "has_attachment": F.array(F.col("has_attachment").cast("string")),
    }
    named = [named_values(name, F.array_distinct(c)) for name, c in lists.items()]
    each = docs.select(*by, F.explode(F.concat(*named)).alias("f")).select(*by, "f.*").where("key is not null and key <> ''")
    counted = each.groupBy(*by, "facet", "key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by, "facet").orderBy(F.desc("n"), "key")
    return counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("facet") == "has_attachment", 2).otherwise(size)).drop("r")


def bars(counted: DataFrame) -> DataFrame:
    """(facet, key, n, width): facets with the width of their bars in per cent."""
    most = F.max("n").over(Window.partitionBy("facet"))
    return counted.select("facet", "key", "n", F.round(bar_width(F.col("n"), most), 3).alias("width"))


def month_histogram(docs: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    """(by..., month, n) of the calendar months that occur, UTC; undated rows are left out."""
    by = by or []
    return docs.where(F.col(at).isNotNull()).groupBy(*by, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def filled_histogram(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The histogram with every month between the first and the last of each group, zero where nothing happened."""
    by = by or []
    day = F.to_date(F.concat("month", F.lit("-01")))
    ends = histogram.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.where("a is not null").select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("day"))
    months = days.select(*by, F.date_format("day", "yyyy-MM").alias("month"))
    left, right = months.alias("l"), histogram.alias("r")
    same = F.col("l.month") == F.col("r.month")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same, "left").select(*[F.col(f"l.{c}") for c in by], "l.month", F.coalesce("r.n", F.lit(0)).cast("bigint").alias("n"))


def thread_view(docs: DataFrame, per_thread: int = 100) -> DataFrame:
    """(thread_id, id, position, total): a thread's messages, oldest first, undated last."""
    w = Window.partitionBy("thread_id")
    numbered = docs.where("thread_id is not null").select("thread_id", "id", F.row_number().over(w.orderBy(F.asc_nulls_last("at"), "id")).alias("position"), F.count(F.lit(1)).over(w).alias("total"))
    return numbered.where(F.col("position") <= per_thread)


def suggest_people(docs: DataFrame, prefixes: DataFrame, size: int = 5) -> DataFrame:
    """(prefix, address, n): the most frequent senders that start with a cleaned prefix."""
    clean = prefixes.select(F.substring(F.regexp_replace(F.lower("prefix"), r"[^a-z0-9._@'-]", ""), 1, 64).alias("prefix")).where("prefix <> ''").distinct()
    people = docs.where("from_addr is not null").groupBy(F.lower("from_addr").alias("address")).agg(F.count(F.lit(1)).alias("n"))
    met = people.join(broadcast_if(clean, BROADCAST_ROWS), F.col("address").startswith(F.col("prefix")))
    order = Window.partitionBy("prefix").orderBy(F.desc("n"), "address")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("prefix", "address", "n")


def suggest_subjects(docs: DataFrame, prefixes: DataFrame, size: int = 10) -> DataFrame:
    """(prefix, subject, n): the most frequent subjects, without reply marks and case, with the words of ``prefix`` in a row, the last one as a prefix."""
    words = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(c), " "))
    asked = prefixes.select(F.lower(F.substring("prefix", 1, 64)).alias("prefix")).distinct().withColumn("needle", words(F.col("prefix"))).where("needle <> ' '")
    counted = docs.select(F.lower(T.normalise_subject(F.col("subject"))).alias("subject")).where("subject <> ''").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    met = counted.withColumn("hay", words(F.col("subject"))).join(broadcast_if(asked, BROADCAST_ROWS), F.contains("hay", "needle"))
    order = Window.partitionBy("prefix").orderBy(F.desc("n"), "subject")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("prefix", "subject", "n")


def suggest(docs: DataFrame, prefixes: DataFrame, size: int = 5) -> DataFrame:
    """(prefix, kind, value, n): people first, then subjects, at most ``size`` of each."""
    people = suggest_people(docs, prefixes, size).select("prefix", F.lit("person").alias("kind"), F.col("address").alias("value"), "n")
    return people.unionByName(suggest_subjects(docs, prefixes, size).select("prefix", F.lit("subject").alias("kind"), F.col("subject").alias("value"), "n"))


def normal_tags(tags):
    """Stripped, lower-case, well-formed, distinct and sorted tags."""
    clean = F.transform(F.coalesce(tags, F.array()), lambda t: F.lower(T.strip(t)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.rlike(TAG_SHAPE))))


def tag_fold(events: DataFrame) -> DataFrame:
    """(email_id, tags, tagged_by): the state of each message's tags after its events, in the order of ``seq``.

    ``replace`` sets the tags and ``patch`` adds and then removes; either is void if more than 16 would result. Messages without tags have no row. Repeated rows count once. Events
    are first reduced to what can matter, those since the last replacement, which bounds a message's list.
    """
    e = events.where("email_id is not null and seq is not null").select("email_id", "seq", "op", normal_tags(F.col("add_tags")).alias("add"), normal_tags(F.col("remove_tags")).alias("drop"), "tagged_by").dropDuplicates(["email_id", "seq"])
    last = e.where((F.col("op") == "replace") & (F.size("add") <= MAX_TAGS)).groupBy("email_id").agg(F.max("seq").alias("from_seq"))
    kept = e.join(last, "email_id", "left").where("from_seq is null or seq >= from_seq")
    lists = kept.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "add", "drop", "tagged_by"))).alias("ev"))
    start = F.struct(F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("by"))

    def step(acc, x):
        patched = F.array_sort(F.array_except(F.array_union(acc["tags"], x["add"]), x["drop"]))
        wanted = F.when(x["op"] == "replace", x["add"]).otherwise(patched)
        void = F.size(wanted) > MAX_TAGS
        tags = F.when(void, acc["tags"]).otherwise(wanted)
        return F.struct(tags.alias("tags"), F.when(void, acc["by"]).otherwise(x["tagged_by"]).alias("by"))

    folded = lists.select("email_id", F.aggregate("ev", start, step).alias("s"))
    return folded.where(F.size("s.tags") > 0).select("email_id", F.array_join("s.tags", ",").alias("tags"), F.col("s.by").alias("tagged_by"))


def tag_counts(state: DataFrame, size: int = 200) -> DataFrame:
    counted = state.select(F.explode(F.split("tags", ",")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "tag").limit(size)


def tag_batch(state: DataFrame, ids: DataFrame, add: list[str], remove: list[str], by: str) -> DataFrame:
    """(email_id, tags, tagged_by, changed): the state of tags after one batch over at most ``MAX_BATCH`` distinct ids (email_id).

    Tags are added, then removed; a message that would get more than 16 keeps its own, one that has none left has no row,
    removing from a message without tags does nothing.
    """
    wanted = ids.where("email_id is not null").select("email_id").distinct()
    if wanted.count() > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} messages in a batch")
    given = lambda tags: normal_tags(F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
    both = state.join(F.broadcast(wanted.withColumn("asked", F.lit(True))), "email_id", "full_outer")
    have = F.when(F.coalesce("tags", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("tags", ","))
    after = F.array_sort(F.array_except(F.array_union(have, given(add)), given(remove)))
    ok = F.coalesce("asked", F.lit(False)) & (F.size(after) <= MAX_TAGS)
    changed = ok & (after != have)
    out = both.select("email_id", F.when(ok, after).otherwise(have).alias("t"), F.when(changed, F.lit(by)).otherwise(F.col("tagged_by")).alias("tagged_by"), changed.alias("changed"))
    return out.where(F.size("t") > 0).select("email_id", F.array_join("t", ",").alias("tags"), "tagged_by", "changed")


def email_views(docs: DataFrame, ids: DataFrame, state: DataFrame) -> DataFrame:
    """(id, subject, sender, name, at, body, tags): messages by id, hydrated from the few ids outwards."""
    wide = docs.join(broadcast_if(ids.select("id").distinct(), BROADCAST_ROWS), "id", "left_semi")
    tags = wide.join(state.select(F.col("email_id").alias("id"), "tags"), "id", "left")
    return tags.select("id", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("from_addr", F.lit("")).alias("sender"), T.display_name(F.col("from_name")).alias("name"), "at", "body", F.coalesce("tags", F.lit("")).alias("tags"))


def _export_cells(ranks: DataFrame, docs: DataFrame, state: DataFrame, *more: str) -> DataFrame:
    """The ten guarded columns of an export, from (id, rank)."""
    wide = docs.join(broadcast_if(ranks, BROADCAST_ROWS), "id").join(state.select(F.col("email_id").alias("id"), F.replace("tags", F.lit(","), F.lit("; ")).alias("tags")), "id", "left")
    several = lambda c: F.array_join(F.coalesce(c, F.array()), "; ")
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values = {"rank": F.col("rank").cast("bigint"), "id": "id", "message_id": "message_id", "date": iso, "from": "from_addr", "to": several("to_addrs"), "cc": several("cc_addrs"), "subject": "subject", "thread_id": "thread_id", "tags": "tags"}
    cells = [F.col("rank").cast("bigint").alias("rank") if n == "rank" else T.csv_cell(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()]
    return wide.select(*more, *cells)


def export(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Every message, newest first, undated last, then by message id, as guarded cells; ``truncated`` says whether more than the most rows were there.

    The order is taken on narrow rows; only the rows of the export meet the wide columns.
    """
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    top = docs.select("id", "at", "message_id").orderBy(F.desc_nulls_last("at"), F.asc_nulls_last("message_id"), "id").limit(EXPORT_ROWS)
    order = Window.orderBy(F.desc_nulls_last("at"), F.asc_nulls_last("message_id"), "id")  # of at most EXPORT_ROWS rows
    ranks = top.withColumn("rank", F.row_number().over(order)).select("id", "rank")
    return _export_cells(ranks, docs, state).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > EXPORT_ROWS).drop("total")  # one row of totals


def export_ranked(ranks: DataFrame, docs: DataFrame, state: DataFrame) -> DataFrame:
    """A query's results (query_id, id, rank) in their order, as guarded cells."""
    return _export_cells(ranks.select("query_id", "id", "rank"), docs, state, "query_id")


def write_csv(rows: DataFrame, path: str) -> None:
    """An export as CSV files with a header; a failing job leaves no part of it behind, as the committer renames last."""
    rows.select(*EXPORT_COLUMNS).orderBy("rank").write.mode("errorifexists").option("header", True).option("quoteAll", False).option("emptyValue", "").csv(path)


def health(docs: DataFrame) -> DataFrame:
    """(status, nodes, docs): whether the table can be read; a failure is a status, never an error."""
    spark = docs.sparkSession
    schema = "status string, nodes int, docs bigint"
    try:
        return spark.createDataFrame([("green", 1, docs.select("id").distinct().count())], schema)
    except Exception:  # noqa: BLE001 - whatever fails is what is reported
        return spark.createDataFrame([("red", 0, 0)], schema)


def export_rows(docs: DataFrame) -> DataFrame:
    """Guarded CSV cells of the export columns."""
    cells = {"id": F.col("id"), "from_addr": F.col("from_addr"), "to_addrs": F.array_join(F.coalesce("to_addrs", F.array()), "; "), "subject": F.col("subject"), "folder": F.col("folder")}
    return docs.select(*[T.csv_cell(c).alias(n) for n, c in cells.items()])
