"""Operators of the ingest side: canonical ids, merging, reply links, threads, chunks, reuse, sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.runtime import cut_lineage


def canonical_id() -> Column:
    """Content hash of sender, sorted recipients, date, subject and body; nulls count as empty."""
    empty = F.lit("")
    people = F.array_join(F.sort_array(F.concat(F.coalesce("to_addrs", F.array()), F.coalesce("cc_addrs", F.array()))), ",")
    parts = [F.coalesce(F.lower("from_addr"), empty), F.lower(people), F.coalesce("date_text", empty), T.strip(F.coalesce("subject", empty)), T.strip(F.coalesce("body", empty))]
    return F.sha1(F.concat_ws("\n", *parts))


def merge_deliveries(mails: DataFrame) -> DataFrame:
    """One row per id: the first arrival's values, mailboxes and folders in order of arrival, and the number of deliveries."""
    seen = F.array_sort(F.collect_list(F.struct("arrival", "mailbox", "folder")))
    merged = mails.where("id is not null").groupBy("id").agg(F.min_by(F.struct("subject", "from_addr"), "arrival").alias("f"), seen.alias("s"), F.count(F.lit(1)).alias("deliveries"))
    distinct = lambda field: F.array_distinct(F.filter(F.transform("s", lambda x: x[field]), lambda v: v.isNotNull() & (v != "")))
    return merged.select("id", "f.subject", "f.from_addr", F.array_join(distinct("mailbox"), ",").alias("mailboxes"), F.array_join(distinct("folder"), ",").alias("folders"), "deliveries")


def reply_links(mails: DataFrame) -> DataFrame:
    """(id, parent): reply and reference headers resolved to the first message with that message id."""
    asked = mails.select("id", F.explode(F.array_distinct(F.concat(F.array("in_reply_to"), F.coalesce("ref_ids", F.array())))).alias("message_id")).where("message_id is not null")
    known = mails.where("message_id is not null").groupBy("message_id").agg(F.min_by("id", F.struct("arrival", "id")).alias("parent"))
    return asked.join(known, "message_id").where("parent <> id").select("id", "parent").distinct()


def best_predecessors(mails: DataFrame, days: int = 30) -> DataFrame:
    """(id, previous, strength): for a reply the best earlier message of its subject within ``days``.

    Strength 2: the earlier sender is among the recipients; 1: the sender was among the earlier recipients, or follows
    up or forwards its own message. Ties go to the later, then the greater id. Undated messages stand before all dated
    ones of their subject; they answer, and are answered by, as long as no dated message before is too old.

    Each rule is an equality of subject and an address, so for each the latest earlier message is found by a running
    last value per subject and address; a hot subject is spread over its addresses and no pairs are made.
    """
    low = lambda c: F.array_distinct(F.array_compact(F.transform(F.coalesce(c, F.array()), lambda x: F.lower(x))))
    base = mails.where("id is not null").select("id", "at", F.lower("from_addr").alias("who"), low("to_addrs").alias("to"), T.normalise_subject(F.col("subject")).alias("topic"), T.is_reply_or_forward(F.col("subject")).alias("answers"), T.is_forward(F.col("subject")).alias("forward")).where("topic <> ''")
    me, others = F.array("who"), F.array_remove(F.col("to"), F.col("who"))
    rules = [  # strength, keys under which a message asks, keys under which it is found
        (2, others, me),
        (1, me, F.col("to")),
        (1, F.when(F.col("forward"), F.array(F.concat(F.lit("own "), F.col("who")))), F.array(F.concat(F.lit("own "), F.col("who")))),
        (1, F.transform("to", lambda t: F.concat_ws(" ", F.lit("both"), "who", t)), F.transform("to", lambda t: F.concat_ws(" ", F.lit("both"), "who", t))),
    ]
    sides = None
    for n, (strength, asks, offers) in enumerate(rules):
        for kind, keys, rows in ((0, asks, base.where("answers")), (1, offers, base)):
            known = F.filter(keys, lambda k: k.isNotNull()) if n != 3 else F.when(F.col("who").isNotNull(), keys)
            one = rows.select("topic", F.lit(n).alias("rule"), F.lit(strength).alias("strength"), F.lit(kind).alias("kind"), "id", "at", F.explode(known).alias("key"))
            sides = one if sides is None else sides.unionByName(one)
    order = Window.partitionBy("topic", "rule", "key").orderBy(F.asc_nulls_first("at"), "id", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sides.withColumn("b", F.last(F.when(F.col("kind") == 1, F.struct("at", "id")), ignorenulls=True).over(order)).where("kind = 0 and b is not null")
    oldest = base.groupBy("topic").agg(F.min("at").alias("oldest"))
    span = F.expr(f"INTERVAL {days} DAYS")
    fits = F.when(F.col("b.at").isNotNull(), F.col("at").isNull() | (F.col("b.at") >= F.col("at") - span)).otherwise(F.col("at").isNull() | F.col("oldest").isNull() | (F.col("oldest") >= F.col("at") - span))
    near = seen.join(oldest, "topic").where(fits)
    early = F.lit(-(1 << 62)).cast("bigint")
    best = near.groupBy("id").agg(F.max(F.struct("strength", F.coalesce(F.unix_micros("b.at"), early).alias("late"), F.col("b.id").alias("previous"))).alias("m"))
    return best.select("id", "m.previous", "m.strength")


def thread_counters(mails: DataFrame) -> DataFrame:
    """(linked_by_headers, linked_by_subject_fallback, threads, multi_message_threads, largest): counters of threading by headers, then by subject.

    Every resolved header counts, also if it links what is linked already; the subject fallback counts what it joins.
    ``mails`` has the columns of both kinds of link.
    """
    heads = reply_links(mails)
    known = mails.where("message_id is not null").groupBy("message_id").agg(F.min_by("id", F.struct("arrival", "id")).alias("parent"))
    named = mails.select("id", F.explode(F.concat(F.array("in_reply_to"), F.coalesce("ref_ids", F.array()))).alias("message_id"))
    by_headers = named.join(known, "message_id").where("parent <> id").agg(F.count(F.lit(1)).alias("linked_by_headers"))
    before = components(mails, heads).agg(F.countDistinct("component").alias("n"))
    sizes = components(mails, thread_links(mails)).groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    after = sizes.agg(F.count(F.lit(1)).alias("threads"), F.count_if(F.col("k") > 1).alias("multi_message_threads"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
    one = by_headers.crossJoin(before).crossJoin(after)  # one row each
    return one.select("linked_by_headers", (F.col("n") - F.col("threads")).alias("linked_by_subject_fallback"), "threads", "multi_message_threads", "largest")


def thread_links(mails: DataFrame) -> DataFrame:
    """(id, parent): links by headers, and by subject to the best predecessor."""
    return reply_links(mails).unionByName(best_predecessors(mails).select("id", F.col("previous").alias("parent"))).distinct()


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): least id of each connected component, by alternating large-star and small-star rounds.

    Lineage is cut after each round in the shared checkpoint folder; the loop ends when the edges no longer change. The
    rounds grow with the logarithm of the longest chain; if ``max_rounds`` are not enough, that is an error.
    """
    pairs = edges.select(F.greatest("id", "parent").alias("u"), F.least("id", "parent").alias("v")).where("u <> v").distinct()
    pairs, before = cut_lineage(pairs), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        small = cut_lineage(small)
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        pairs = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return vertices.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def chunk_windows(mails: DataFrame, size: int = 200, stride: int = 160, most: int = 8) -> DataFrame:
    """(id, chunk_no, n_tokens, chunk): overlapping windows of white-space tokens of subject and body."""
    text = F.concat_ws("\n\n", F.nullif("subject", F.lit("")), F.nullif("body", F.lit("")))
    words = F.array_remove(F.split(text, f"{T.SPACE}+"), "")
    base = mails.select("id", words.alias("w")).where(F.size("w") > 0)
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((F.size("w") - size) / F.lit(stride)) + 1)).cast("int")
    each = base.select("id", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    piece = F.slice("w", F.col("chunk_no") * stride + 1, F.lit(size))
    return each.select("id", "chunk_no", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("chunk"))


#: The default embedder and the shape of its passages, which a fingerprint holds besides the text.
EMBEDDER = "hashed-64/200/160/8"


def embeddable() -> Column:
    """Subject and body, stripped, with an empty line between them where both are there."""
    subject, body = T.strip(F.coalesce("subject", F.lit(""))), T.strip(F.coalesce("body", F.lit("")))
    return F.concat_ws("\n\n", F.nullif(subject, F.lit("")), F.nullif(body, F.lit("")))


def fingerprint(model: str = EMBEDDER) -> Column:
    """Hash of the text that is embedded and of every setting that shapes its vectors."""
    return F.sha1(F.concat_ws("\n", F.lit(model), embeddable()))


def row_fingerprint(columns: list[str]) -> Column:
    """Hash of a whole row: its columns by name, each with its value as text; nulls differ from empty values."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in sorted(columns)]
    return F.sha1(F.concat_ws("\n", *parts))


def reuse_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, action): whether a text's vectors are reused, made anew, or made for the first time."""
    a, b = current.select("id", fingerprint().alias("now")), previous.select("id", fingerprint().alias("then"))
    return a.join(b, "id", "left").select("id", F.when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "reuse").otherwise("again").alias("action"))


def incremental_vectors(current: DataFrame, previous: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, action, vector) of ``current`` (id, subject, body), taking over vectors of ``previous`` (id, fingerprint, vector) whose text is the same.

    Only the rest is embedded, by ``embed`` of (id, text). A text without words has a zero vector.
    """
    now = current.select("id", embeddable().alias("text"), fingerprint().alias("print"))
    joined = now.join(previous.select("id", F.col("fingerprint").alias("then"), F.col("vector").alias("old")), "id", "left")
    kept = joined.where("then = print").select("id", F.lit("reuse").alias("action"), F.col("old").alias("vector"))
    rest = joined.where("then is null or then <> print")
    made = embed(rest.select("id", "text")).join(rest.select("id", F.when(F.col("then").isNull(), "new").otherwise("again").alias("action")), "id")
    return kept.unionByName(made.select("id", "action", "vector"))


def normalised(mails: DataFrame) -> DataFrame:
    """(id, sender, receivers, copied, name, subject, person_id): clean addresses, each once in its order, and white space as single spaces."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array()), T.normalise_address), lambda x: x.isNotNull() & (x != "")))
    text = lambda c: T.collapse_space(F.coalesce(c, F.lit("")))
    sender = F.coalesce(T.normalise_address(F.col("from_addr")), F.lit(""))
    return mails.select("id", sender.alias("sender"), clean("to_addrs").alias("receivers"), clean("cc_addrs").alias("copied"), text("from_name").alias("name"), text("subject").alias("subject"), sender.alias("person_id"))


def stage_counts(stage: str, rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(stage, counter, n): rows processed, and how many of them each reason holds for; one pass, no row is dropped in silence."""
    counted = rows.agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"reason: {r}") for r, c in reasons.items()])
    return counted.unpivot([], counted.columns, "counter", "n").select(F.lit(stage).alias("stage"), "counter", "n")


def selection(mails: DataFrame, target: int) -> DataFrame:
    """(id, mailbox, position): whole mailboxes in the order of a name hash, each by id, cut at exactly ``target`` messages."""
    first = whole_group_sample(mails, target)
    own = F.row_number().over(Window.partitionBy("mailbox").orderBy("id"))
    placed = mails.join(F.broadcast(first.select("mailbox", "before")), "mailbox").select("id", "mailbox", (F.col("before") + own).alias("position"))
    return placed.where(F.col("position") <= target)


def projected(mails: DataFrame, allowed: list[str]) -> DataFrame:
    """The columns of a mapping, in its order; empty texts and empty lists become nulls, and false and zero stay."""
    out = []
    for c in allowed:
        kind = mails.schema[c].dataType.simpleString()
        value = F.nullif(c, F.lit("")) if kind == "string" else F.when(F.size(c) > 0, F.col(c)) if kind.startswith("array") else F.col(c)
        out.append(value.alias(c))
    return mails.select(*out)


def verify(written: DataFrame, expected: int) -> DataFrame:
    """(n, expected, count_ok, with_vectors, smoke_ok): the gate before a version is pointed to, in one pass; ``written`` has a column vector."""
    return written.agg(F.count(F.lit(1)).alias("n"), F.lit(expected).cast("bigint").alias("expected"), F.count_if(F.exists(F.coalesce("vector", F.array()), lambda x: x != 0)).alias("with_vectors")).select(
        "n", "expected", (F.col("n") == F.col("expected")).alias("count_ok"), "with_vectors", ((F.col("n") > 0) & (F.col("with_vectors") > 0)).alias("smoke_ok")
    )


#: Fixed value: an address in running text.
ADDRESS = r"[A-Za-z0-9_.\-+']+@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,}"


def spot_check(mails: DataFrame, n: int) -> DataFrame:
    """(id, missing): of an even sample the messages whose clean recipients lack an address that the raw fields hold."""
    raw = F.array_join(F.array_compact(F.concat(F.coalesce("to_addrs", F.array()), F.coalesce("cc_addrs", F.array()))), " ")
    again = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(f"({ADDRESS})"), 1), lambda x: F.lower(x)))
    sample = mails.join(F.broadcast(step_sample(mails, n).select("id")), "id", "left_semi")
    both = sample.select("id", again.alias("found")).join(normalised(sample).select("id", F.concat("receivers", "copied").alias("have")), "id")
    return both.select("id", F.array_join(F.array_sort(F.array_except("found", "have")), ";").alias("missing")).where("missing <> ''")


def whole_group_sample(mails: DataFrame, target: int) -> DataFrame:
    """(mailbox, n, before): whole mailboxes in the order of a name hash until ``target`` messages are reached."""
    sizes = mails.where("mailbox is not null").groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.sha1("mailbox"), "mailbox").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < target)


def step_sample(mails: DataFrame, n: int) -> DataFrame:
    """(id, row_no): every k-th row in the order of arrival, k = max(1, rows // n).

    Rows are numbered from per-bucket counts and positions within a bucket, so no task orders the whole table.
    """
    ids = mails.select("id", "arrival")
    total = ids.count()
    step = max(1, total // n)
    bucket = F.floor(F.col("arrival") / 4096)
    counts = ids.groupBy(bucket.alias("bucket")).count()
    base = counts.select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = ids.withColumn("bucket", bucket).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("arrival", "id")))
    numbered = local.join(base, "bucket").select("id", (F.col("base") + F.col("r") - 1).alias("row_no"))
    return numbered.where(F.col("row_no") % step == 0)
