"""Registered queries of what is served: searches, pages, facets, exports, suggestions, threads, tags, fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailquarry.functions import display as V
from mailquarry.functions import text as T
from mailquarry.operators import facets as A
from mailquarry.operators import fixture as X
from mailquarry.operators import messages as M
from mailquarry.operators import retrieval as R
from mailquarry.plans import search
from mailquarry.plans.registry import asked, dated, found, judged, mails, passages, query, searched, tag_fold
from mailquarry.runtime import read_table

# -- search --------------------------------------------------------------------------------------------------------


@query
def search_hits(spark, d):
    """The first page of every judged query, hydrated, with tags, legs' ranks and totals."""
    return search.hits(found(spark, d), searched(spark, d), tag_fold(spark, d))


@query
def search_totals(spark, d):
    return found(spark, d).totals()


@query
def search_filters(spark, d):
    """What each query's field operators let through."""
    return search.allowed(dated(spark, d, "subject", "from_addr", "to_addrs", "cc_addrs"), asked(spark, d))


@query
def search_picked(spark, d):
    """A keyword search among messages picked by folder, attachment and tag."""
    docs = dated(spark, d, "subject", "body", "from_addr", "to_addrs", "cc_addrs", "folder", "has_attachment")
    docs = search.restrict(docs, search.Structured(folders=("inbox", "sent", "all documents"), tags=("privileged", "hot", "responsive"), has_attachment=False), tag_fold(spark, d))
    return docs.select("id")


@query
def search_facets(spark, d):
    """Facets of every query's whole match set, before any window cuts it."""
    matched = found(spark, d, "bm25").matched
    docs = mails(spark, d, "from_addr", "to_addrs", "cc_addrs", "folder", "mailbox", "has_attachment")
    return A.facets(matched.select("query_id", "id").join(docs, "id"), ["query_id"])


@query
def search_snippets(spark, d):
    docs = searched(spark, d)
    q = asked(spark, d)
    parts = passages(docs)
    whole = search.find(docs, q, "hybrid", parts)
    first = M.chunk_windows(docs).where("chunk_no = 0").select("id", F.col("chunk").alias("passage"))
    page = R.page(whole.fused, 1, 20)
    shown = search.snippets(page, R.highlight(docs, page, q), first, docs)
    legs = whole.fused.select("query_id", "id", F.col("bm25_rank").isNull().alias("semantic"))
    plain = F.regexp_replace("snippet", "</?em>", "")
    return shown.join(legs, ["query_id", "id"]).select("query_id", "id", "snippet", F.when(F.col("semantic"), plain).alias("semantic_text"))


@query
def highlights(spark, d):
    docs, q = searched(spark, d), asked(spark, d)
    return R.highlight(docs, R.bm25(docs, q, R.mail_fields(), 5), q)


@query
def reranked_page(spark, d):
    """The first 50 scored again by the default scorer; the rest, and queries that ask for precision, keep their order."""
    docs, q = searched(spark, d), asked(spark, d)
    return R.rerank(R.bm25(docs, q, R.mail_fields(), R.WINDOW), q, docs, R.overlap_score)


@query
def corrected_queries(spark, d):
    """Queries with their misspelt words replaced; words that stand in the training corpus are known and not touched."""
    known = read_table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    q = asked(spark, d)
    return R.corrected(q, R.corrections(mails(spark, d, "body"), q, "body", known))


# -- exports, messages, threads, suggestions, tags -----------------------------------------------------------------


@query
def export_complete(spark, d):
    """All messages of one kind, newest first, ten guarded columns, at most 50,000, with a sign if there were more."""
    docs = dated(spark, d, "message_id", "from_addr", "to_addrs", "cc_addrs", "subject", "thread_id", "has_attachment").where("has_attachment")
    return A.export(docs, tag_fold(spark, d))


@query
def export_ranked(spark, d):
    """One query's fused results in their order."""
    docs = searched(spark, d)
    q = asked(spark, d)
    ranks = R.bm25(docs, q, R.mail_fields(), R.WINDOW).select("query_id", "id", "rank")
    return A.export_ranked(ranks, docs, tag_fold(spark, d))


@query
def email_views(spark, d):
    """The judged messages by id, with names and tags; ids that are not there have no row."""
    wanted = read_table(spark, d, "qrels").select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    return A.email_views(searched(spark, d), wanted, tag_fold(spark, d))


@query
def thread_messages(spark, d):
    return A.thread_view(dated(spark, d, "thread_id")).join(tag_fold(spark, d).select(F.col("email_id").alias("id"), "tags"), "id", "left").select("thread_id", "id", "position", "total", F.coalesce("tags", F.lit("")).alias("tags"))


@query
def suggest_both(spark, d):
    prefixes = read_table(spark, d, "mailboxes").select(F.substring("mailbox", 1, 3).alias("prefix"))
    return A.suggest(mails(spark, d, "from_addr", "subject"), prefixes)


@query
def tag_batch(spark, d):
    """One batch: two tags added to and one taken from the first 500 judged messages by id."""
    ids = read_table(spark, d, "qrels").select(F.col("doc_id").alias("email_id")).where("email_id is not null").distinct().orderBy("email_id").limit(A.MAX_BATCH)
    return A.tag_batch(tag_fold(spark, d), ids, ["Reviewed ", "second-pass", "no good"], ["hot"], "batch")


@query
def lens_bars(spark, d):
    """The facets with the width of their bars."""
    return A.bars(A.facets(mails(spark, d, "from_addr", "to_addrs", "cc_addrs", "folder", "mailbox", "has_attachment")))


@query
def health(spark, d):
    return A.health(read_table(spark, d, "emails"))


# -- how values are shown ------------------------------------------------------------------------------------------


@query
def display_dates(spark, d):
    at = F.col("at")
    return dated(spark, d).where("at is not null").select("id", V.short_date(at).alias("short"), V.long_date(at).alias("long"), V.month_label(at).alias("month"), V.end_of_month(at).alias("last_day"))


@query
def display_counts(spark, d):
    s = read_table(spark, d, "latency_samples")
    return s.select("sample_id", V.milliseconds(F.col("wall_ms")).alias("wall"), V.plural(F.col("hits"), "email").alias("found"), V.grouped(F.col("sample_id") * 1000).alias("grouped"))


@query
def reflowed(spark, d):
    return mails(spark, d, "body").where("body is not null").select("id", V.reflow(F.col("body")).alias("text"))


@query
def decoded(spark, d):
    """Bodies escaped for HTML and decoded again."""
    escaped = F.col("body")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("e", "&#101;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(entity)) if sign != "e" else F.regexp_replace(escaped, "e(?=[ .])", entity)
    return mails(spark, d, "body").where("body is not null").select("id", V.decode_entities(escaped).alias("text"))


# -- fixtures ------------------------------------------------------------------------------------------------------


def _fixture(spark, d):
    return dated(spark, d, "subject", "body", "quoted_text", "from_addr", "from_name", "to_addrs", "cc_addrs", "folder", "concepts", "attachment_names", "thread_id")


@query
def fixture_keywords(spark, d):
    return X.keyword_scores(_fixture(spark, d), asked(spark, d))


@query
def fixture_concepts(spark, d):
    return X.concept_scores(_fixture(spark, d), asked(spark, d))


@query
def fixture_fused(spark, d):
    return X.fused(_fixture(spark, d), asked(spark, d))


@query
def fixture_page(spark, d):
    return X.page(_fixture(spark, d), asked(spark, d))


@query
def fixture_fragments(spark, d):
    docs, q = _fixture(spark, d), asked(spark, d)
    return X.fragments(X.fused(docs, q).where(F.col("rank") <= X.PAGE), docs, q)


@query
def fixture_facets(spark, d):
    return X.facets(_fixture(spark, d))


@query
def fixture_titles(spark, d):
    return X.titles(_fixture(spark, d))


@query
def fixture_suggest(spark, d):
    boxes = read_table(spark, d, "mailboxes")
    people = boxes.select(F.col("owner_addr").alias("address"), F.col("owner_name").alias("name"))
    return X.suggest(mails(spark, d, "from_addr", "to_addrs", "subject"), people, boxes.select(F.substring("mailbox", 1, 4).alias("prefix")))


__all__ = ["judged"]
