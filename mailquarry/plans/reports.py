"""Registered queries of ingest gates, threads, judgments, benchmarks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import evaluation as E
from mailquarry.operators import messages as M
from mailquarry.operators import retrieval as R
from mailquarry.plans.registry import asked, dated, judged, mails, ndcg_mrr_recall, query, searched
from mailquarry.runtime import first_deliveries, read_table

# -- ingest --------------------------------------------------------------------------------------------------------


@query
def normalised(spark, d):
    n = M.normalised(mails(spark, d, "from_addr", "from_name", "to_addrs", "cc_addrs", "subject"))
    return n.select("id", "sender", F.array_join("receivers", ";").alias("receivers"), F.array_join("copied", ";").alias("copied"), "name", "subject", "person_id")


@query
def stage_counts(spark, d):
    """What the normalising stage counts, with a row for each reason."""
    n = M.normalised(mails(spark, d, "from_addr", "from_name", "to_addrs", "cc_addrs", "subject"))
    return M.stage_counts("normalise", n, {"from-missing": F.col("sender") == "", "no-recipients": F.size(F.concat("receivers", "copied")) == 0})


@query
def bulk_counts(spark, d):
    """What a bulk load takes and refuses, by reason: rows without an id, and rows whose id was there before."""
    e = read_table(spark, d, "emails").select("id", "arrival")
    again = e.count() - e.where("id is null").count() - first_deliveries(e).count()
    return M.stage_counts("bulk", e, {"bulk:missing_id": F.col("id").isNull()}).unionByName(spark.range(1).select(F.lit("bulk").alias("stage"), F.lit("reason: bulk:version_conflict").alias("counter"), F.lit(again).cast("bigint").alias("n")))


@query
def iso_dates(spark, d):
    """Date texts that are ISO 8601 with a zone, as instants; all others are null."""
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"
    at = F.when(F.col("date_text").rlike(iso), F.try_to_timestamp("date_text"))
    return mails(spark, d, "date_text").select("id", F.unix_micros(at).alias("us"))


@query
def extract_mailboxes(spark, d):
    """The messages of an allow-list of mailboxes."""
    listed = read_table(spark, d, "mailboxes").where("date_order = 'dmy'").select("mailbox")
    return mails(spark, d, "mailbox").join(F.broadcast(listed), "mailbox", "left_semi").select("id", "mailbox")


@query
def exact_selection(spark, d):
    """Whole mailboxes up to exactly 700 messages."""
    return M.selection(mails(spark, d, "mailbox"), 700)


@query
def index_projection(spark, d):
    docs = M.projected(mails(spark, d, "subject", "body", "from_addr", "to_addrs", "cc_addrs", "has_attachment"), ["id", "subject", "from_addr", "to_addrs", "cc_addrs", "has_attachment"])
    return docs.withColumns({c: F.array_join(c, ";") for c in ("to_addrs", "cc_addrs")})


@query
def line_count(spark, d):
    """All rows as delivered, also those without an id."""
    return read_table(spark, d, "emails").agg(F.count(F.lit(1)).alias("n"))


@query
def spot_check(spark, d):
    return M.spot_check(mails(spark, d, "from_addr", "from_name", "to_addrs", "cc_addrs", "subject"), 400)


@query
def text_fingerprints(spark, d):
    return mails(spark, d, "subject", "body").select("id", M.fingerprint().alias("print"))


@query
def row_fingerprints(spark, d):
    columns = ["body", "date_text", "folder", "from_addr", "subject"]
    return mails(spark, d, *columns).select("id", M.row_fingerprint(columns).alias("print"))


@query
def passage_vectors(spark, d):
    """The length and first two values of every passage's vector."""
    parts = M.chunk_windows(mails(spark, d, "subject", "body")).select(F.struct("id", "chunk_no").alias("key"), F.col("chunk").alias("text"))
    v = R.embed(parts.select(F.concat_ws("#", "key.id", "key.chunk_no").alias("id"), "text"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("id", F.round(length, 4).alias("length"), F.element_at("vector", 1).alias("v0"), F.element_at("vector", 2).alias("v1"))


@query
def incremental_vectors(spark, d):
    """The whole archive's vectors, taking over those made at the middle arrival where the text is the same."""
    rows = read_table(spark, d, "emails").select("id", "arrival", "subject", "body").where("id is not null")
    middle = rows.agg(F.floor((F.min("arrival") + F.max("arrival")) / 2).alias("middle"))
    last = lambda r: r.groupBy("id").agg(F.max_by(F.struct("subject", "body"), "arrival").alias("r")).select("id", "r.*")
    then = last(rows.crossJoin(F.broadcast(middle)).where("arrival <= middle"))
    before = R.embed(then.select("id", M.embeddable().alias("text"))).join(then.select("id", M.fingerprint().alias("fingerprint")), "id")
    out = M.incremental_vectors(last(rows), before, R.embed)
    return out.select("id", "action", F.element_at("vector", 1).alias("v0"), F.element_at("vector", 2).alias("v1"))


@query
def verify_gate(spark, d):
    docs = mails(spark, d, "subject", "body")
    vectors = R.embed(docs.select("id", M.embeddable().alias("text")))
    return M.verify(docs.select("id").join(vectors, "id", "left"), docs.count())


@query
def known_words(spark, d):
    """The words of the judged queries that the training corpus knows."""
    corpus = read_table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct()
    return R.query_terms(asked(spark, d)).join(corpus, "term", "left_semi").select("query_id", "term")


# -- threads -------------------------------------------------------------------------------------------------------


def _threaded(spark, d):
    return dated(spark, d, "message_id", "in_reply_to", "ref_ids", "from_addr", "to_addrs", "subject")


@query
def threads(spark, d):
    """Components over the links of headers and of subjects."""
    m = _threaded(spark, d)
    return M.components(m, M.thread_links(m))


@query
def thread_counters(spark, d):
    return M.thread_counters(_threaded(spark, d))


# -- judgments and reports -----------------------------------------------------------------------------------------


@query
def method_means(spark, d):
    per = ndcg_mrr_recall(spark, d)
    return E.means(per, spark.createDataFrame([("bm25",), ("vector",), ("hybrid",), ("unjudged",)], "method string"))


@query
def regression_gate(spark, d):
    """The fused method against the keyword leg as the baseline."""
    means = method_means(spark, d).persist()
    baseline = means.where("method = 'bm25'").withColumn("method", F.lit("hybrid"))
    return E.regression(means, baseline)


@query
def boost_sweep(spark, d):
    per_field = R.field_scores(searched(spark, d), asked(spark, d), R.mail_fields())
    return E.boost_sweep(per_field, E.authoritative(read_table(spark, d, "qrels")))


@query
def model_grades(spark, d):
    return E.model_grades(read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query
def relevance_report(spark, d):
    parts = E.report(ndcg_mrr_recall(spark, d), judged(spark, d), 4)
    part = F.when((F.col("split") == "*") & (F.col("category") == "*"), "all").when(F.col("category") == "*", F.concat(F.lit("split "), "split")).otherwise(F.concat(F.lit("category "), "category"))
    return E.relevance_lines(parts.select(part.alias("part"), F.col("method").alias("name"), "queries", "ndcg", "mrr", "recall"))


@query
def judged_by_both(spark, d):
    """Pairs that a reader and a model or a rule judged, without those that any of them left ungraded."""
    pairs = read_table(spark, d, "qrels").where("query_id is not null and doc_id is not null").select("query_id", F.col("doc_id").alias("id"), "source", "grade")
    by = lambda c: pairs.where(c).select("query_id", "id")
    return by("source = 'human'").intersect(by("source <> 'human'")).exceptAll(by("grade is null").distinct())


@query
def bench_summary(spark, d):
    return E.stage_latency(read_table(spark, d, "latency_samples"), {"wall": "wall_ms", "embed": "embed_ms"})


@query
def p95_gate(spark, d):
    return E.latency_gate(read_table(spark, d, "latency_samples"))


@query
def recent_queries(spark, d):
    s = read_table(spark, d, "latency_samples")
    return E.recent(s.select("query_id", F.col("sampled_at").alias("at"), F.col("sample_id").alias("seq"), "hits"))
