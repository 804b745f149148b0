"""Every query of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import evaluation as E
from mailquarry.operators import facets as A
from mailquarry.operators import messages as M
from mailquarry.operators import retrieval as R
from mailquarry.operators import timestamps
from mailquarry.plans import oracle, oracle_reports, oracle_serving, search
from mailquarry.runtime import first_deliveries, read_table

FLAGSHIP = "hybrid_page"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    for known in (oracle.SQL, oracle_serving.SQL, oracle_reports.SQL):
        if f.__name__ in known:
            SQL[f.__name__] = known[f.__name__]
    return f


def mails(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct messages, pruned to the columns a query needs."""
    names = list(dict.fromkeys(["id", "arrival", *columns]))
    return first_deliveries(read_table(spark, d, "emails").select(*names))


def dated(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct messages with their time of ingestion, to the second, as ``at``."""
    return mails(spark, d, "ingested_at", *columns).withColumn("at", F.date_trunc("second", "ingested_at"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "judged_queries")


# -- times -----------------------------------------------------------------------------------------------------


def _instants(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "emails").select("id", "date_text", F.col("mailbox").alias("source"), "arrival")
    sites = read_table(spark, d, "mailboxes").select(F.col("mailbox").alias("source"), F.col("site_zone").alias("zone"), "date_order")
    return timestamps.normalise(rows, sites)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where("status = 'resolved'").select("id", "utc_us")


@query
def p1_status(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).groupBy("status", F.coalesce("format", F.lit("none")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


# -- ingest ----------------------------------------------------------------------------------------------------


@query
def canonical_ids(spark, d):
    return mails(spark, d, "from_addr", "to_addrs", "cc_addrs", "date_text", "subject", "body").select("id", M.canonical_id().alias("canonical"))


@query
def dedupe_merge(spark, d):
    return M.merge_deliveries(read_table(spark, d, "emails").select("id", "arrival", "mailbox", "folder", "subject", "from_addr"))


@query
def subject_normalise(spark, d):
    s = F.col("subject")
    return mails(spark, d, "subject").select("id", T.normalise_subject(s).alias("topic"), T.is_reply_or_forward(s).alias("answers"), T.is_forward(s).alias("forward"))


@query
def split_quoted(spark, d):
    m = mails(spark, d, "body").select("id", T.split_quoted(F.col("body")).alias("q"))
    return m.select("id", "q.new_text", "q.quoted_text")


@query
def clean_text(spark, d):
    return mails(spark, d, "body").select("id", F.md5(T.clean_text(F.coalesce("body", F.lit("")))).alias("digest"))


@query
def display_names(spark, d):
    return mails(spark, d, "from_name", "from_addr", "to_addrs").select(
        "id", T.display_name(F.col("from_name")).alias("name"), T.person_name(F.lower("from_addr")).alias("person"), T.recipients_label(F.col("to_addrs")).alias("label")
    )


@query
def normalise_addresses(spark, d):
    to = F.transform(F.coalesce("to_addrs", F.array()), lambda x: F.lower(T.strip(x)))
    clean = F.array_distinct(F.filter(to, lambda x: x.isNotNull() & (x != "")))
    return mails(spark, d, "from_addr", "to_addrs").select("id", T.normalise_address(F.col("from_addr")).alias("person_id"), F.array_join(clean, ";").alias("recipients"))


@query
def missing_counters(spark, d):
    none = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return mails(spark, d, "from_addr", "subject", "body", "to_addrs", "date_text").agg(
        F.count(F.lit(1)).alias("processed"), none("from_addr").alias("no_sender"), none("subject").alias("no_subject"), none("body").alias("no_body"), none("date_text").alias("no_date"), F.count_if(F.size(F.coalesce("to_addrs", F.array())) == 0).alias("no_recipients")
    )


@query
def reply_links(spark, d):
    return M.reply_links(mails(spark, d, "message_id", "in_reply_to", "ref_ids"))


@query
def best_predecessor_30d(spark, d):
    return M.best_predecessors(dated(spark, d, "from_addr", "to_addrs", "subject"))


@query
def thread_components(spark, d):
    m = mails(spark, d, "message_id", "in_reply_to", "ref_ids")
    return M.components(m, M.reply_links(m))


@query
def thread_stats(spark, d):
    sizes = thread_components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("threads"), F.count_if(F.col("n") > 1).alias("multi_message_threads"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@query
def chunk_windows(spark, d):
    return M.chunk_windows(mails(spark, d, "subject", "body"))


@query
def incremental_reuse(spark, d):
    """The archive against its state at the middle arrival, when a message was what its last copy by then said; edited are those whose later copy differs."""
    rows = read_table(spark, d, "emails").select("id", "arrival", "subject", "body").where("id is not null")
    middle = rows.agg(F.floor((F.min("arrival") + F.max("arrival")) / 2).alias("middle"))
    then = rows.crossJoin(F.broadcast(middle)).where("arrival <= middle").groupBy("id").agg(F.max_by(F.struct("subject", "body"), "arrival").alias("r")).select("id", "r.*")
    now = rows.groupBy("id").agg(F.max_by(F.struct("subject", "body"), "arrival").alias("r")).select("id", "r.*")
    return M.reuse_plan(now, then)


@query
def sample_whole_groups(spark, d):
    m = mails(spark, d, "mailbox")
    return M.whole_group_sample(m, 500)


@query
def step_sample(spark, d):
    return M.step_sample(mails(spark, d), 100)


# -- retrieval -------------------------------------------------------------------------------------------------


def asked(spark: SparkSession, d: str) -> DataFrame:
    return search.asked(judged(spark, d))


def searched(spark: SparkSession, d: str) -> DataFrame:
    """The messages with every column that a search or a page of it reads."""
    return dated(spark, d, "message_id", "subject", "body", "from_addr", "from_name", "to_addrs", "cc_addrs", "folder", "has_attachment", "duplicate_count", "thread_id")


def passages(docs: DataFrame) -> DataFrame:
    return M.chunk_windows(docs).select("id", F.col("chunk").alias("text"))


def found(spark: SparkSession, d: str, method: str = "hybrid") -> search.Found:
    docs = searched(spark, d)
    return search.find(docs, asked(spark, d), method, passages(docs) if method != "bm25" else None)


@query
def bm25_topk(spark, d):
    return R.bm25(mails(spark, d, "subject", "body", "from_addr", "to_addrs"), asked(spark, d), R.mail_fields(), 10)


@query
def phrase_matches(spark, d):
    return R.phrase_match(mails(spark, d, "subject", "body"), asked(spark, d), ["subject", "body"]).select("query_id", "id")


@query
def rrf_fusion(spark, d):
    return found(spark, d).fused


@query
def hybrid_page(spark, d):
    return R.page(found(spark, d).fused, 2, 10)


@query
def fuzzy_terms(spark, d):
    words = mails(spark, d, "subject").select(F.lit("subject").alias("field"), T.tokens(F.col("subject")).alias("w"))
    terms = R.query_terms(asked(spark, d)).select(F.lit("subject").alias("field"), "term")
    return R.fuzzy_expansion(R.vocabulary(words), terms).select("term", "word", "df", "d")


@query
def spelling_fix(spark, d):
    return R.corrections(mails(spark, d, "subject"), asked(spark, d), "subject")


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query
def knn_topk(spark, d):
    v = _vectors(spark, d)
    return R.knn(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


@query
def knn_filtered_collapse(spark, d):
    """Neighbours among the even labels only, collapsed to the best vector per label."""
    v = _vectors(spark, d)
    near = R.knn(v.where("label % 2 = 0"), v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 120)
    best = near.join(v.select("id", "label"), "id").groupBy("query_id", "label").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("query_id", "label", "b.id", "b.score")


@query
def filtered_search(spark, d):
    """The whole match set of the queries with field operators; the operators are applied before anything is scored."""
    docs, q = dated(spark, d, "subject", "body", "from_addr", "to_addrs", "cc_addrs"), asked(spark, d)
    let = search.allowed(docs, q).persist()
    matched = R.bm25_leg(docs, q, R.mail_fields(), allowed=let)
    return matched.join(F.broadcast(q.where("filtered").select("query_id")), "query_id", "left_semi").select("query_id", "id")


# -- facets, threads, tags, export -----------------------------------------------------------------------------


@query
def facet_terms(spark, d):
    return A.facets(mails(spark, d, "from_addr", "to_addrs", "cc_addrs", "folder", "mailbox", "has_attachment"))


@query
def facet_month_histogram(spark, d):
    return A.month_histogram(dated(spark, d), "at")


@query
def histogram_gapfill(spark, d):
    """The months of every folder, without gaps."""
    return A.filled_histogram(A.month_histogram(dated(spark, d, "folder"), "at", ["folder"]), ["folder"])


@query
def thread_view(spark, d):
    return A.thread_view(dated(spark, d, "thread_id"))


@query
def suggest_people(spark, d):
    prefixes = read_table(spark, d, "mailboxes").select(F.substring("mailbox", 1, 2).alias("prefix"))
    return A.suggest_people(mails(spark, d, "from_addr"), prefixes)


@query
def suggest_subjects(spark, d):
    """The first letters of every two-word query as a prefix."""
    prefixes = judged(spark, d).select(F.regexp_extract("query", r"^([a-z]+ [a-z]{2})", 1).alias("prefix"))
    return A.suggest_subjects(mails(spark, d, "subject"), prefixes)


@query
def tag_fold(spark, d):
    return A.tag_fold(read_table(spark, d, "tag_events"))


@query
def tag_counts(spark, d):
    return A.tag_counts(tag_fold(spark, d))


@query
def tag_filter(spark, d):
    """Messages with any of two tags: a semi join on the folded state."""
    tagged = tag_fold(spark, d).where(F.arrays_overlap(F.split("tags", ","), F.array(F.lit("privileged"), F.lit("hot")))).select(F.col("email_id").alias("id"))
    return mails(spark, d, "subject").join(tagged, "id", "left_semi").select("id", "subject")


@query
def export_rows(spark, d):
    return A.export_rows(mails(spark, d, "from_addr", "to_addrs", "subject", "folder"))


# -- evaluation and operations ---------------------------------------------------------------------------------


def _runs(spark, d):
    docs, q = searched(spark, d), asked(spark, d)
    parts = passages(docs)
    whole = search.find(docs, q, "hybrid", parts)
    ranks = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("rank")) for m, c in (("bm25", "bm25_rank"), ("vector", "vector_rank"))])).alias("r")
    # the legs' ranks are kept in the fused rows, so one search gives all three methods
    every = R.fuse({"bm25": R.ranked(whole.matched, R.WINDOW), "vector": whole.vector}, 2 * R.WINDOW)
    single = every.select("query_id", "id", ranks).select("r.method", "query_id", "r.rank", "id").where("rank is not null")
    return single.unionByName(every.where(F.col("rank") <= R.WINDOW).select(F.lit("hybrid").alias("method"), "query_id", "rank", "id")).persist()


@query
def judgment_precedence(spark, d):
    return E.authoritative(read_table(spark, d, "qrels"))


@query
def ndcg_mrr_recall(spark, d):
    return E.metrics(_runs(spark, d), E.authoritative(read_table(spark, d, "qrels")))


@query
def eval_grouping_sets(spark, d):
    return E.report(ndcg_mrr_recall(spark, d), judged(spark, d))


@query
def pool_union(spark, d):
    return _runs(spark, d).where("rank <= 20").select("query_id", "id").distinct()


@query
def label_todo(spark, d):
    """Pooled pairs that neither a rule nor a reader has graded."""
    done = read_table(spark, d, "qrels").where("(source = 'human' or source like 'auto:%') and grade is not null").select("query_id", F.col("doc_id").alias("id")).distinct()
    return pool_union(spark, d).join(done, ["query_id", "id"], "left_anti")


@query
def auto_grade(spark, d):
    docs = dated(spark, d, "subject", "body", "from_addr", "to_addrs")
    return E.grade_pool(pool_union(spark, d), docs, E.rules(asked(spark, d)))


@query
def judgment_coverage(spark, d):
    q = read_table(spark, d, "qrels").join(judged(spark, d).select("query_id", "category"), "query_id")
    return q.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries"), F.count_if(F.col("grade").isNull()).alias("ungraded"))


@query
def latency_percentiles(spark, d):
    return E.latency(read_table(spark, d, "latency_samples"), ["query_id"])


@query
def phase_bucketing(spark, d):
    s = read_table(spark, d, "latency_samples").select("status", "sampled_at")
    ends = s.agg(F.min("sampled_at").alias("a"))
    at = lambda sec: F.expr(f"a + interval {sec} seconds")
    rows = F.array(
        F.struct(F.lit("before").alias("phase"), F.col("a").alias("started"), at(60).alias("ended")),
        F.struct(F.lit("during").alias("phase"), at(60).alias("started"), at(200).alias("ended")),
        F.struct(F.lit("after").alias("phase"), at(200).alias("started"), F.lit(None).cast("timestamp").alias("ended")),
    )
    return E.phases(s, ends.select(F.explode(rows).alias("p")).select("p.*"))


@query
def status_transitions(spark, d):
    s = read_table(spark, d, "latency_samples").select("query_id", F.col("sampled_at").alias("at"), F.col("sample_id").alias("seq"), F.when(F.col("status") == 200, "up").otherwise("down").alias("state"))
    return E.transitions(s, "query_id").select("query_id", "seq", "state")


def _shards(spark, d):
    """Shard placements read out of the events: the user tells the shard, the event's number the node, its type the role."""
    e = read_table(spark, d, "events")
    return e.select("event_id", F.lit("v1").alias("index"), (F.col("user_id") % 1009).alias("shard"), (F.col("event_id") % 89).alias("node"), F.when(F.col("event_type").isin("view", "click"), "p").otherwise("r").alias("prirep"))


@query
def promoted_replicas(spark, d):
    """Placements in the first half of the events against those in the second."""
    s = _shards(spark, d)
    half = s.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("half"))
    split = s.crossJoin(F.broadcast(half))
    return E.promoted(split.where("event_id <= half"), split.where("event_id > half"))


@query
def busiest_primary(spark, d):
    return E.busiest_primary(_shards(spark, d))


@query
def facet_rollup(spark, d):
    """Line items by ship month and return flag with subtotals."""
    li = read_table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag", "l_quantity")
    return li.rollup("month", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query
def hydrate_topk(spark, d):
    """The three largest orders per customer, ranked on narrow columns and hydrated afterwards."""
    from pyspark.sql import Window

    o = read_table(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = o.select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return top.join(read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_custkey", "c_name", "o_orderkey", "rank")
