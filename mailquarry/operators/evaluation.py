"""Relevance metrics, judgments, and latency and availability analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.runtime import broadcast_if

#: Phases that are sent to every executor; with more the range join is left to the planner.
BROADCAST_PHASES = 100_000


def authoritative(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade, source): the judgment with the most authority per pair: human, then model, then rule; then by source and grade."""
    rank = F.when(F.col("source") == "human", 2).when(F.col("source") == "llm", 1).otherwise(0)
    graded = qrels.where("query_id is not null and doc_id is not null and grade is not null")
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(rank), "source", "grade")
    return graded.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", "doc_id", "grade", "source")


def metrics(runs: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 50) -> DataFrame:
    """(method, query_id, ndcg, mrr, recall) of ``runs`` (method, query_id, rank, id) for queries with judgments."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    judged = qrels.select("query_id", F.col("doc_id").alias("id"), "grade")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = judged.withColumn("r", ideal_rank).groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") >= 1).alias("relevant"))
    methods = runs.select("method").distinct()
    pairs = ideal.join(methods, F.lit(True))
    found = runs.join(judged, ["query_id", "id"]).groupBy("method", "query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"),
        F.count_if((F.col("grade") >= 1) & (F.col("rank") <= deep)).alias("found"),
    )
    joined = pairs.join(found, ["method", "query_id"], "left")
    return joined.select(
        "method",
        "query_id",
        F.round(F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("found") / F.nullif("relevant", F.lit(0)), F.lit(0.0)), 6).alias("recall"),
    )


def report(per_query: DataFrame, queries: DataFrame, digits: int = 5) -> DataFrame:
    """(method, split, category, ...): means over all queries, per split and per category, in one pass of grouping sets."""
    joined = per_query.join(queries.select("query_id", "split", "category"), "query_id")
    joined.createOrReplaceTempView("mailquarry_metrics")
    return joined.sparkSession.sql(
        f"""SELECT method, coalesce(split, '*') AS split, coalesce(category, '*') AS category, count(*) AS queries,
        round(avg(ndcg), {digits}) AS ndcg, round(avg(mrr), {digits}) AS mrr, round(avg(recall), {digits}) AS recall
        FROM mailquarry_metrics GROUP BY GROUPING SETS ((method), (method, split), (method, category))"""
    )


def rules(asked: DataFrame) -> DataFrame:
    """(query_id, kind, phrase, terms, senders, receivers, after, before): the objective grading rule of a parsed query.

    Operators with free words make ``both``, operators alone ``filter``, a quoted phrase ``phrase``, free words ``terms``.
    """
    words = F.array_distinct(T.tokens(F.col("text")))
    kind = F.when(F.col("filtered") & (F.size(words) > 0), "both").when(F.col("filtered"), "filter").when(F.size("phrases") > 0, "phrase").when(F.size(words) > 0, "terms")
    return asked.select("query_id", kind.alias("kind"), F.lower(F.get("phrases", F.lit(0))).alias("phrase"), words.alias("terms"), "senders", "receivers", "after", "before")


def auto_grade(text: Column, fits: Column) -> Column:
    """The grade of a lower-case ``text`` under the rule in the same row; ``fits`` is whether the filters let the document through.

    phrase 3 or 0; filter 3 or 0; terms 3 if all occur as substrings, 2 if some do, else 0; both 0 if the filters fail,
    else 3 if any term occurs and 1 if none does; anything else 0.
    """
    hits = F.size(F.filter("terms", lambda t: F.contains(text, t)))
    some = F.when(hits == 0, 0).when(hits == F.size("terms"), 3).otherwise(2)
    both = F.when(~F.coalesce(fits, F.lit(False)), 0).when(hits > 0, 3).otherwise(1)
    kind = F.col("kind")
    return F.when(kind == "phrase", F.when(F.contains(text, F.col("phrase")), 3).otherwise(0)).when(kind == "filter", F.when(fits, 3).otherwise(0)).when(kind == "terms", some).when(kind == "both", both).otherwise(0)


def grade_pool(pool: DataFrame, docs: DataFrame, rule: DataFrame) -> DataFrame:
    """(query_id, id, source, grade): every pooled document (query_id, id) of a query with a rule, graded by it; a date without a value fails."""
    pooled = pool.join(F.broadcast(rule.where("kind is not null")), "query_id").join(docs, "id")
    day = F.to_date("at")
    listed = lambda values, own: (F.size(values) == 0) | F.coalesce(F.arrays_overlap(F.col(values), own), F.lit(False))
    dated = (F.col("after").isNull() | (day >= F.col("after"))) & (F.col("before").isNull() | (day <= F.col("before")))
    fits = listed("senders", F.array(F.lower("from_addr"))) & listed("receivers", F.transform(F.coalesce("to_addrs", F.array()), lambda x: F.lower(x))) & F.coalesce(dated, F.lit(False))
    text = F.lower(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))
    return pooled.select("query_id", "id", F.concat(F.lit("auto:"), F.col("kind")).alias("source"), auto_grade(text, fits).cast("int").alias("grade"))


def means(per_query: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, queries, ndcg, mrr, recall): means over the queries with judgments; a method without any has zeros."""
    zero = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c)
    return methods.select("method").distinct().join(per_query, "method", "left").groupBy("method").agg(F.count("query_id").alias("queries"), zero("ndcg"), zero("mrr"), zero("recall"))


def regression(scores: DataFrame, baseline: DataFrame, method: str = "hybrid", margin: float = 0.02) -> DataFrame:
    """(previous, current, delta, verdict): whether a method's ``ndcg`` fell by more than ``margin``; ``skipped`` without a baseline or judgments.

    Both sides are (method, queries, ndcg, ...).
    """
    now = scores.where(F.col("method") == method).agg(F.max("ndcg").alias("current"), F.coalesce(F.max("queries"), F.lit(0)).alias("queries"))
    then = baseline.where(F.col("method") == method).agg(F.max("ndcg").alias("previous"))
    delta = F.round(F.col("current") - F.col("previous"), 4)
    verdict = F.when(F.col("previous").isNull() | (F.col("queries") == 0), "skipped").when(delta < -margin, "regression").otherwise("ok")
    return now.crossJoin(then).select("previous", "current", delta.alias("delta"), verdict.alias("verdict"))  # one row each


#: The boosts of fields that are compared; the first is what the others are measured against.
SWEEP = {
    "default subject^3": {"subject": 3.0, "body": 1.0, "from": 1.0, "to": 1.0}, "subject^1 (no boost)": {"subject": 1.0, "body": 1.0, "from": 1.0, "to": 1.0},
    "subject^2": {"subject": 2.0, "body": 1.0, "from": 1.0, "to": 1.0}, "subject^5": {"subject": 5.0, "body": 1.0, "from": 1.0, "to": 1.0},
    "subject^3 people^2": {"subject": 3.0, "body": 1.0, "from": 2.0, "to": 2.0}, "subject^3 body^2": {"subject": 3.0, "body": 2.0, "from": 1.0, "to": 1.0}, "no people fields": {"subject": 3.0, "body": 1.0},
}


def boost_sweep(per_field: DataFrame, qrels: DataFrame, top: int = 120) -> DataFrame:
    """(configuration, ndcg, delta, mrr): every configuration of boosts over the once computed scores per field (query_id, field, id, s)."""
    rows = [(c, f, b) for c, boosts in SWEEP.items() for f, b in boosts.items()]
    boosts = per_field.sparkSession.createDataFrame(rows, "method string, field string, boost double")
    scored = per_field.join(F.broadcast(boosts), "field").groupBy("method", "query_id", "id").agg(F.round(F.max(F.col("boost") * F.col("s")), 6).alias("score"))
    order = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "id")
    runs = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    per = means(metrics(runs, qrels), boosts)
    first = per.where(F.col("method") == next(iter(SWEEP))).select(F.col("ndcg").alias("base"))
    return per.crossJoin(F.broadcast(first)).select(F.col("method").alias("configuration"), "ndcg", F.round(F.col("ndcg") - F.col("base"), 4).alias("delta"), "mrr")  # one row


def model_grades(answers: DataFrame) -> DataFrame:
    """(id, grade) of ``answers`` (id, text): the first digit from 0 to 3 in a model's answer; null without one."""
    digit = F.regexp_extract(F.coalesce("text", F.lit("")), "[0-3]", 0)
    return answers.select("id", F.when(digit != "", digit).cast("int").alias("grade"))


def relevance_lines(scores: DataFrame) -> DataFrame:
    """(part, line): rows of a Markdown table of (part, name, queries, ndcg, mrr, recall); ``--`` where nothing is judged."""
    cell = lambda c: F.when(F.col("queries") > 0, F.format_string("%.4f", F.col(c))).otherwise("--")
    return scores.select("part", F.concat(F.lit("| "), F.concat_ws(" | ", "name", cell("ndcg"), cell("mrr"), cell("recall"), F.col("queries").cast("string")), F.lit(" |")).alias("line"))


def latency(samples: DataFrame, by: list[str], value: str = "wall_ms") -> DataFrame:
    """Count, mean, nearest-rank p50, p95, p99 and maximum of the successful samples, and the success rate of all, 1 without any."""
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    ms = F.when(ok, F.col(value))
    pick = lambda p, n: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN status = 200 THEN {value} END)"), 1).alias(n)
    return samples.groupBy(*by).agg(
        F.count_if(ok).alias("n"), F.round(F.avg(ms), 1).alias("mean"), pick(0.5, "p50"), pick(0.95, "p95"), pick(0.99, "p99"), F.round(F.max(ms), 1).alias("most"), F.coalesce(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6), F.lit(1.0)).alias("success")
    )


def stage_latency(samples: DataFrame, stages: dict[str, str]) -> DataFrame:
    """(stage, ...): the distribution of every stage's column, from one reading of the samples."""
    long = samples.select("status", *stages.values()).unpivot("status", list(stages.values()), "column", "ms")
    names = F.create_map(*[F.lit(x) for stage, c in stages.items() for x in (c, stage)])
    return latency(long.withColumn("stage", F.element_at(names, F.col("column"))), ["stage"], "ms")


def latency_gate(samples: DataFrame, target: float = 300.0) -> DataFrame:
    """(p95, target, met): whether the successful samples' p95 is below ``target`` milliseconds; zero without samples."""
    p95 = F.coalesce(F.col("p95"), F.lit(0.0))
    return latency(samples, []).select(p95.alias("p95"), F.lit(target).alias("target"), (p95 < target).alias("met"))


def recent(entries: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, at, hits): the last entries (query_id, at, seq, hits), each query once, the newest first."""
    last = entries.where("query_id is not null").groupBy("query_id").agg(F.max(F.struct("at", "seq", "hits")).alias("e"))
    return last.select("query_id", "e.at", "e.hits", F.col("e.seq").alias("seq")).orderBy(F.desc_nulls_last("at"), F.desc("seq")).limit(most).drop("seq")


def phases(samples: DataFrame, phase_table: DataFrame) -> DataFrame:
    """(phase, n, failed): samples per half-open phase; phases are broadcast for the range join as long as they are few."""
    p = broadcast_if(phase_table, BROADCAST_PHASES)
    met = samples.join(p, (F.col("sampled_at") >= F.col("started")) & (F.col("ended").isNull() | (F.col("sampled_at") < F.col("ended"))))
    return met.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != 200).alias("failed"))


def transitions(states: DataFrame, key: str) -> DataFrame:
    """(key, at, seq, state): rows whose state differs from the one before, in the order of (at, seq) per key."""
    w = Window.partitionBy(key).orderBy("at", "seq")
    return states.withColumn("before", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("before"))).drop("before")


def promoted(before: DataFrame, during: DataFrame) -> DataFrame:
    """(index, shard): shards whose primary now stands on a node that held their replica."""
    replicas = before.where("prirep = 'r' and node is not null").select("index", "shard", "node")
    return during.where("prirep = 'p' and node is not null").join(replicas, ["index", "shard", "node"], "left_semi").select("index", "shard").distinct()


def busiest_primary(shards: DataFrame) -> DataFrame:
    """(node, n): the node with the most primaries, ties by name."""
    return shards.where("prirep = 'p' and node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1)
