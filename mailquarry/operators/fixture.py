"""The small deterministic search that a reader's screen runs on fixtures: prefix and fuzzy words, concepts, fusion.

Every word of the corpus is compared with the query words once, as a vocabulary; messages are then met by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.operators.facets import filled_histogram, month_histogram, named_values
from mailquarry.operators.retrieval import met_by

#: Words that are not searched for, and the concepts that a query word stands for.
STOP = "the a an of to and or in on for is are was were that this it with as at by be from".split()
CONCEPTS = {
    "hiding": "concealment spe restatement", "hide": "concealment spe", "hidden": "concealment spe", "conceal": "concealment", "losses": "writedown impairment restatement", "loss": "writedown impairment",
    "writedown": "writedown impairment", "impairment": "impairment writedown", "fraud": "concealment restatement whistleblower", "partnership": "spe ljm raptor", "partnerships": "spe ljm raptor", "raptor": "raptor spe",
    "hedge": "hedging raptor", "hedges": "hedging raptor", "hedging": "hedging", "offbalance": "spe", "vehicle": "spe", "vehicles": "spe", "whistleblower": "whistleblower", "warned": "whistleblower risk",
    "warning": "whistleblower risk", "concerns": "whistleblower risk", "earnings": "earnings disclosure", "restate": "restatement", "restatement": "restatement", "trading": "trading", "california": "california trading",
    "power": "power trading", "gas": "gas trading", "legal": "legal governance", "board": "board governance", "audit": "audit governance controls", "merger": "merger diligence", "credit": "credit counterparty liquidity",
    "risk": "risk", "disclosure": "disclosure", "conflict": "conflict governance",
}
#: Results on a page, how deep a second scoring looks, and the window around a match.
PAGE, HEAD, BEFORE, WIDTH = 12, 50, 70, 220


def words(text: Column) -> Column:
    """Runs of letters, digits and apostrophes of at least two signs, in lower case, without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9']+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP))


def _empty(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def wanted(asked: DataFrame) -> DataFrame:
    """(query_id, word): the free words of parsed queries, in lower case; repeated ones count again."""
    each = asked.select("query_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return each.where((F.col("word") != "") & ~F.col("word").isin(*STOP))


def filtered(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id): the documents within a query's filters, by substrings of addresses and names; ``before`` includes its day."""

    def any_of(needles: Column, hay: Column) -> Column:
        return (F.size(needles) == 0) | F.exists(needles, lambda n: F.exists(hay, lambda h: F.contains(F.lower(h), F.lower(n))))

    def fits(q: Column) -> Column:
        who, to, cc = F.array(_empty("from_addr"), _empty("from_name")), F.array_compact(F.coalesce("to_addrs", F.array())), F.array_compact(F.coalesce("cc_addrs", F.array()))
        late = q["after"].isNull() | F.coalesce(F.col("at") >= q["after"].cast("timestamp"), F.lit(False))
        early = q["before"].isNull() | F.coalesce(F.col("at") < F.date_add(q["before"], 1).cast("timestamp"), F.lit(False))
        return any_of(q["senders"], who) & any_of(q["receivers"], to) & any_of(q["copied"], cc) & late & early

    return met_by(docs, asked.where("filtered").select("query_id", "senders", "receivers", "copied", "after", "before"), fits)


def keyword_scores(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score): 3 for each subject word and 1 for each body word that a query word begins, 0.6 for a word
    of five letters or more that only a misspelling meets, 6 and 3 for a phrase in subject and body."""
    parts = docs.select("id", F.explode(F.array(F.struct(F.lit("s").alias("part"), words(_empty("subject")).alias("w")), F.struct(F.lit("b").alias("part"), words(F.concat_ws(" ", _empty("body"), _empty("quoted_text"))).alias("w")))).alias("p"))
    postings = parts.select("id", "p.part", F.explode("p.w").alias("term")).groupBy("id", "part", "term").agg(F.count(F.lit(1)).alias("n"))
    q = F.broadcast(wanted(asked).select("word").distinct())
    begins = F.col("term").startswith(F.col("word"))
    edits = F.when(F.length("word") > 7, 2).otherwise(1)
    close = (F.length("word") >= 5) & (F.abs(F.length("word") - F.length("term")) <= 2) & (F.levenshtein("term", "word") <= edits)
    met = postings.select("term").distinct().join(q, begins | close).select("term", "word", begins.alias("begins"))
    hits = postings.join(met, "term").groupBy("id", "word").agg(F.sum(F.when(F.col("begins"), F.col("n") * F.when(F.col("part") == "s", 3).otherwise(1))).alias("exact"))
    per_word = hits.select("id", "word", F.coalesce(F.col("exact").cast("double"), F.lit(0.6)).alias("s"))
    free = wanted(asked).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("times"))
    scored = per_word.join(F.broadcast(free), "word").select("query_id", "id", (F.col("s") * F.col("times")).alias("s"))
    quoted = F.broadcast(asked.select("query_id", F.explode("phrases").alias("p")).select("query_id", F.lower("p").alias("p")))
    low = docs.select("id", F.lower(_empty("subject")).alias("subject"), F.lower(_empty("body")).alias("body"))
    found = low.join(quoted, F.contains("subject", "p") | F.contains("body", "p"))
    phrases = found.select("query_id", "id", (F.when(F.contains("subject", "p"), 6.0).otherwise(0.0) + F.when(F.contains("body", "p"), 3.0).otherwise(0.0)).alias("s"))
    return scored.unionByName(phrases).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))


def concept_scores(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score): agreement of a query's concepts with a document's, as a cosine in which a document's concepts all weigh one."""
    lexicon = asked.sparkSession.createDataFrame([(w, c) for w, cs in CONCEPTS.items() for c in cs.split()], "word string, concept string")
    asked_for = wanted(asked).join(F.broadcast(lexicon), "word").groupBy("query_id", "concept").agg(F.count(F.lit(1)).alias("n"))
    norm = asked_for.groupBy("query_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    have = docs.where(F.size("concepts") > 0).select("id", F.size("concepts").alias("size"), F.explode("concepts").alias("concept"))
    dot = have.join(F.broadcast(asked_for), "concept").groupBy("query_id", "id", "size").agg(F.sum("n").alias("dot"))
    return dot.join(F.broadcast(norm), "query_id").select("query_id", "id", F.round(F.col("dot") / (F.col("norm") * F.sqrt("size")), 9).alias("score"))


def fused(docs: DataFrame, asked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, rrf, rank, bm25_rank, vector_rank): both rankings within the filters, fused; ties by id."""
    let = filtered(docs, asked).withColumn("in", F.lit(True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranks = None
    for name, scores in (("bm25_rank", keyword_scores(docs, asked)), ("vector_rank", concept_scores(docs, asked))):
        flagged = scores.join(F.broadcast(asked.select("query_id", "filtered")), "query_id").join(let, ["query_id", "id"], "left").where("not filtered or in")
        one = flagged.select("query_id", "id", F.row_number().over(order).alias(name))
        ranks = one if ranks is None else ranks.join(one, ["query_id", "id"], "full_outer")
    rrf = F.round(F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0)), 9)
    placed = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")
    return ranks.withColumn("rrf", rrf).withColumn("rank", F.row_number().over(placed)).select("query_id", "id", "rrf", "rank", "bm25_rank", "vector_rank")


def cross_scores(pairs: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, cross): how early the query's phrases and words stand in subject and body of the pairs (query_id, id)."""
    needles = asked.select("query_id", F.concat(F.transform("phrases", lambda p: F.lower(p)), F.filter(F.split(F.lower("text"), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP))).alias("needles"))
    hay = docs.select("id", F.lower(F.concat(_empty("subject"), F.lit(" "), _empty("body"))).alias("hay"))
    at = pairs.select("query_id", "id").join(hay, "id").join(F.broadcast(needles), "query_id")
    each = F.transform("needles", lambda n: F.when(F.instr(F.col("hay"), n) > 0, 1.0 / (1.0 + (F.instr(F.col("hay"), n) - 1) / 120.0)).otherwise(0.0))
    return at.select("query_id", "id", F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6).alias("cross"))


def page(docs: DataFrame, asked: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """(query_id, id, position, rank, cross): a page, the first ``HEAD`` results scored again unless phrases or filters ask for precision."""
    every = fused(docs, asked)
    explicit = asked.select("query_id", ((F.size("phrases") > 0) | F.col("filtered")).alias("explicit"))
    head = every.where(F.col("rank") <= HEAD)
    again = head.join(F.broadcast(explicit.where("not explicit").select("query_id")), "query_id", "left_semi")
    scored = every.join(cross_scores(again, docs, asked), ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") <= HEAD, 0).otherwise(1), F.desc_nulls_last("cross"), "rank")
    placed = scored.withColumn("position", F.row_number().over(order))
    return placed.where((F.col("position") > (number - 1) * size) & (F.col("position") <= number * size)).select("query_id", "id", "position", "rank", "cross")


def fragments(pairs: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, fragment): some 220 signs around the first match in body and quoted text, cut at words, with all matches marked; null without one."""
    plain = lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    needles = F.filter(F.concat("phrases", F.filter(F.split("text", r"\s+"), lambda w: ~F.lower(w).isin(*STOP))), lambda w: w != "")
    longest = F.transform(F.array_sort(F.transform(needles, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: plain(x["w"]))
    patterns = asked.where(F.size(needles) > 0).select("query_id", F.concat(F.lit(r"(?i)\b("), F.array_join(longest, "|"), F.lit(")")).alias("pattern"))
    text = docs.select("id", F.concat(_empty("body"), F.lit(" "), _empty("quoted_text")).alias("text"))
    found = pairs.select("query_id", "id").join(text, "id").join(F.broadcast(patterns), "query_id").withColumn("at", F.regexp_instr("text", F.col("pattern")) - 1)
    start = F.greatest(F.lit(0), F.col("at") - BEFORE)
    cut = F.substr("text", start + 1, F.lit(WIDTH))
    cut = F.when(start > 0, F.concat(F.lit("…"), F.regexp_replace(cut, r"^\S*\s", ""))).otherwise(cut)
    cut = F.when(start + WIDTH < F.length("text"), F.concat(F.regexp_replace(cut, r"\s\S*\z", ""), F.lit("…"))).otherwise(cut)
    return found.select("query_id", "id", F.when(F.col("at") >= 0, F.regexp_replace(cut, F.col("pattern"), F.lit("<em>$1</em>"))).alias("fragment"))


def facets(docs: DataFrame, most: int = 12) -> DataFrame:
    """(facet, key, n): senders, recipients and folders, the ten most frequent concepts, months without gaps, and messages with and without attachments."""
    lists = {"senders": F.array("from_addr"), "recipients": F.col("to_addrs"), "folders": F.array("folder"), "topics": F.col("concepts")}
    each = docs.select(F.explode(F.flatten(F.array(*[named_values(name, F.coalesce(c, F.array().cast("array<string>"))) for name, c in lists.items()]))).alias("f")).select("f.*")
    counted = each.where("key is not null").groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "key")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("facet") == "topics", 10).otherwise(most)).drop("r")
    months = filled_histogram(month_histogram(docs, "at")).select(F.lit("months").alias("facet"), F.col("month").alias("key"), "n")
    held = F.when(F.size(F.coalesce("attachment_names", F.array())) > 0, "with").otherwise("without")
    return top.unionByName(months).unionByName(docs.groupBy(held.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("attachments").alias("facet"), "key", "n"))


def titles(docs: DataFrame) -> DataFrame:
    """(thread_id, title, n): a thread's first subject without one reply mark, and its messages; undated ones come last."""
    order = F.struct(F.col("at").isNull(), "at", "id")
    per = docs.where("thread_id is not null").groupBy("thread_id").agg(F.min_by(_empty("subject"), order).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select("thread_id", F.regexp_replace("s", r"(?i)^(re|fw|fwd):\s*", "").alias("title"), "n")


def suggest(docs: DataFrame, people: DataFrame, prefixes: DataFrame, most: int = 4) -> DataFrame:
    """(prefix, kind, value, n): people (address, name) by how many messages they sent or got, and subjects by their first arrival, that hold a prefix of two signs or more."""
    p = F.broadcast(prefixes.select(F.lower(F.trim("prefix")).alias("prefix")).where(F.length("prefix") >= 2).distinct())
    known = people.where("address is not null").join(p, F.contains("address", "prefix") | F.contains(F.lower("name"), F.col("prefix"))).select("prefix", "address").distinct()
    seen = docs.select("id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("from_addr"), F.coalesce("to_addrs", F.array()))))).alias("address"))
    counted = seen.join(F.broadcast(known.select("address").distinct()), "address", "left_semi").groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    who = known.join(counted, "address", "left").select("prefix", F.lit("person").alias("kind"), F.col("address").alias("value"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    clean = docs.select(F.regexp_replace(_empty("subject"), r"(?i)^(re|fw|fwd):\s*", "").alias("value"), "arrival").groupBy("value").agg(F.min("arrival").alias("first"))
    what = clean.join(p, F.contains(F.lower("value"), F.col("prefix"))).select("prefix", F.lit("subject").alias("kind"), "value", F.lit(1).cast("bigint").alias("n"), "first")
    rank = lambda *o: F.row_number().over(Window.partitionBy("prefix").orderBy(*o))
    best = who.withColumn("r", rank(F.desc("n"), "value")).unionByName(what.withColumn("r", rank("first")).drop("first"))
    return best.where(F.col("r") <= most).select("prefix", "kind", "value", "n")
