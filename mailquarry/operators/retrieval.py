"""Batched lexical and vector retrieval: all queries of a set are answered by one plan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.runtime import broadcast_if

#: Query terms are sent to every executor up to so many, beyond that joined by shuffling.
BROADCAST_TERMS = 200_000
#: Query vectors taken together by one task.
QUERY_BLOCK = 2_048
WINDOW = 120
K1, B = 1.2, 0.75


def met_by(docs: DataFrame, queries: DataFrame, fits: Callable[[Column], Column]) -> DataFrame:
    """(query_id, id): the documents that fit each query; the query set is packed into blocks that every document meets once.

    ``fits`` is a predicate of a query as a struct, over the columns of the documents.
    """
    many = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(many)).alias("block")).agg(F.collect_list(F.struct(*queries.columns)).alias("queries")).select("queries")
    return docs.crossJoin(F.broadcast(packed)).select("id", F.explode(F.transform(F.filter("queries", fits), lambda q: q["query_id"])).alias("query_id")).select("query_id", "id")


@dataclass(frozen=True)
class Field:
    """A searched field: how its text is read, and how much its matches count."""

    name: str
    text: Column
    english: bool
    boost: float = 1.0

    def words(self) -> Column:
        return T.english_tokens(self.text) if self.english else T.tokens(self.text)


def mail_fields(**boosts: float) -> list[Field]:
    """The four searched fields of a message; a boost of zero leaves a field out."""
    every = [Field("subject", F.col("subject"), True), Field("body", F.col("body"), True), Field("from", F.col("from_addr"), False), Field("to", F.array_join(F.coalesce("to_addrs", F.array()), " "), False)]
    return [replace(f, boost=boosts.get(f.name, 1.0)) for f in every if boosts.get(f.name, 1.0) > 0]


def query_terms(asked: DataFrame, english: bool = False) -> DataFrame:
    """(query_id, term): the distinct free terms of parsed queries (query_id, text)."""
    words = T.english_tokens(F.col("text")) if english else T.tokens(F.col("text"))
    return asked.select("query_id", F.explode(F.array_distinct(words)).alias("term"))


def field_terms(asked: DataFrame, fields: list[Field]) -> DataFrame:
    """(query_id, field, term, least): the terms of a query as each field reads them, and how many of them must occur there."""
    parts = None
    for f in fields:
        one = query_terms(asked, f.english).withColumn("field", F.lit(f.name))
        parts = one if parts is None else parts.unionByName(one)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "field"))
    return parts.withColumn("n", n).select("query_id", "field", "term", F.when(F.col("n") <= 2, F.col("n")).otherwise(F.floor(F.col("n") / 2)).alias("least"))


def read_fields(docs: DataFrame, fields: list[Field]) -> DataFrame:
    """(id, field, w): the words of every field, from one reading of the documents."""
    structs = F.array(*[F.struct(F.lit(f.name).alias("field"), f.words().alias("w")) for f in fields])
    return docs.select("id", F.explode(structs).alias("f")).select("id", "f.field", "f.w")


def vocabulary(words: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(field, term, df, total): document frequency of each word, and under the empty word the number of documents and of words.

    With ``wanted`` (field, term) only its words are counted.
    """
    own = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n")))
    each = words.select("field", F.explode(F.concat(own, F.array(F.struct(F.lit("").alias("term"), F.size("w").alias("n"))))).alias("t")).select("field", "t.term", "t.n")
    if wanted is not None:
        whole = wanted.select("field").distinct().withColumn("term", F.lit(""))
        each = each.join(broadcast_if(wanted.select("field", "term").unionByName(whole).distinct(), BROADCAST_TERMS), ["field", "term"], "left_semi")
    return each.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))


def edit_distance(a: str, b: str) -> int:
    """Least number of insertions, deletions, substitutions and swaps of neighbours that turn ``a`` into ``b``."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            row, column = last.get(y, 0), at
            if x == y:
                at = j
            table[i + 1][j + 1] = min(table[i][j] + (x != y), table[i + 1][j] + 1, table[i][j + 1] + 1, table[row][column] + (i - row - 1) + 1 + (j - column - 1))
        last[x] = i
    return table[-1][-1]


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [edit_distance(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield batch.append_column("d", pa.array(d, pa.int32()))


def allowed_edits(term: Column) -> Column:
    """0 edits below 5 letters, 1 below 8, else 2."""
    return F.when(F.length(term) < 5, 0).when(F.length(term) < 8, 1).otherwise(2)


def fuzzy_expansion(vocab: DataFrame, terms: DataFrame, most: int = 50) -> DataFrame:
    """(field, term, word, df, d): words of the vocabulary within the allowed edits of a query term (field, term), the nearest ``most``.

    The first letter must agree. Words are compared only if first letter and length allow a match and the plain edit
    distance, in which a swap counts twice, is small enough.
    """
    asked = broadcast_if(terms.select("field", "term", allowed_edits(F.col("term")).alias("k")).distinct(), BROADCAST_TERMS)
    words = vocab.where("term <> ''").select(F.col("field").alias("f"), F.col("term").alias("word"), "df")
    may = (F.col("f") == F.col("field")) & (F.substring("word", 1, 1) == F.substring("term", 1, 1)) & (F.abs(F.length("word") - F.length("term")) <= F.col("k"))
    near = words.join(asked, may).where(F.levenshtein("word", "term") <= 2 * F.col("k")).select("field", "term", "word", "df", "k")
    exact = near.mapInArrow(_distances, "field string, term string, word string, df bigint, k int, d int").where("d <= k")
    order = Window.partitionBy("field", "term").orderBy("d", F.desc("df"), "word")
    return exact.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("field", "term", "word", "df", "d")


def field_scores(docs: DataFrame, asked: DataFrame, fields: list[Field], fuzzy: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, field, id, s): every match of the free terms in a field, with the share of them that must occur there.

    ``allowed`` (query_id, id) restricts the queries with filters (``asked.filtered``) before anything is scored; the
    statistics are those of the whole collection. A term counts through its nearest spellings, less for each edit.
    """
    words = read_fields(docs, fields)
    terms = field_terms(asked, fields).persist()
    vocab = (vocabulary(words) if fuzzy else vocabulary(words, terms)).persist()
    whole = vocab.where("term = ''").select("field", F.col("df").alias("n_docs"), (F.col("total") / F.col("df")).alias("avg_len"))
    spelt = terms.select("field", "term").distinct()
    if fuzzy:
        near = fuzzy_expansion(vocab, spelt)
    else:
        near = vocab.where("term <> ''").select("field", "term", F.col("term").alias("word"), "df", F.lit(0).alias("d"))
    share = 1 - F.col("d") / F.least(F.length("term"), F.length("word"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boosts = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(f.boost))])
    sought = near.join(F.broadcast(whole), "field").join(terms, ["field", "term"]).select("query_id", "field", "term", "word", "least", "avg_len", (share * idf * (K1 + 1)).alias("weight"), F.element_at(boosts, F.col("field")).alias("boost"))
    sought = sought.persist()
    held = words.select("id", "field", F.size("w").alias("len"), F.explode("w").alias("word"))
    wanted = broadcast_if(sought.select("field", "word").distinct(), BROADCAST_TERMS)
    postings = held.join(wanted, ["field", "word"], "left_semi").groupBy("id", "field", "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    met = postings.join(broadcast_if(sought, BROADCAST_TERMS), ["field", "word"])
    if allowed is not None:
        filtered = F.broadcast(asked.select("query_id", "filtered"))
        met = met.join(filtered, "query_id")
        met = met.where("not filtered").drop("filtered").unionByName(met.where("filtered").drop("filtered").join(allowed, ["query_id", "id"], "left_semi"))
    part = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    per_term = met.groupBy("query_id", "field", "id", "term").agg(F.max(part).alias("s"), F.first("least").alias("least"), F.first("boost").alias("boost"))
    per_field = per_term.groupBy("query_id", "field", "id").agg((F.sum("s") * F.first("boost")).alias("s"), F.count(F.lit(1)).alias("hits"), F.first("least").alias("least"))
    return per_field.where("hits >= least").select("query_id", "field", "id", "s")


def bm25_leg(docs: DataFrame, asked: DataFrame, fields: list[Field], fuzzy: bool = True, allowed: DataFrame | None = None, quoted: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the whole match set of the keyword leg, free terms and phrases together; both must match where both are asked for.

    A phrase counts 3 in the subject and 1 in the body; ``quoted`` are its matches, if they are known already.
    """
    scored = field_scores(docs, asked, fields, fuzzy, allowed).groupBy("query_id", "id").agg(F.max("s").alias("s"))  # the best field wins
    quoted = phrase_match(docs, asked, ["subject", "body"]) if quoted is None else quoted
    if allowed is not None:
        filtered = quoted.join(F.broadcast(asked.select("query_id", "filtered")), "query_id")
        quoted = filtered.where("not filtered").drop("filtered").unionByName(filtered.where("filtered").drop("filtered").join(allowed, ["query_id", "id"], "left_semi"))
    need = asked.select("query_id", (F.when(F.size(T.tokens(F.col("text"))) > 0, 1).otherwise(0) + F.when(F.size("phrases") > 0, 1).otherwise(0)).alias("need"))
    both = scored.unionByName(quoted.select("query_id", "id", "s")).groupBy("query_id", "id").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("got"))
    return both.join(F.broadcast(need), "query_id").where("got = need").select("query_id", "id", F.round("s", 6).alias("score"))


def bm25(docs: DataFrame, asked: DataFrame, fields: list[Field], top: int, fuzzy: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the best ``top`` of the keyword leg."""
    return ranked(bm25_leg(docs, asked, fields, fuzzy), top)


def ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def phrase_match(docs: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, id, s): documents with every phrase of the query word for word in one of the fields; 3 for one in the first field, 1 in others."""
    phrases = asked.select("query_id", F.explode("phrases").alias("p")).select("query_id", T.tokens(F.col("p")).alias("words")).where(F.size("words") > 0)
    phrases = phrases.withColumn("phrase", F.array_join("words", " ")).select("query_id", "phrase", "words").distinct()
    need = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    wanted = broadcast_if(phrases.select("query_id", "phrase", F.size("words").alias("k"), F.posexplode("words").alias("at", "term")), BROADCAST_TERMS)
    structs = F.array(*[F.struct(F.lit(i).alias("field"), T.tokens(F.col(f)).alias("w")) for i, f in enumerate(fields)])
    found = docs.select("id", F.explode(structs).alias("f")).select("id", "f.field", F.posexplode("f.w").alias("pos", "term"))
    hits = found.join(wanted, "term").groupBy("query_id", "phrase", "k", "id", "field", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n = k")
    placed = hits.groupBy("query_id", "id", "phrase", "field").agg(F.first("k").alias("k"))
    per = placed.groupBy("query_id", "id").agg(F.countDistinct("phrase").alias("got"), F.sum(F.when(F.col("field") == 0, 3.0).otherwise(1.0)).alias("s"))
    return per.join(F.broadcast(need), "query_id").where("got = need").select("query_id", "id", "s")


def fuse(legs: dict[str, DataFrame], top: int, k: int = 60) -> DataFrame:
    """(query_id, id, score, rank, <leg>_rank ...): reciprocal rank fusion of ranked legs (query_id, id, rank); a leg's rank is null where it lacks the document."""
    both = None
    for name, leg in legs.items():
        one = leg.where(F.col("rank") <= WINDOW).select("query_id", "id", F.lit(name).alias("leg"), "rank")
        both = one if both is None else both.unionByName(one)
    ranks = [F.max(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs]
    # legs are added in their order, so that sums do not depend on partitions
    total = sum((F.coalesce(1.0 / (k + F.col(f"{name}_rank")), F.lit(0.0)) for name in legs), F.lit(0.0))
    fused = both.groupBy("query_id", "id").agg(*ranks).withColumn("score", F.round(total, 9))
    return ranked(fused, top)


def page(fused: DataFrame, number: int, size: int) -> DataFrame:
    """A page of ranked results and whether more remain in the window."""
    last = fused.groupBy("query_id").agg(F.max("rank").alias("of"))
    cut = fused.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))
    return cut.join(last, "query_id").select("query_id", "id", "rank", (F.col("of") > number * size).alias("more"))


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours of ``queries`` (query_id, vector) among ``vectors`` (id, vector).

    The query set is cut into blocks; every block meets every row once, with a matrix product per batch
    and only the best k of a batch leaving the task.
    """
    kinds = {n: t.simpleString() for n, t in ((x.name, x.dataType) for x in (queries.schema["query_id"], vectors.schema["id"]))}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    numbered = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("qv"))
    blocks = numbered.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-numbered.count() // QUERY_BLOCK)))))
    packed = blocks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("query_id", "qv"))).alias("q"))
    spark = vectors.sparkSession
    found = None
    for row in packed.toLocalIterator():  # one block of the stated query set at a time
        shared = spark.sparkContext.broadcast(([x["query_id"] for x in row["q"]], np.array([x["qv"] for x in row["q"]], dtype=np.float64)))
        one = vectors.select("id", "vector").mapInArrow(_neighbours(shared, k), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found.withColumn("score", F.round("score", 6)), k)


def _neighbours(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            rows = batch.filter(batch.column(1).is_valid())
            if not rows.num_rows:
                continue
            v = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            scores = np.round(q @ v.T, 6)
            # ties at the border are kept, so that ids decide them later
            floor = -np.partition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, min(k, scores.shape[1]) - 1]
            i, j = np.nonzero(scores >= floor[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], pa.string() if isinstance(ids[0], str) else pa.int64()), rows.column(0).take(pa.array(j)), pa.array(scores[i, j])], ["query_id", "id", "score"])

    return run


def embed(rows: DataFrame, dims: int = 64) -> DataFrame:
    """(id, vector) of ``rows`` (id, text): the default embedder, by signed feature hashing of words, of length one; a model may take its place.

    A text without words has a zero vector.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            # every different word of a batch is hashed once
            hashed = np.array([int(hashlib.md5(w.encode()).hexdigest()[:6], 16) for w in coded.dictionary.to_pylist()], dtype=np.int64)
            slot, sign = hashed % dims, np.where((hashed // dims) % 2 == 0, 1.0, -1.0)
            words = coded.indices.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            out = np.bincount(row * dims + slot[words], weights=sign[words], minlength=batch.num_rows * dims).reshape(-1, dims)
            length = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.round(out / np.where(length == 0, 1, length), 6)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), dims).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "vector"])

    return rows.select("id", T.english_tokens(F.col("text")).alias("w")).mapInArrow(run, f"id {kind}, vector array<double>")


def vector_leg(passages: DataFrame, asked: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` documents by their best passage (id, text), among the allowed ones; phrases are filters.

    Passages are scored exactly against all queries in blocks. Filters come first: a query with filters or phrases meets
    only its own passages. Queries without words have no neighbours, nor have passages against the query's direction.
    """
    words = asked.select(F.col("query_id").alias("id"), F.concat_ws(" ", "text", F.array_join("phrases", " ")).alias("text"), (F.col("filtered") | (F.size("phrases") > 0)).alias("narrow"))
    queries = embed(words).join(words.drop("text"), "id").select(F.col("id").alias("query_id"), "vector", "narrow").where(F.exists("vector", lambda x: x != 0)).persist()
    vectors = embed(passages).where(F.exists("vector", lambda x: x != 0)).persist()
    vectors.count()  # made once, before both plans over it start
    wide = knn(vectors, queries.where("not narrow"), k * 8).select("query_id", "id", "score")
    if allowed is None:
        scored = wide
    else:
        dot = F.aggregate(F.zip_with("vector", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        own = allowed.join(F.broadcast(queries.where("narrow").select("query_id", F.col("vector").alias("q"))), "query_id")
        narrow = own.join(vectors, "id").select("query_id", "id", F.round(dot / (norm("vector") * norm("q")), 6).alias("score"))
        scored = wide.unionByName(narrow)
    best = scored.where("score > 0").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return ranked(best, k)


def corrections(docs: DataFrame, asked: DataFrame, field: str, known: DataFrame | None = None, min_len: int = 5) -> DataFrame:
    """(query_id, term, suggestion): for a term that the field lacks, its best one-edit neighbour, by frequency.

    ``known`` (word) vetoes: a word of another vocabulary is no typing error.
    """
    words = docs.select(F.lit(field).alias("field"), T.tokens(F.col(field)).alias("w"))
    vocab = vocabulary(words).persist()
    terms = query_terms(asked).where(F.length("term") >= min_len)
    have = vocab.select("term")
    missing = terms.join(have, "term", "left_anti")
    if known is not None:
        missing = missing.join(known.select(F.col("word").alias("term")), "term", "left_anti")
    near = fuzzy_expansion(vocab, missing.select(F.lit(field).alias("field"), "term").distinct()).where("d = 1")
    best = near.groupBy("term").agg(F.max_by("word", F.struct("df", "word")).alias("suggestion"))
    return missing.join(F.broadcast(best), "term").select("query_id", "term", "suggestion")


def corrected(asked: DataFrame, fixes: DataFrame) -> DataFrame:
    """(query_id, corrected): the free text with each wrong word replaced where it stands as a whole word, phrases appended."""
    pairs = fixes.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "suggestion")))).alias("m"))
    words = F.split("text", r"\s+")
    swapped = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at("m", F.lower(w)), w)), " ")
    quoted = F.array_join(F.transform("phrases", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " ")
    return asked.join(F.broadcast(pairs), "query_id").select("query_id", F.trim(F.concat_ws(" ", swapped, quoted)).alias("corrected"))


#: Signs that stand for the marks until the text is escaped.
_OPEN, _CLOSE = "\ue000", "\ue001"


def marked(text: Column, pattern: Column) -> Column:
    """``text`` escaped for HTML, with what ``pattern`` finds in the raw text marked by ``<em>``."""
    raw = F.regexp_replace(F.regexp_replace(text, f"[{_OPEN}{_CLOSE}]", ""), pattern, F.lit(f"{_OPEN}$1{_CLOSE}"))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        raw = F.replace(raw, F.lit(sign), F.lit(entity))
    return F.replace(F.replace(raw, F.lit(_OPEN), F.lit("<em>")), F.lit(_CLOSE), F.lit("</em>"))


def highlight(docs: DataFrame, hits: DataFrame, asked: DataFrame, width: int = 160, most: int = 2, first_chars: int = 100_000) -> DataFrame:
    """(query_id, id, subject_mark, fragments): the hits' subjects whole and up to two fragments of their bodies, escaped, with the query's words marked.

    The body is cut into stretches of ``width`` characters at white space; the stretches with most marks win, in
    their order in the text. Only the first ``first_chars`` of a body are looked at. Null where nothing is marked.
    """
    words = asked.select("query_id", F.array_distinct(T.tokens(F.concat_ws(" ", "text", F.array_join("phrases", " ")))).alias("w")).where(F.size("w") > 0)
    pattern = words.select("query_id", F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])("), F.array_join(F.array_sort("w"), "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("pattern"))
    found = hits.select("query_id", "id").join(F.broadcast(pattern), "query_id").join(docs.select("id", F.coalesce("subject", F.lit("")).alias("subject"), T.collapse_space(F.substring(F.coalesce("body", F.lit("")), 1, first_chars)).alias("body")), "id")
    pieces = F.regexp_extract_all("body", F.lit(rf"(\S(?:.{{0,{width - 2}}}\S)?(?: |$)|\S{{{width}}})"), 1)
    scored = F.transform(pieces, lambda p, i: F.struct((-F.size(F.regexp_extract_all(p, F.col("pattern"), 1))).alias("n"), i.alias("i"), F.trim(p).alias("p")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["n"] < 0)), 1, most)
    chosen = F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: marked(x["p"], F.col("pattern")))
    subject = F.when(F.rlike(F.col("subject"), F.col("pattern")), marked(F.col("subject"), F.col("pattern")))
    return found.select("query_id", "id", subject.alias("subject_mark"), F.array_join(F.when(F.size(chosen) > 0, chosen), " ... ").alias("fragments"))


def rerank(fused: DataFrame, asked: DataFrame, docs: DataFrame, score: Callable[[Column, Column], Column], window: int = 50) -> DataFrame:
    """(query_id, id, rank, rerank_score): the first ``window`` results in the order of ``score`` (of query text and document text), the rest in their places.

    Queries with phrases or filters, or without free text, keep their order: an explicit wish for precision is not overruled.
    ``score`` is pluggable; it sees the subject and the first 1,200 characters of the body.
    """
    open_ = asked.where(~F.col("filtered") & (F.size("phrases") == 0) & (F.col("text") != "")).select("query_id", "text")
    head = fused.where(F.col("rank") <= window).join(F.broadcast(open_), "query_id")
    body = F.substring(T.collapse_space(F.coalesce("body", F.lit(""))), 1, 1200)
    text = F.trim(F.concat_ws("\n", T.strip(F.coalesce("subject", F.lit(""))), body))
    scored = docs.select("id", text.alias("doc")).join(F.broadcast(head), "id").withColumn("rerank_score", F.round(score(F.col("text"), F.col("doc")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    first = scored.select("query_id", "id", F.row_number().over(order).alias("rank"), "rerank_score")
    kept = fused.join(F.broadcast(open_.select("query_id", F.lit(True).alias("again"))), "query_id", "left").where(F.col("again").isNull() | (F.col("rank") > window))
    return first.unionByName(kept.select("query_id", "id", "rank", F.lit(None).cast("double").alias("rerank_score")))


def overlap_score(query: Column, doc: Column) -> Column:
    """The default scorer: the share of the query's distinct words in the document, and a little for each at its beginning."""
    words = F.array_distinct(T.tokens(query))
    have = T.tokens(doc)
    head = F.slice(have, 1, 20)
    return (F.size(F.array_intersect(words, have)) + 0.25 * F.size(F.array_intersect(words, head))) / F.greatest(F.size(words), F.lit(1))
