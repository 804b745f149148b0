"""Problem 8: held-out passages inside a training corpus, by a positional inverted index.

The test items are the stated query set; they are taken in blocks of bounded size, and every block meets
every document. Per block:

1. The document frequency of every test word is counted over the whole corpus, summed within a task first.
2. Each window of successive item words is represented by its rarest positions (a window with a word that
   the corpus lacks cannot occur as it is). Those positions are the index: word -> (item, position).
3. One pass over the documents makes the postings of the indexed words, subtracts the item's position from
   the document's, and intersects the lists: two positions of one window must meet at one offset (exact
   passages) or within a band of offsets (proximity). A document's postings are all in its row, so nothing
   of the corpus is shuffled and no word is a hot key.
4. What survives is compared with the document word by word.

An exact passage is a run of at least ``min_words`` item words. A proximity match is a stretch of ``reach``
successive item words of which at least ``min_words`` stand in the document at offsets that differ by at
most ``slop``: words may be inserted, left out or swapped. Windows are represented by so many rare positions
that no match of either kind can be missed.

Defined results: null or empty texts, and items shorter than ``min_words``, match nothing; repeated rows
count once; null ids are left out; of items that repeat an id each text counts; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Test items are taken together in blocks of about so many words; a block's index is sent to every executor.
BLOCK_WORDS = 300_000
#: Documents taken together by a worker, postings expanded and words compared at once.
BATCH_DOCS, POSTINGS_AT_ONCE, COMPARED_AT_ONCE = 1_000, 4_000_000, 8_000_000

words_of = re.compile(r"[^\W_]+").findall


class Block:
    """A block of items as arrays: all item words as ids, one item after the other."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = [i for i, _ in rows]
        self.size = np.array([len(w) for _, w in rows], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)
        self.words = np.array([number(w, len(self.vocabulary)) for _, ws in rows for w in ws], dtype=np.int32)

    def index(self, df: np.ndarray, length: int, least: int, rare: int) -> None:
        """Keeps the ``rare`` rarest positions of each window of ``length`` words of which at least ``least`` are in the corpus."""
        kept: set[int] = set()
        for start, size in zip(self.start.tolist(), self.size.tolist()):
            seen = df[self.words[start : start + size]]
            if size < least:
                continue
            order = np.argsort(seen, kind="stable")
            rank = np.empty(size, dtype=np.int64)
            rank[order] = np.arange(size)
            for s in range(max(1, size - length + 1)):
                known = [p for p in range(s, min(s + length, size)) if seen[p]]
                if len(known) >= least:
                    # words that the corpus lacks use up as many of the positions that a match may miss
                    kept.update(start + p for p in sorted(known, key=rank.__getitem__)[: max(2, rare - (min(length, size) - len(known)))])
        at = np.array(sorted(kept), dtype=np.int64)
        order = np.argsort(self.words[at], kind="stable") if len(at) else at
        self.post = at[order]
        self.count = np.bincount(self.words[self.post], minlength=len(self.vocabulary) + 1) if len(at) else np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.item_of = np.repeat(np.arange(len(self.size)), self.size)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): for each i the values first[i] .. first[i] + count[i] - 1."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _parts(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` summed weight."""
    total, begin = np.cumsum(weights), 0
    while begin < len(weights):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        yield slice(begin, stop)
        begin = stop


class Documents:
    """A batch of documents as arrays of word ids; words that the block lacks are -1."""

    def __init__(self, texts: list[str | None], vocabulary: dict[str, int]):
        get, flat, sizes = vocabulary.get, [], []
        for text in texts:
            own = [get(w, -1) for w in words_of(text.lower())] if text else []
            flat += own
            sizes.append(len(own))
        self.size = np.array(sizes, dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)
        self.words = np.array(flat, dtype=np.int32)
        self.doc = np.repeat(np.arange(len(sizes)), self.size)

    def meetings(self, block: Block, band: int, length: int) -> np.ndarray:
        """Columns (doc, item, offset) at which two indexed positions of one window of the item stand at offsets within ``band``."""
        found: list[np.ndarray] = []
        at = np.flatnonzero(block.count[self.words] > 0) if len(self.words) else np.zeros(0, dtype=np.int64)
        # whole documents stay together
        per_doc = np.bincount(self.doc[at], weights=block.count[self.words[at]], minlength=len(self.size)).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.doc[at], minlength=len(self.size)))))
        for part in _parts(per_doc, POSTINGS_AT_ONCE):
            mine = at[ends[part.start] : ends[part.stop]]
            term = self.words[mine]
            owner, k = _spread(block.first[term], block.count[term])
            where, g = mine[owner], block.post[k]
            item = block.item_of[g]
            ipos = g - block.start[item]
            doc = self.doc[where]
            off = where - self.start[doc] - ipos
            pair = doc * len(block.items) + item
            order = np.lexsort((ipos, off, pair))
            pair, off, ipos = pair[order], off[order], ipos[order]
            if band == 0:
                near = (pair[1:] == pair[:-1]) & (off[1:] == off[:-1]) & (ipos[1:] - ipos[:-1] < length)
            else:
                near = np.zeros(max(0, len(pair) - 1), dtype=bool)
                live = np.arange(len(near))
                for step in range(1, len(pair)):  # ends as soon as no posting has a partner so far on
                    live = live[live + step < len(pair)]
                    live = live[(pair[live + step] == pair[live]) & (off[live + step] - off[live] <= band)]
                    if not len(live):
                        break
                    gap = np.abs(ipos[live + step] - ipos[live])
                    near[live[(gap < length) & (gap > 0)]] = True
            hit = np.flatnonzero(near)
            found.append(np.unique(np.stack([pair[hit], off[hit]]), axis=1))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        return np.stack([both[0] // len(block.items), both[0] % len(block.items), both[1]])

    def _equal(self, block: Block, doc: np.ndarray, item: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, equal) over all item positions of each meeting."""
        owner, g = _spread(block.start[item], block.size[item])
        at = off[owner] + g - block.start[item][owner]
        inside = (at >= 0) & (at < self.size[doc][owner])
        equal = np.zeros(len(owner), dtype=bool)
        equal[inside] = self.words[(self.start[doc][owner] + at)[inside]] == block.words[g[inside]]
        return owner, equal

    def longest_runs(self, block: Block, met: np.ndarray) -> np.ndarray:
        """The longest run of equal words of each meeting."""
        out = np.zeros(met.shape[1], dtype=np.int64)
        for part in _parts(block.size[met[1]], COMPARED_AT_ONCE):
            owner, equal = self._equal(block, *met[:, part])
            # a run ends before an unequal word and at the end of an item
            stop = np.flatnonzero(~equal | np.append(owner[1:] != owner[:-1], True))
            before = np.concatenate(([-1], stop[:-1]))
            np.maximum.at(out[part], owner[stop], stop - before - 1 + equal[stop])
        return out

    def nearest(self, block: Block, met: np.ndarray, band: int, length: int) -> np.ndarray:
        """The most words among ``length`` successive item words that stand within one band of offsets that holds the meeting's."""
        out = np.zeros(met.shape[1], dtype=np.int64)
        for part in _parts(block.size[met[1]] * (2 * band + 1), COMPARED_AT_ONCE):
            doc, item, off = met[:, part]
            each = [self._equal(block, doc, item, off + d) for d in range(-band, band + 1)]
            owner = each[0][0]
            first = np.searchsorted(owner, np.arange(len(doc)))
            for low in range(band + 1):
                hit = np.logical_or.reduce([e for _, e in each[low : low + band + 1]])
                total = np.concatenate(([0], np.cumsum(hit)))
                at = np.arange(len(owner))
                begin = np.maximum(at - length + 1, first[owner])
                np.maximum.at(out[part], owner, total[at + 1] - total[begin])
        return out


def _blocks(items: DataFrame, min_words: int) -> Iterator[Block]:
    """The items in blocks; one block at a time is on the driver."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    many = max(1, -(-size // BLOCK_WORDS))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(many)))
    for b in range(many):
        read = [(r["item_id"], words_of(r["text"].lower())) for r in packed.where(F.col("block") == b).orderBy("item_id", "text").toLocalIterator()]
        read = [(i, w) for i, w in read if len(w) >= min_words]
        if read:
            yield Block(read)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            yield batch.slice(at, BATCH_DOCS)


def document_frequencies(docs: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each word of the block occurs; one row a word and task is shuffled, one a word collected."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        known = shared.value.keys()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(known & set(words_of(text.lower())))
        terms = [shared.value[w] for w in seen]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])

    counted = docs.where("text is not null").select("text").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(block.vocabulary) + 1, dtype=np.int64)
    for r in counted.collect():  # at most the words of the block
        df[r["term"]] = r["df"]
    return df


def _matches(docs: DataFrame, items: DataFrame, min_words: int, reach: int, slop: int) -> DataFrame:
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, n_words int, n_near int"
    corpus = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for block in _blocks(items, min_words):
        # of ``reach`` words reach - min_words may be missing, so that one more and one to meet are enough
        block.index(document_frequencies(docs, block), reach, min_words, max(2, reach - min_words + 2))
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in _batches(batches):
                d = Documents(batch.column(1).to_pylist(), own.vocabulary)
                met = d.meetings(own, slop, reach)
                exact = d.longest_runs(own, met)
                near = d.nearest(own, met, slop, reach) if slop else exact
                ok = np.flatnonzero((exact if not slop else np.maximum(exact, near)) >= min_words)
                ids = batch.column(0).take(pa.array(met[0][ok], pa.int64()))
                names = pa.array([own.items[i] for i in met[1][ok]], to_arrow_type(item_kind))
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(exact[ok].astype(np.int32)), pa.array(near[ok].astype(np.int32))], ["doc_id", "item_id", "n_words", "n_near"])

        one = corpus.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_near").alias("n_near"))


def leaked_passages(docs: DataFrame, items: DataFrame, min_words: int = 10) -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold at least ``min_words`` successive words of an item.

    ``n_words`` is the length of the longest exact run found. One row per pair.
    """
    return _matches(docs, items, min_words, min_words, 0).select("doc_id", "item_id", "n_words")


def near_passages(docs: DataFrame, items: DataFrame, min_words: int = 10, reach: int = 15, slop: int = 5) -> DataFrame:
    """(doc_id, item_id, n_near): proximity matches, which include the exact ones; ``n_near`` is the most item words near each other."""
    return _matches(docs, items, min_words, max(reach, min_words), slop).where(F.col("n_near") >= min_words).select("doc_id", "item_id", "n_near")


def leak_report(docs: DataFrame, items: DataFrame, min_words: int = 10, reach: int = 15, slop: int = 5) -> DataFrame:
    """(item_id, n_docs, longest, n_near_docs, most_near): one row per item, also for items that did not leak."""
    exact = leaked_passages(docs, items, min_words).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))
    near = near_passages(docs, items, min_words, reach, slop).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_near_docs"), F.max("n_near").alias("most_near"))
    all_items = items.where("item_id is not null").select("item_id").distinct()
    joined = all_items.join(exact, "item_id", "left").join(near, "item_id", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return joined.select("item_id", zero("n_docs", "bigint"), zero("longest", "int"), zero("n_near_docs", "bigint"), zero("most_near", "int"))
