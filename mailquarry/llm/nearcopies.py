"""Problem 5: near-copies with small edits, by count vectors in an R-tree over candidate lists.

A text is the set of its distinct ``width``-word shingles. Texts with equal word sequences are one
*content*. The join finds all pairs of contents whose sets have at least ``threshold`` in common:

1. A sketch of fixed size counts all shingles of the corpus; it orders shingles from rare to frequent. A shingle that
   occurs once joins nothing.
2. By the prefix-filter theorem two similar sets meet under a shingle that so many known (not single)
   shingles of either set follow in that order as the overlap needs. Every shingle that this can hold for is posted with
   the content and the number of known shingles from it on; pairs of a list whose sizes or numbers
   cannot reach the threshold are not made. Lists are sorted by size, so that most of those are never looked at.
3. Each content has a *count vector*: its shingles hashed into ``GROUPS`` groups, 4 bits a count. The sum of coordinate
   minima bounds the overlap of two contents, so pairs that cannot reach the threshold are pruned where they meet.
   Contents, sizes and vectors are not posted but kept in files of the shared folder, which tasks map; a posting has the
   row in such a file, and postings of a range of shingles are shuffled as one block. A list beyond ``LONG`` is packed, by
   size and vector, into the leaves of an R-tree whose boxes hold the coordinate maxima, and spread over tasks leaf
   pair by leaf pair; no list is cut.
4. Surviving pairs are verified on their full shingle sets, which lie in files of the shared folder too: shuffled is only where.
   Where that is no folder of files, blocks and pairs carry what else is in the files.

Defined results: null subjects and bodies count as empty; texts under ``min_words`` words take no part; a
repeated id counts once; ids of one thread are not paired, a null thread is a thread of its own; null ids
are left out; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.operators import messages as M
from mailquarry.runtime import checkpoint_dir

GROUPS = 128
#: Bytes of a count vector.
VECTOR = GROUPS // 2
#: Contents in a leaf; longer lists than LONG leaves are spread over the tasks.
LEAF, LONG = 256, 32
#: Sketch sizes, as powers of two: shingle counts, bits of contents.
COUNT_BITS, INVOLVED_BITS = 24, 24
#: The order of a shingle that occurs once, in steps of the logarithm of the counts.
SINGLE = 16
#: Bits of a shingle that tell its block of postings, and those that are posted: shingles that coincide in both only share a list.
BLOCK_BITS, KEY_BITS = 13, 24
#: Contents are looked for once each, if they are at most this share of the texts.
FEW_CONTENTS = 0.8
#: Pairs of a list compared at once.
PAIRS_AT_ONCE = 200_000
#: Postings and contents held by a task before they are written as blocks; a content's row has 16 bits.
POSTINGS_HELD, CONTENTS_HELD = 1_000_000, 60_000
#: Postings held by a task before their lists are joined.
ITEMS_HELD = 200_000
#: Bytes of shingle sets in a file.
SETS_HELD = 1 << 26
#: Meetings held by a task before those of one pair are summed.
PAIRS_HELD = 1_000_000
#: Sketches are sent and summed in blocks of so many bytes.
BLOCK = 1 << 18
#: The kind of a row of the first pass that is a member; smaller ones are parts of the sketch.
MEMBER = 1
#: Documents taken together by a worker.
BATCH_DOCS = 2_000

_WORDS = re.compile(r"[^\W_]+").findall
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _M[5]
    return x ^ (x >> np.uint64(32))


class Shingled:
    """The shingles of a batch of texts: parallel arrays doc and hash, sorted and distinct per doc."""

    def __init__(self, texts: list[str], min_words: int, width: int):
        flat: list[int] = []
        sizes, contents, self.rows = [], [], []
        for i, text in enumerate(texts):
            words = _WORDS(text.lower())
            if len(words) < max(min_words, width):
                continue
            content = xxhash.xxh64_intdigest(" ".join(words))
            self.rows.append(i)
            contents.append(content)
            sizes.append(len(words))
            flat.extend(map(_HASHES.__getitem__, words))
        self.content = np.array(contents, dtype=np.uint64)
        w = np.array(flat, dtype=np.uint64)
        length = np.array(sizes, dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), length)
        n = len(w)
        if n < width:
            self.doc = self.hash = np.zeros(0, dtype=np.uint64)
            self.size = np.zeros(len(sizes), dtype=np.int64)
            return
        starts = n - width + 1
        h = np.zeros(starts, dtype=np.uint64)
        for k in range(width):
            h = h * _M[0] + _mix(w[k : k + starts] * _M[k % 5])
        h = _mix(h)
        whole = doc[:starts] == doc[width - 1 :]
        d, h = doc[:starts][whole], h[whole]
        # one sort by document and the hash's first bits; equal hashes end up side by side
        order = np.argsort((d.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        d, h = d[order], h[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        self.doc, self.hash = d[new], h[new]
        self.size = np.bincount(self.doc, minlength=len(sizes))


def _set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            part = batch.slice(at, BATCH_DOCS)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def _blocks(kind: int, raw: bytes, size: int = BLOCK) -> Iterator[tuple[int, int, bytes]]:
    for b in range(0, len(raw), size):
        part = raw[b : b + size]
        if part.strip(b"\0"):
            yield kind, b // size, zlib.compress(part, 1)


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` parted by ``by`` as joins part it, so that what is kept of it is not shuffled again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def first_pass(texts: DataFrame, min_words: int, width: int) -> tuple[np.ndarray, DataFrame]:
    """(order of shingles by their counts, members) of all rows of ``texts`` (text, thread, id).

    The texts are split once for both; members is (content, id, thread), distinct, parted by content and kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["kind", "block", "raw"], [pa.int32(), pa.int32(), pa.binary()]
        counts = np.zeros(1 << COUNT_BITS, dtype=np.uint16)
        for batch, part in _texts(batches, 0):
            s = Shingled(part, min_words, width)
            if not len(s.rows):
                continue
            taken, none = batch.take(pa.array(s.rows, pa.int64())), len(s.rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(none, MEMBER, dtype=np.int32)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(s.content.view(np.int64)), taken.column(2), taken.column(1)], [*names, "content", "id", "thread"]
            )
            at, n = np.unique((s.hash >> np.uint64(64 - COUNT_BITS)).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)
        rows = list(_blocks(0, counts.tobytes()))
        made = _record(rows, names, kinds)
        yield pa.RecordBatch.from_arrays([*made.columns, *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.string(), pa.string()))], [*names, "content", "id", "thread"])

    def add(table: pa.Table) -> pa.Table:
        """Sums one block over the tasks; for the order alone, 255 steps of the logarithm do."""
        counts = sum(np.frombuffer(zlib.decompress(raw), dtype=np.uint16).astype(np.int64) for raw in table.column("raw").to_pylist())
        steps = np.round(15.9 * np.log2(np.minimum(counts, 65535) + 1.0)).astype(np.uint8)
        return pa.Table.from_batches([_record([(0, table.column("block")[0].as_py(), zlib.compress(steps.tobytes(), 1))], ["kind", "block", "raw"], [pa.int32(), pa.int32(), pa.binary()])])

    schema = "kind int, block int, raw binary"
    parts = texts.select("text", "thread", "id").mapInArrow(count, f"{schema}, content bigint, id string, thread string").persist()
    members = _spread(parts.where((F.col("kind") == MEMBER) & F.col("id").isNotNull()).select("content", "id", "thread"), "content").distinct().persist()
    members.count()  # made once, before plans that share it start side by side
    merged = parts.where(F.col("kind") < MEMBER).select("kind", "block", "raw").groupBy("block").applyInArrow(add, schema).collect()  # of fixed size, whatever the corpus
    order = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for row in merged:
        raw = np.frombuffer(zlib.decompress(row["raw"]), dtype=np.uint8)
        order[row["block"] * (BLOCK // 2) : row["block"] * (BLOCK // 2) + len(raw)] = raw
    parts.unpersist()
    return order, members


def count_vectors(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """One row of ``VECTOR`` bytes a document: the counts of its shingles in ``GROUPS`` groups, 4 bits each, 15 for 15 or more."""
    group = ((hashes >> np.uint64(7)) % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(doc * GROUPS + group, minlength=n_docs * GROUPS).reshape(n_docs, GROUPS)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return counts[:, 0::2] | (counts[:, 1::2] << 4)


def _unpack(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the counts; a count of 15 may be any number up to the size."""
    out = np.empty((len(vectors), GROUPS), dtype=np.int16)
    out[:, 0::2], out[:, 1::2] = vectors & 15, vectors >> 4
    return np.where(out == 15, np.minimum(sizes, 32767)[:, None], out).astype(np.int16)


_POSTING = np.dtype([("content", "<i8"), ("n", "<i4"), ("rest", "<i4"), ("vec", "u1", VECTOR)])


#: What a file has of a content.
_ENTRY = np.dtype([("content", "<i8"), ("n", "<i4"), ("vec", "u1", VECTOR)])


def _kept_vectors(texts: DataFrame) -> str | None:
    """A folder for files of contents in the shared folder; None if that is no folder of files: then nothing is pruned by vectors."""
    shared = checkpoint_dir(texts.sparkSession)
    if "://" in shared and not shared.startswith("file://"):
        return None
    return os.path.join(re.sub(r"^file:/*", "/", shared), f"vectors-{uuid.uuid4().hex}")


def _new_file(folder: str, rows: np.ndarray) -> str:
    """The name of a file of ``folder`` with ``rows``; another one for every attempt of a task."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    with open(f"{folder}/{name}.npy", "xb") as f:
        np.save(f, rows)
    return name


class _Files(dict):
    """Name -> rows of the file of ``folder``, mapped when first asked for."""

    def __init__(self, folder: str | None):
        self.folder = folder

    def __missing__(self, name: str) -> np.ndarray:
        rows = self[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return rows


def _bytes(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Rows of the low bytes of ``columns``, so many of each."""
    return np.concatenate([np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :n] for x, n in columns], axis=1)


def _number(planes: np.ndarray) -> np.ndarray:
    """The numbers whose bytes are the rows of ``planes``."""
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8")[:, 0]


def _posted(held: list[tuple], folder: str | None) -> pa.RecordBatch:
    """The postings held (shingle, row of the content, known shingles from there on; content, size and vector of the rows) in blocks, one a range of shingles."""
    key, row, rest, content, size, vec = (np.concatenate(x) for x in zip(*held))
    name = None
    if folder is not None:
        entries = np.zeros(len(content), dtype=_ENTRY)
        entries["content"], entries["n"], entries["vec"] = content.view(np.int64), size, vec
        name = _new_file(folder, entries)
    columns = [((key >> np.uint64(64 - BLOCK_BITS - KEY_BITS)), KEY_BITS // 8), (row, 2), (rest, 4)]
    packed = _bytes(*columns) if folder is not None else _bytes(*columns, (content.view(np.int64)[row], 8), (size[row], 4))
    block = (key >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, packed = block[order], packed[order]
    first = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
    # byte by byte, as bytes of one place resemble each other
    raw = [np.ascontiguousarray(packed[a:b].T).tobytes() for a, b in zip(first, [*first[1:], len(block)])]
    return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array([name] * len(first), pa.string()), pa.array(raw, pa.binary())], ["block", "file", "raw"])


def _read_block(block: int, name: str | None, raw: bytes, files: _Files) -> tuple[np.ndarray, np.ndarray]:
    """(keys, postings) of a block."""
    at = KEY_BITS // 8
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(at + (6 if name is not None else 18), -1)
    items = np.zeros(planes.shape[1], dtype=_POSTING)
    items["rest"] = _number(planes[at + 2 : at + 6])
    if name is None:
        items["content"], items["n"], items["vec"] = _number(planes[at + 6 : at + 14]), _number(planes[at + 14 :]), 255
    else:
        entries = files[name][_number(planes[at : at + 2])]
        for x in _ENTRY.names:
            items[x] = entries[x]
    return (block << KEY_BITS) | _number(planes[:at]), items


def _fit(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes and known shingles that follow allow the threshold; ``x`` and ``y`` have fields n and rest."""
    return (np.minimum(x["n"], y["n"]) >= threshold * np.maximum(x["n"], y["n"]) - 1e-9) & (np.minimum(x["rest"], y["rest"]) >= threshold / (1 + threshold) * (x["n"] + y["n"]) - 1e-9)


def _leaf_pairs(items: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """R-tree over a long list: leaves packed by size and vector; pairs of leaves whose boxes may hold similar contents."""
    items = items[np.lexsort((items["vec"][:, 1], items["vec"][:, 0], items["n"]))]
    leaves = [items[i : i + LEAF] for i in range(0, len(items), LEAF)]
    boxes = np.array([_unpack(x["vec"], x["n"]).max(axis=0) for x in leaves])
    low, high = np.array([x["n"].min() for x in leaves]), np.array([x["n"].max() for x in leaves])
    share = threshold / (1 + threshold)
    for i in range(len(leaves)):
        later = np.arange(i, len(leaves))
        ok = (low[later] * threshold <= high[i] + 1e-9) & (np.minimum(boxes[i], boxes[later]).sum(axis=1, dtype=np.int64) >= share * (low[i] + low[later]) - 1e-9)
        for j in later[ok]:
            yield leaves[i], leaves[j]


def _met(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the postings x[i], y[i] with vectors xv[i], yv[i] those whose summed coordinate minima allow the threshold: contents a < b."""
    low, high = np.minimum(xv & 15, yv & 15), np.minimum(xv >> 4, yv >> 4)
    bound = low.sum(axis=1, dtype=np.int32) + high.sum(axis=1, dtype=np.int32)
    full = np.flatnonzero((np.maximum(low, high) == 15).any(axis=1))  # counts of 15 or more are bounded by the size
    if len(full):
        bound[full] = np.minimum(_unpack(xv[full], x["n"][full]), _unpack(yv[full], y["n"][full])).sum(axis=1, dtype=np.int32)
    ok = (bound >= threshold / (1 + threshold) * (x["n"] + y["n"]) - 1e-9) & (x["content"] != y["content"])
    x, y = x[ok], y[ok]
    return np.minimum(x["content"], y["content"]), np.maximum(x["content"], y["content"])


def _shingles(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _is_set(bits: np.ndarray, ids: list[str]) -> np.ndarray:
    at = np.array([xxhash.xxh64_intdigest(x) >> (64 - INVOLVED_BITS) for x in ids], dtype=np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _bits(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size of the values in all columns of ``ids``."""

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (INVOLVED_BITS - 3), dtype=np.uint8)
        for batch in batches:
            for column in batch.columns:
                _set_bits(bits, np.array([xxhash.xxh64_intdigest(x) >> (64 - INVOLVED_BITS) for x in column.to_pylist()], dtype=np.int64))
        yield _record(list(_blocks(0, bits.tobytes())), ["kind", "block", "raw"], [pa.int32(), pa.int32(), pa.binary()])

    def either(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(r), dtype=np.uint8) for r in table.column("raw").to_pylist()])
        return pa.Table.from_batches([_record([(0, table.column("block")[0].as_py(), zlib.compress(bits.tobytes(), 1))], ["kind", "block", "raw"], [pa.int32(), pa.int32(), pa.binary()])])

    blocks = "kind int, block int, raw binary"
    mask = np.zeros(1 << (INVOLVED_BITS - 3), dtype=np.uint8)
    for row in ids.mapInArrow(involved, blocks).groupBy("block").applyInArrow(either, blocks).collect():
        raw = np.frombuffer(zlib.decompress(row["raw"]), dtype=np.uint8)
        mask[row["block"] * BLOCK : row["block"] * BLOCK + len(raw)] = raw
    return mask


def similar_contents(texts: DataFrame, threshold: float, min_words: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of ``texts`` (id, thread, text): pairs (a, b) of similar contents, a < b; members (content, id, thread)."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    folder = _kept_vectors(texts)
    order_of, members = first_pass(texts, min_words, width)
    steps = sc.broadcast(order_of)

    # Two contents of one and the same thread only are no pair.
    thread = members.groupBy("content").agg(F.when((F.min("thread") == F.max("thread")) & (F.count("thread") == F.count(F.lit(1))), F.min("thread")).alias("t"), F.min("id").alias("r")).persist()
    copied = thread.count() <= FEW_CONTENTS * members.count()
    first = sc.broadcast(_bits(thread.select("r"))) if copied else None

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = waiting = 0
        for batch, part in _texts(batches, 0):
            if first is not None:
                # one text a content, and the few whose bit is set by chance
                ids = batch.column(1).to_pylist()
                part = [t for t, i in zip(part, ids) if i is not None and _is_set(first.value, [i])[0]]
            s = Shingled(part, min_words, width)
            if not len(s.doc):
                continue
            step = steps.value[(s.hash >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
            # copies of one content within the batch post once
            only = np.zeros(len(s.size), dtype=bool)
            only[np.unique(s.content, return_index=True)[1]] = True
            known = np.flatnonzero((step > SINGLE) & only[s.doc])
            # stable, so that equal counts stay in the order of their hashes
            order = known[np.argsort((s.doc[known].astype(np.int64) << 16) | step[known], kind="stable")]
            doc = s.doc[order]
            n_known = np.bincount(doc, minlength=len(s.size))
            rest = np.cumsum(n_known)[doc] - np.arange(len(order))
            at = rest >= threshold * s.size[doc] - 1e-9
            order, doc, rest = order[at], doc[at], rest[at]
            own = np.unique(doc)
            if not len(own):
                continue
            held.append((s.hash[order], rows + np.searchsorted(own, doc), rest, s.content[own], s.size[own], count_vectors(s.doc, s.hash, len(s.size))[own]))
            rows, waiting = rows + len(own), waiting + len(order)
            if waiting > POSTINGS_HELD or rows > CONTENTS_HELD:
                yield _posted(held, folder)
                held, rows, waiting = [], 0, 0
        if held:
            yield _posted(held, folder)

    postings = texts.select("text", "id").mapInArrow(post, "block int, file string, raw binary")

    share = threshold / (1 + threshold)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["a", "b", "left", "right"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        files = _Files(folder)

        def met(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _met(x, y, x["vec"], y["vec"], threshold)
            if len(a):
                none = pa.nulls(len(a), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names)

        def inside(items: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            """All pairs within lists, many lists at once; the items of a list are sorted by size."""
            of = np.repeat(np.arange(len(size)), size)
            # an item meets those after it up to the size that its own size and its known shingles allow
            most = np.floor(np.minimum(items["n"] / threshold, items["rest"] / share - items["n"]) + 1e-6).astype(np.int64)
            end = np.searchsorted((of << 32) | items["n"], (of << 32) | np.maximum(most, 0), side="right")
            later = np.maximum(end - np.arange(len(items)) - 1, 0)
            begin, total = 0, np.cumsum(later)
            while begin < len(items):
                stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
                n = later[begin:stop]
                i = np.repeat(np.arange(begin, stop), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                begin = stop
                ok = items["rest"][j] >= share * (items["n"][i] + items["n"][j]) - 1e-9
                if ok.any():
                    yield from met(items[i[ok]], items[j[ok]])

        def lists(key: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            size = np.diff(np.concatenate((first, [len(key)])))
            for f, n in zip(first[size > LONG * LEAF], size[size > LONG * LEAF]):
                for x, y in _leaf_pairs(items[f : f + n], threshold):
                    yield _record([(int(x["content"][0]), int(y["content"][0]), x.tobytes(), y.tobytes())], names, kinds)
            small = np.repeat((size <= LONG * LEAF) & (size > 1), size)
            if small.any():
                key, items = key[small], items[small]
                first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
                yield from inside(items, first, np.diff(np.concatenate((first, [len(key)]))))

        held_key, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=_POSTING)]
        waiting = 0

        def sorted_lists(last: bool) -> Iterator[pa.RecordBatch]:
            key, items = np.concatenate(held_key), np.concatenate(held)
            # the last block may go on in the next rows
            cut = len(key) if last else int(np.argmax((key >> KEY_BITS) == (key[-1] >> KEY_BITS)))
            held_key[:], held[:] = [key[cut:]], [items[cut:]]
            key, items = key[:cut], items[:cut]
            if len(key) > 1:
                order = np.lexsort((-items["rest"], items["content"], items["n"], key))  # copies of one content stand side by side
                key, items = key[order], items[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (items["content"][1:] != items["content"][:-1])
                yield from lists(key[new], items[new])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                key, items = _read_block(*row, files)
                held_key.append(key)
                held.append(items)
                waiting += len(items)
                if waiting > ITEMS_HELD:
                    yield from sorted_lists(False)
                    waiting = 0
        yield from sorted_lists(True)

    schema = "a bigint, b bigint, left binary, right binary"

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of ``gather`` with a task's meetings of one pair as one row, in blocks of bounded size."""
        held: list[np.ndarray] = []

        def one() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held))
            held.clear()
            none = pa.nulls(len(pairs), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(pairs["a"]), pa.array(pairs["b"]), none, none], ["a", "b", "left", "right"])

        size = 0
        for batch in gather(batches):
            if batch.column(2).null_count < batch.num_rows:
                yield batch
                continue
            pairs = np.zeros(batch.num_rows, dtype=[("a", "<i8"), ("b", "<i8")])
            pairs["a"], pairs["b"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append(pairs)
            size += batch.num_rows
            if size > PAIRS_HELD:
                yield one()
                size = 0
        if size:
            yield one()

    listed = _spread(postings, "block").sortWithinPartitions("block").mapInArrow(once, schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_py(), dtype=_POSTING), np.frombuffer(right.as_py(), dtype=_POSTING)
                for i in range(len(x)):
                    near = y[_fit(x[i : i + 1], y, threshold)]
                    own = np.repeat(x[i : i + 1], len(near))
                    a, b = _met(own, near, own["vec"], near["vec"], threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # Leaf pairs of long lists are spread over the tasks before they are compared; other meetings are shuffled once.
    listed = listed.persist()
    listed.count()  # made once, before the two plans over it start side by side
    spread = listed.where("left is not null").repartition(F.xxhash64("a", "b", F.length("left"))).mapInArrow(expand, "a bigint, b bigint")
    met = _spread(listed.where("left is null").select("a", "b").unionByName(spread), "a").distinct()

    one, two = (thread.select(F.col("content").alias(x), F.col("t").alias(f"t{x}"), F.col("r").alias(f"r{x}")) for x in "ab")
    candidates = met.join(one, "a").join(two, "b").where("ta is null or tb is null or ta <> tb").select("a", "b", "ra", "rb").persist()

    keep = sc.broadcast(_bits(candidates.select("ra", "rb")))  # a filter of fixed size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def written() -> pa.RecordBatch:
            content, size, own = (np.concatenate(x) for x in zip(*held))
            start = np.cumsum(size) - size
            if folder is not None:
                name, raw = _new_file(folder, own), pa.nulls(len(content), pa.binary())
            else:
                name, raw = None, pa.array([own[a : a + n].tobytes() for a, n in zip(start, size)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array([name] * len(content), pa.string()), pa.array(start), pa.array(size), raw], ["content", "file", "start", "size", "raw"])

        for batch, part in _texts(batches, 0):
            ids = batch.column(1).to_pylist()
            chosen = np.flatnonzero(_is_set(keep.value, ids))
            s = Shingled([part[i] for i in chosen], min_words, width)
            if not len(s.doc):
                continue
            # 6 bytes tell the shingles of two texts apart
            held.append((s.content, s.size, np.ascontiguousarray(s.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])))
            if sum(x[2].nbytes for x in held) > SETS_HELD:
                yield written()
                held.clear()
        if held:
            yield written()

    # Only the representatives of contents in candidate pairs are split again, one text a content; a text delivered again is read again.
    wanted = texts.where("id is not null").select("text", "id").mapInArrow(sets, "content bigint, file string, start bigint, size bigint, raw binary")
    wanted = _spread(wanted, "content").dropDuplicates(["content"]).persist()
    wanted.count()

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)

        def shingles(where: dict) -> np.ndarray:
            if where["file"] is None:
                return _shingles(where["raw"])
            return _shingles(files[where["file"]][where["start"] : where["start"] + where["size"]].tobytes())

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = shingles(x), shingles(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    at_a, at_b = (wanted.select(F.col("content").alias(x), F.struct("file", "start", "size", "raw").alias(f"s{x}")) for x in "ab")
    pairs = candidates.select("a", "b").join(at_a, "a").join(at_b, "b").select("a", "b", "sa", "sb").mapInArrow(overlap, "a bigint, b bigint")

    return pairs, members


def near_copies(texts: DataFrame, threshold: float = 0.6, min_words: int = 30, width: int = 3) -> DataFrame:
    """(id_a, id_b): all pairs of ids of different threads whose texts are similar, id_a < id_b."""
    pairs, members = similar_contents(texts, threshold, min_words, width)
    return _expanded(pairs, members.persist())


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    left = members.select(F.col("content").alias("a"), F.col("id").alias("ia"), F.col("thread").alias("ta"))
    right = members.select(F.col("content").alias("b"), F.col("id").alias("ib"), F.col("thread").alias("tb"))
    shared = members.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("content").alias("a"), F.col("content").alias("b"))
    # copies of one content are similar too; each unordered pair of them once
    both = pairs.join(left, "a").join(right, "b").unionByName(shared.join(left, "a").join(right, "b").where("ia < ib"))
    apart = both.where("ia <> ib and (ta is null or tb is null or ta <> tb)")
    found = apart.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    # an id with several texts or threads may give a pair again
    return found if members.select("id").distinct().count() == members.count() else found.distinct()


def copy_classes(texts: DataFrame, threshold: float = 0.6, min_words: int = 30, width: int = 3) -> DataFrame:
    """(id, class_id, n_copies, n_links): one row per id that takes part.

    ``class_id`` is the least id of all texts connected by near-copies, ``n_copies`` the number of ids with the same
    words, ``n_links`` the number of ids of other threads with a similar or equal text. Links are counted from the
    sizes of contents and of their threads; pairs of ids are never built.
    """
    pairs, members = similar_contents(texts, threshold, min_words, width)
    pairs = pairs.persist()
    roots = M.components(members.select(F.col("content").alias("id")), pairs.select(F.col("a").alias("id"), F.col("b").alias("parent")))
    per_thread = members.groupBy("content", "thread").agg(F.countDistinct("id").alias("k")).persist()
    sizes = per_thread.groupBy("content").agg(F.sum("k").alias("n"))
    near = pairs.select(F.col("a").alias("content"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("content"), F.col("a").alias("other")))
    around = near.join(sizes.select(F.col("content").alias("other"), "n"), "other").groupBy("content").agg(F.sum("n").alias("beside"))
    # ids of the same thread among the similar contents are no links
    own = near.join(per_thread.where("thread is not null").select(F.col("content").alias("other"), "thread", "k"), "other").groupBy("content", "thread").agg(F.sum("k").alias("kin"))
    first = members.groupBy("content").agg(F.min("id").alias("least")).join(roots, F.col("content") == F.col("id"))
    ids = first.groupBy("component").agg(F.min("least").alias("class_id")).join(first, "component").select("content", "class_id")
    known = members.join(ids, "content").join(sizes, "content").join(around, "content", "left").join(own, ["content", "thread"], "left").join(per_thread, ["content", "thread"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    links = F.col("n") + zero("beside") - F.when(F.col("thread").isNull(), 1).otherwise(zero("kin") + zero("k"))
    return known.select("id", "class_id", F.col("n").alias("n_copies"), links.cast("bigint").alias("n_links"))
