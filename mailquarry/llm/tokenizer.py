"""Problem 7: encode a whole corpus with a public byte-level BPE vocabulary.

Each pre-token ("word") is merged on a contiguous rank array: a list of part boundaries and, beside
it, the rank of the pair that starts at each boundary. The minimum rank is found by a scan, one
boundary is deleted, and only the two neighbouring ranks are refreshed. For long words, where the
repeated scan would be quadratic, the same merges come from a heap over a linked list.

Defined results: null, empty text -> empty list of ids; special tokens' spellings are ordinary text;
repeated rows are encoded one by one; extra columns are ignored; a null id stays null.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words of more bytes than this are merged with a heap.
LONG_WORD = 96
#: A worker's word cache is emptied beyond so many words, which bounds its memory.
CACHE_WORDS = 400_000
#: The characters with the Unicode property White_Space, and the splitting pattern of the byte-level files.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters encoded at once by a worker before its output batch is closed.
BATCH_CHARS = 4_000_000


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word`` by repeated minimum scans over a contiguous rank array."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    none = 1 << 30
    n = len(word)
    bounds = list(range(n + 1))
    pair = [ranks.get(word[i : i + 2], none) for i in range(n - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        at = pair.index(low)
        del bounds[at + 1]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(word[bounds[at] : bounds[at + 2]], none)
        if at:
            pair[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as :func:`merge_scan` in n log n steps, for long words."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the part starting at i
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Word -> ids, filled when a word is first seen."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = merge_scan(raw, self.ranks) if len(raw) <= LONG_WORD else merge_heap(raw, self.ranks)
        if len(raw) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class _Chunks(dict):
    """White space and the visible run after it -> ids."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> list[int]:
        ids = list(chain.from_iterable(map(self.owner.words.__getitem__, self.owner.words_of(chunk))))
        if len(chunk) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """One worker's encoder for a rank file and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.words = _Words(self.ranks)
        self.chunks = _Chunks(self)
        # Unicode white space without the four separators that only Python counts as such.
        self.words_of = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # No alternative of the byte-level pattern crosses from a visible character to white space, so a run of
        # white space with the visible run after it is encoded by itself, and repeated ones come from the cache.
        self.split, self.get = self.words_of, self.words.__getitem__
        if pattern == BYTE_LEVEL_PATTERN:
            self.split, self.get = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall, self.chunks.__getitem__

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.get, self.split(text))))


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def encode_column(df: DataFrame, id_col: str, text_col: str, rank_file: str, pattern: str) -> DataFrame:
    """(``id_col``, ids array<int>): one row per row of ``df``; a narrow map without any shuffle."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        get, split, many = enc.get, enc.split, chain.from_iterable
        for batch in batches:
            texts = batch.column(1)
            flat, ends, start, chars = array("i"), [0], 0, 0
            for i, value in enumerate(texts):
                text = value.as_py()
                if text:
                    flat.extend(many(map(get, split(text))))
                    chars += len(text)
                ends.append(len(flat))
                if chars >= BATCH_CHARS or i + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), lists], [id_col, "ids"])
                    flat, ends, start, chars = array("i"), [0], i + 1, 0

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
