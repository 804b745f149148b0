"""Problem 2: cut oversized items into overlapping pieces at natural boundaries.

An item is seen as *ranges*, of characters for the items of a table (:func:`split_items`) and of bytes for
files (:func:`split_files`), which are never needed whole in one place. A worker looks at one range with a
halo, so that boundaries near a range's border are seen by the worker that owns them. Each range reports its
length and its best cut next to its end (a one-row boundary table per range); the tables are stitched with
window functions, prefix sums of the lengths turn local positions into positions in the item, and the pieces
of each segment between two stitched cuts are emitted by offset.

Pieces: at most ``max_chars`` code points; a cut goes after the last paragraph end, else line end, else
sentence end, else word end in the second half of the allowed window, else at ``max_chars``; a piece
starts about ``overlap_chars`` before the end of the one before, at a word start where there is one.

Defined results: null and empty items, and items within the limit, give no pieces; a redelivered id is
cut once; null limits are ignored; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points of a range of a table's item, and at least four pieces.
RANGE_CHARS = 1 << 12
#: Bytes of a file's range.
RANGE_BYTES = 8 << 20

_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n\s*")
_LINE = re.compile(r"\r?\n")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*\s+")
_WORD = re.compile(r"\s+")
_LEVELS = ((_PARAGRAPH, "paragraph"), (_LINE, "line"), (_SENTENCE, "sentence"), (_WORD, "word"))


def best_cut(text: str, low: int, high: int) -> tuple[int, str]:
    """The last position in (low, high] after a boundary of the best level found there, and the level."""
    for pattern, level in _LEVELS:
        at = 0
        for m in pattern.finditer(text, low, high):
            if low < m.end() <= high:
                at = m.end()
        if at:
            return at, level
    return high, "none"


def cut_text(text: str, max_chars: int, overlap_chars: int, first: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, boundary at the end) of the pieces of ``text[first:]``; positions count code points.

    With ``first`` > 0 the text before it is only the halo from which the first piece's overlap is taken.
    """
    overlap = max(0, min(overlap_chars, max_chars - 1))
    pieces: list[tuple[int, int, str]] = []
    n, end = len(text), first
    while end < n:
        start = end
        if end and overlap:
            start = max(0, end - overlap)
            # a word start at or after it, not further than half of the overlap away
            if start and not text[start - 1].isspace() and (m := _WORD.search(text, start, start + overlap // 2 + 1)) and m.end() < end:
                start = m.end()
        limit = start + max_chars
        if limit >= n:
            end, level = n, "end"
        else:
            end, level = best_cut(text, max(end, start + max_chars // 2), limit)
        pieces.append((start, end, level))
    return pieces


def _stitched(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Per range its segment [seg_start, seg_end) in the item, from the ranges' local cuts and lengths."""
    order = Window.partitionBy(*keys).orderBy("range_no")
    base = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = bounds.withColumn("base", base).withColumn("seg_end", F.col("base") + F.col("cut"))
    return at.withColumn("seg_start", F.coalesce(F.lag("seg_end").over(order), F.lit(0)))


def split_items(items: DataFrame, specs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(spec_id, id, piece_no, start_pos, end_pos, boundary, piece) of the items (id, text) over a limit.

    ``specs`` (spec_id, max_chars, overlap_chars) is a small control table and is broadcast. A text goes through
    one shuffle, that by its id; boundary tables travel to it, not the text to them.
    """
    limits = specs.where("spec_id is not null and max_chars > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("max_chars").cast("int").alias("max_chars"), F.coalesce("overlap_chars", F.lit(0)).cast("int").alias("overlap_chars")).distinct()
    least = limits.agg(F.min("max_chars").alias("least"))
    named = items.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text")
    long_items = named.crossJoin(F.broadcast(least)).where(F.length("text") > F.col("least")).select("id", "text").dropDuplicates(["id"])
    each = long_items.join(F.broadcast(limits), F.length("text") > F.col("max_chars")).withColumn("n", F.length("text")).withColumn("step", F.greatest(F.lit(range_chars), 4 * F.col("max_chars")))
    halo = F.col("max_chars") + F.col("overlap_chars")

    # First pass: every range reports its length and its cut; it sees the text before its end only as far as a border may lie.
    ends = each.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("step")).cast("int"))))
    begin = F.col("range_no") * F.col("step")
    length = F.least(F.col("step"), F.col("n") - begin)
    tail = F.col("text").substr(begin + length - F.least(length, F.col("max_chars")) + 1, F.least(length, F.col("max_chars")))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [k if last else k - len(t) + _border(t, len(t), size) for size, last, k, t in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 5)), pa.array(cuts, pa.int64())], ["spec_id", "id", "range_no", "length", "cut"])

    reported = ends.select("spec_id", "id", "max_chars", "range_no", (begin + F.col("step") >= F.col("n")).alias("last"), length.cast("bigint").alias("length"), tail.alias("tail"))
    table = reported.mapInArrow(bounds, "spec_id int, id string, range_no int, length bigint, cut bigint")
    stitched = _stitched(table, ["id", "spec_id"]).groupBy("id").agg(F.collect_list(F.struct("spec_id", "base", "seg_start", "seg_end")).alias("segments"))

    # Second pass: the pieces of each stitched segment, by offset, with the halo that its first overlap needs.
    both = each.join(stitched, "id").withColumn("s", F.explode(F.expr("filter(segments, s -> s.spec_id = spec_id)"))).where("s.seg_end > s.seg_start")
    lead = F.least(F.col("s.seg_start"), halo.cast("bigint"))
    body = F.col("text").substr((F.col("s.seg_start") - lead + 1).cast("int"), (F.col("s.seg_end") - F.col("s.seg_start") + lead).cast("int"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for spec, ident, size, over, begin_, lead_, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for start, end, level in cut_text(text, size, over, lead_):
                    for column, value in zip(out, (spec, ident, begin_ - lead_ + start, begin_ - lead_ + end, level, text[start:end])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    names = ["spec_id", "id", "start_pos", "end_pos", "boundary", "piece"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    made = both.select("spec_id", "id", "max_chars", "overlap_chars", F.col("s.seg_start").alias("begin"), lead.alias("lead"), body.alias("body")).mapInArrow(emit, "spec_id int, id string, start_pos bigint, end_pos bigint, boundary string, piece string")
    # numbered through the item by their ends
    counts = Window.partitionBy("spec_id", "id").orderBy("end_pos")
    return made.withColumn("piece_no", F.row_number().over(counts)).select("spec_id", "id", "piece_no", "start_pos", "end_pos", "boundary", "piece")


def _border(body: str, at: int, size: int) -> int:
    """The cut that ends the segment of a range whose nominal end is ``at``: the best boundary in the ``size`` // 2 characters before it."""
    return best_cut(body, max(0, at - size // 2), at)[0]


def oversized(items: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, id): the items that :func:`split_items` had to cut."""
    return split_items(items, specs).where("piece_no = 1").select("spec_id", "id")


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap_chars: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start_pos, end_pos, boundary, piece): UTF-8 files on a shared file system, cut without loading a whole file.

    A task reads only one byte range and its halos. Ranges are moved to code-point borders, each worker
    reports its cut and length, the tables are stitched, and a second pass emits each segment's pieces.
    """
    import os

    halo = 4 * (max_chars + overlap_chars)
    plan = [(p, i, os.path.getsize(p)) for p in paths for i in range(max(1, -(-os.path.getsize(p) // range_bytes)))]
    ranges = spark.createDataFrame(plan, "path string, range_no int, size bigint").repartition(max(1, len(plan)), "path", "range_no")

    def read(path: str, no: int, size: int) -> tuple[str, str, str]:
        """Halo before, own text, halo after, each decoded from whole code points."""
        begin, stop = no * range_bytes, min(size, (no + 1) * range_bytes)
        lo, hi = max(0, begin - halo), min(size, stop + halo)
        with open(path, "rb") as f:
            f.seek(lo)
            raw = f.read(hi - lo)

        def border(at: int) -> int:
            while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            return at

        a, b, c = border(begin - lo), border(stop - lo), border(0) if lo == 0 else border(1)
        return raw[c if lo else 0 : a].decode("utf-8", "ignore"), raw[a:b].decode("utf-8", "ignore"), raw[b:].decode("utf-8", "ignore")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, no, size in zip(*(c.to_pylist() for c in batch.columns)):
                before, own, _ = read(path, no, size)
                last = (no + 1) * range_bytes >= size
                cut = len(own) if last else _border(before + own, len(before) + len(own), max_chars) - len(before)
                rows.append((path, no, size, len(own), cut))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["path", "range_no", "size", "length", "cut"])

    stitched = _stitched(ranges.mapInArrow(bounds, "path string, range_no int, size bigint, length bigint, cut bigint"), ["path"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, no, size, base, begin, stop in zip(*(c.to_pylist() for c in batch.columns)):
                before, own, _ = read(path, no, size)
                text, shift = before + own, base - len(before)
                for start, end, level in cut_text(text[: stop - shift], max_chars, overlap_chars, begin - shift):
                    rows.append((path, shift + start, shift + end, level, text[start:end]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["path", "start_pos", "end_pos", "boundary", "piece"])

    made = stitched.select("path", "range_no", "size", "base", "seg_start", "seg_end").mapInArrow(emit, "path string, start_pos bigint, end_pos bigint, boundary string, piece string")
    return made.withColumn("piece_no", F.row_number().over(Window.partitionBy("path").orderBy("end_pos"))).select("path", "piece_no", "start_pos", "end_pos", "boundary", "piece")
