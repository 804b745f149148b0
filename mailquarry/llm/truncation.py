"""Problem 9: texts cut off by field limits or broken transfers.

Two kinds of evidence are combined.

* Prefix evidence, the method named for the problem: every text gives the hashes of its prefixes of fixed
  lengths (1, 2, 4, ... characters). A text that does not end in a sentence asks under the longest of its own;
  texts that share that hash and are longer are hashed once more at exactly the lengths asked for, and what
  agrees is a strict prefix of a longer copy. The lengths asked for under a key are few (less than the key's
  length), so no pairs of texts are made, however many texts begin alike.
* End-state evidence, for cut texts of which no longer copy exists anywhere: the text, without marks left
  by the cut, stops neither at a sentence end nor in a signature, list line, link or closing note. Which
  short last paragraphs are closings or notes is learned from their counts over the distinct texts of the
  corpus, beside a fixed list; at which lengths a source cuts is learned from the piles in its lengths.

Each text is read twice, once for its length and once for its ends and hashes; only small rows are kept.

Defined results: null, empty and blank texts are no cases, neither are rows without an id; each stored copy is
judged like its twin; a null source is a source of its own in the report; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.runtime import broadcast_if

#: A last paragraph's first line counts as a closing or a note if it ends at least so many different texts ...
MIN_RECURRENCE = 5
#: ... and at least this share of the texts that don't end in a sentence.
MIN_SHARE = 2e-4
#: A length is a field limit if at least so many different texts of a source have exactly it, and none is longer
#: or only half as many have one of the lengths around it.
MIN_AT_LIMIT, AROUND = 4, 20
#: Rows of limits, recurring lines and texts asked for that are sent to every executor; more are joined by shuffling.
BROADCAST_ROWS = 100_000

#: Closing formulas and device notes in the corpus languages, lower case.
CLOSINGS = (
    r"(?:(?:very )?(?:best|kind|kindest|warm|warmest|many)? ?(?:regards|wishes|thanks)|rgds|best|thank you(?: very much)?|thx|cheers|sincerely|yours(?: (?:truly|sincerely|faithfully))?"
    r"|atentamente|saludos(?: cordiales)?|un (?:cordial )?saludo|gracias|cordialement|salutations|bien à vous|merci|bien cordialement"
    r"|(?:viele|beste|liebe|schöne) grüße|mit freundlichen grüßen|mfg|gruß|danke)"
)
NOTES = r"(?:sent from my .{2,60}|sent via .{2,60}|dictated,? (?:but )?not read|von unterwegs gesendet|gesendet von [\w -]{2,30}|envoyé de [\w -]{2,30}|enviado desde [\w -]{2,30}|to be continued)"
#: The characters with the Unicode property White_Space, and those that a cut may leave besides.
WHITE = " \t\n\x0b\x0c\r\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
LEFT_BY_CUT = WHITE + "\x00�=…"

_SENTENCE = re.compile(r"""[.!?]["'”’)\]]*\Z""")
_ABBREVIATION = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Nr|St|Sr|Sra)\.\Z")
_AMOUNT = re.compile(r"(?:USD |[$€£])[\d,]+\.\Z")
_PROSE = re.compile(r"^(?:\S+[ \t]+){7}\S+", re.M | re.A)
_CLOSING = re.compile(f"{CLOSINGS}[,.!]?")
_RULE_OR_NAME = re.compile(r"[-_=*~]{1,80}|[-–—/~][ \t]?(?:[^\W\d_]|[. ]){2,30}")
_NOTE = re.compile(rf"[-~*_ ]*{NOTES}[-~*_ ]*", re.I)
_LINK = re.compile(r"<?(?:(?:https?|ftp)://\S+|www\.\S+|\S+@\S+\.\w+)>?", re.I)
_ITEM = re.compile(r"(?:[-*•]|\d{1,2}[.)])\s")
_LAID_OUT = re.compile(r"[=_*-]{4,}\s*\Z")


def field_limits(docs: DataFrame) -> DataFrame:
    """(source, unit, limit, n): lengths in characters or bytes at which different texts of a source pile up."""
    whole = F.col("text")
    lengths = docs.where(F.length(F.trim("text")) > 0).select(
        "source", F.xxhash64(whole).alias("h"), F.posexplode(F.array(F.length(whole), F.octet_length(F.when(whole.endswith("�"), F.regexp_replace(whole, "�+$", "")).otherwise(whole)))).alias("unit", "len")
    )
    piles = lengths.groupBy("source", "unit", "len").agg(F.countDistinct("h").alias("n"))
    per = Window.partitionBy("source", "unit")
    around = F.sum("n").over(per.orderBy("len").rangeBetween(-AROUND, AROUND)) - F.col("n")
    seen = piles.withColumn("around", around).withColumn("top", F.max("len").over(per))
    limit = (F.col("n") >= MIN_AT_LIMIT) & ((F.col("len") == F.col("top")) | (F.col("n") >= 2 * F.col("around")))
    return seen.where(limit).select("source", F.when(F.col("unit") == 0, "chars").otherwise("bytes").alias("unit"), F.col("len").cast("int").alias("limit"), "n")


def _last_paragraph(text: str) -> str:
    """What follows the last blank line."""
    end = text.rfind("\n")
    while end > 0:
        before = text.rfind("\n", 0, end)
        if before < 0:
            break
        if not text[before + 1 : end].strip(" \t"):
            return text[end + 1 :]
        end = before
    return text


def end_state(text: str, limits: list[int]) -> tuple[str, bool, bool, bool, bool, bool, str | None]:
    """(text without what a cut leaves, sentence, mark, marks count as an end, natural, free of prose, shape) of a text with visible letters.

    ``natural`` leaves out what is learned; ``shape`` is the first line of the last paragraph, if it is short enough to recur.
    """
    t = text.rstrip(LEFT_BY_CUT)
    if t.endswith("...") and len(text) in limits:  # dots that a field of fixed length puts in place of the rest
        t = t.rstrip(".").rstrip()
    para = _last_paragraph(t.replace("\r", "")).lstrip()
    line1, last = para.split("\n", 1)[0].strip(" ").lower(), t.rsplit("\n", 1)[-1].strip(" ")
    sentence = bool(_SENTENCE.search(t[-12:])) and not _ABBREVIATION.search(t[-6:]) and not (_AMOUNT.search(t[-40:]) and any(x - 3 <= len(text) <= x for x in limits))
    visible = text.rstrip(WHITE)
    mark = visible.endswith(("�", "="))
    flat = not _PROSE.search(para)
    lines = para.count("\n") + 1
    natural = (
        sentence
        or (flat and lines <= 8 and ((lines >= 2 and bool(_CLOSING.fullmatch(line1))) or bool(_RULE_OR_NAME.fullmatch(line1))))
        or bool(_NOTE.fullmatch(last))
        or bool(_LINK.fullmatch(last))
        or (flat and bool(_ITEM.match(last)))
    )
    shape = re.sub("[0-9]", "9", line1) if not sentence and 3 <= len(line1) <= 44 else None
    return t, sentence, mark, mark and not _LAID_OUT.search(visible[-80:]), natural, flat, shape


def _fixed(n: int) -> list[int]:
    """The fixed lengths up to ``n``."""
    return [1 << k for k in range(n.bit_length())]


def _key(text: str, length: int) -> int:
    return xxhash.xxh3_64_intdigest(text[:length], length) - (1 << 63)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _hashes(texts: list[str], asking: list[bool]) -> list[pa.Array]:
    """Columns n, digest, own (the key asked under, null if not asking) and keys of texts."""
    keys = [[_key(t, n) for n in _fixed(len(t))] for t in texts]
    own = [k[-1] if a else None for k, a in zip(keys, asking)]
    return [pa.array([len(t) for t in texts], pa.int32()), pa.array([_digest(t) for t in texts], pa.binary()), pa.array(own, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]


_HASHED = "n int, digest binary, own bigint, keys array<bigint>"


def _prefix_digests(hashed: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest): of the asking texts of ``hashed`` (doc_id and the columns of ``_hashes``) those that are strict prefixes of a longer one.

    ``texts`` (doc_id, t) has the same texts, with or without what a cut leaves; of these only the few that share a key
    with a shorter one are read.
    """
    asked = hashed.where("own is not null").select("own", "n", "digest").distinct()
    lengths = asked.groupBy(F.col("own").alias("key")).agg(F.collect_set("n").alias("lengths"), F.min("n").alias("shortest"))
    # copies of one text offer once
    offers = hashed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("doc_id", "n", F.explode("keys").alias("key"))
    wanted = offers.join(lengths, "key").where("n > shortest").groupBy("doc_id").agg(F.first("n").alias("whole"), F.array_distinct(F.flatten(F.collect_list("lengths"))).alias("lengths"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(n, _digest(t[:n])) for t, whole, ns in zip(*(c.to_pylist() for c in batch.columns)) for n in ns if n < whole}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["n", "digest"])

    cut = texts.join(broadcast_if(wanted.persist(), BROADCAST_ROWS), "doc_id").select("t", "whole", "lengths").mapInArrow(again, "n int, digest binary")
    return asked.join(cut, ["n", "digest"], "left_semi").select("digest").distinct()


def strict_prefixes(texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(``text_col``): the distinct texts that are strict prefixes of a longer text of the table; rows without a key are left out."""
    own = texts.where(F.length(text_col) > 0).where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_hashes(t, [True] * len(t))], ["doc_id", "t", "n", "digest", "own", "keys"])

    hashed = own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, t string, {_HASHED}")
    return hashed.join(_prefix_digests(hashed, own), "digest", "left_semi").select(F.col("t").alias(text_col)).distinct()


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cut boolean, by_prefix boolean, reason): one row per document with visible text."""
    kind = dict(docs.dtypes)["doc_id"]
    limits = field_limits(docs).where("unit = 'chars'").groupBy(F.col("source").alias("limit_source")).agg(F.collect_set("limit").alias("limits"))
    read = docs.where("text is not null and doc_id is not null").select("doc_id", "source", "text")
    read = read.join(broadcast_if(limits.persist(), BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("limit_source")), "left").select("doc_id", "source", "text", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, states = [], []
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if text.strip(LEFT_BY_CUT):
                    at.append(i)
                    states.append(end_state(text, own or []))
            taken = batch.take(pa.array(at, pa.int64()))
            flags = [pa.array([s[k] for s in states], pa.bool_()) for k in range(1, 6)]
            hashes = _hashes([s[0] for s in states], [not s[1] for s in states])
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *flags, pa.array([s[6] for s in states], pa.string()), *hashes], names)

    names = ["doc_id", "source", "sentence", "mark", "marks_end", "natural", "flat", "shape", "n", "digest", "own", "keys"]
    base = read.mapInArrow(run, f"doc_id {kind}, source string, sentence boolean, mark boolean, marks_end boolean, natural boolean, flat boolean, shape string, {_HASHED}").persist()
    base.count()  # made once, before the plans over it start side by side

    # counts of short first lines of last paragraphs, over the different texts that don't end in a sentence
    open_ended = base.where("not sentence and not mark").groupBy("digest").agg(F.first("shape").alias("shape"), F.min("source").alias("low"), F.max("source").alias("high"))
    total = open_ended.agg(F.count(F.lit(1)).alias("total"))
    counted = open_ended.where("shape is not null").groupBy("shape").agg(F.count(F.lit(1)).alias("times"), (F.min("low") < F.max("high")).alias("spread"))
    least = F.greatest(F.lit(MIN_RECURRENCE), F.col("total") * MIN_SHARE)
    recurrent = counted.join(F.broadcast(total), F.col("spread")).where(F.col("times") >= least).select("shape", F.lit(True).alias("known"))  # one row of totals

    longer = _prefix_digests(base, read.select("doc_id", F.col("text").alias("t"))).withColumn("by_prefix", F.lit(True))
    both = base.drop("keys").join(broadcast_if(recurrent.persist(), BROADCAST_ROWS), "shape", "left").join(broadcast_if(longer.persist(), BROADCAST_ROWS), "digest", "left")
    natural = F.col("natural") | (F.coalesce("known", F.lit(False)) & F.col("flat"))
    by_prefix = F.coalesce("by_prefix", F.lit(False)) & ~F.col("sentence")
    reason = F.when(by_prefix, "prefix").when(F.col("mark"), "mark").when(~natural, "end")
    return both.select("doc_id", "source", (F.col("marks_end") | ~natural | by_prefix).alias("cut"), by_prefix.alias("by_prefix"), reason.alias("reason"))


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id): the documents whose text was cut."""
    return judged(docs).where("cut").select("doc_id").distinct()


def truncation_by_source(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, share, char_limit, byte_limit): how often each source truncates, and the length at which most of its texts pile up."""
    per = judged(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("cut").cast("bigint")).alias("n_cut"))
    best = lambda unit: F.max_by(F.when(F.col("unit") == unit, F.col("limit")), F.when(F.col("unit") == unit, F.struct("n", "limit")))
    limits = field_limits(docs).groupBy("source").agg(best("chars").alias("char_limit"), best("bytes").alias("byte_limit"))
    joined = per.alias("a").join(limits.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return joined.select("a.source", "n_docs", "n_cut", F.round(F.col("n_cut") / F.col("n_docs"), 6).alias("share"), "char_limit", "byte_limit")
