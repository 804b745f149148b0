"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm import chunking, leakage, namelinks, nearcopies, newtext, pii, tokenizer, truncation
from mailquarry.runtime import read_table

#: Folder with the vocabulary files of public tokenizers.
TOKENIZERS = os.environ.get("MAILQUARRY_TOKENIZERS", "/opt/tokenizers")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized(_bodies(spark, d), read_table(spark, d, "chunk_spec"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_items(_bodies(spark, d), read_table(spark, d, "chunk_spec"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "emails").select("id", F.col("body").alias("text"))


def _name_model(spark: SparkSession, d: str) -> DataFrame:
    return pii.name_model(pii.typed_names(read_table(spark, d, "emails"), read_table(spark, d, "mailboxes"), read_table(spark, d, "name_mentions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(read_table(spark, d, "emails"), _name_model(spark, d)).where(F.col("pii_type").isin(*pii.TYPES))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(read_table(spark, d, "emails"), _name_model(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    mails = read_table(spark, d, "emails").select(
        "id", "from_name", "from_addr", "subject", "body", "quoted_text", "date_text", F.col("mailbox").alias("source"), F.col("thread_id").alias("thread")
    )
    sites = read_table(spark, d, "mailboxes").select(F.col("mailbox").alias("source"), F.col("site_zone").alias("zone"), "date_order")
    return newtext.new_lines(mails, sites)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    return read_table(spark, d, "emails").select("id", F.col("thread_id").alias("thread"), text.alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_copies(_messages(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.copy_classes(_messages(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return namelinks.linked_pairs(read_table(spark, d, "name_mentions"))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return namelinks.link(read_table(spark, d, "name_mentions"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(read_table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", tokenizer.BYTE_LEVEL_PATTERN)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read_table(spark, d, "documents"))


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(read_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_masked, p4_found, p5_found, p5_classes, p6_found, p6_entities, p7_ids, p8_found, p8_report, p8_near, p9_found, p9_sources)
}

_GRAMS = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
ig AS (SELECT item_id, array_to_string(w[k:k+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
dg AS (SELECT doc_id, array_to_string(w[k:k+9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

SQL: dict[str, str] = {
    "p2_found": "SELECT DISTINCT spec_id, id FROM emails JOIN chunk_spec ON length(body) > max_chars WHERE id IS NOT NULL",
    "p5_found": r"""
WITH t AS (SELECT DISTINCT id, thread_id, regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}]+') AS w FROM emails WHERE id IS NOT NULL),
g AS (SELECT DISTINCT id, thread_id, array_to_string(w[k:k+2], ' ') AS s FROM (SELECT id, thread_id, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 30)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id
      WHERE a.thread_id IS NULL OR b.thread_id IS NULL OR a.thread_id <> b.thread_id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9
""",
    "p8_found": _GRAMS + "SELECT doc_id, item_id FROM leaks",
}
