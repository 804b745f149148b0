"""Structured Streaming forms of the ingest and tag operators."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from mailquarry.operators.facets import MAX_TAGS, normal_tags


def mail_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Message files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Redeliveries within the watermark dropped; state is bounded by it."""
    return stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["id"])


def monthly_counts(stream: DataFrame) -> DataFrame:
    """(month, mailbox, n): messages per mailbox and calendar month, UTC, for update or complete output.

    State is one row per month and mailbox, so late messages of any age are counted.
    """
    return stream.where("ingested_at is not null").groupBy(F.date_format("ingested_at", "yyyy-MM").alias("month"), "mailbox").agg(F.count(F.lit(1)).alias("n"))


def tag_states(stream: DataFrame) -> DataFrame:
    """(email_id, tags, tagged_by): the tags of a message after each batch of its events, kept as keyed state.

    The state holds the events since the last replacement by their number, so a repeated event counts once, a late one
    takes its place in the order, and the tags are those of the batch fold. A message without tags has an empty text.
    """

    def fold(events: dict[int, list]) -> tuple[list[str], str | None]:
        tags: list[str] = []
        by = None
        for seq in sorted(events):
            op, add, drop, who = events[seq]
            wanted = sorted(set(add)) if op == "replace" else sorted({*tags, *add} - set(drop))
            if len(wanted) <= MAX_TAGS:
                tags, by = wanted, who
        return tags, by

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        events = {int(s): e for s, e in json.loads(state.get[0]).items()} if state.exists else {}
        for frame in frames:
            for row in frame.itertuples():
                events.setdefault(int(row.seq), [row.op, list(row.add), list(row.drop), row.tagged_by if isinstance(row.tagged_by, str) else None])
        last = max((s for s, e in events.items() if e[0] == "replace" and len(set(e[1])) <= MAX_TAGS), default=None)
        events = {s: e for s, e in events.items() if last is None or s >= last}
        state.update((json.dumps(events),))
        tags, by = fold(events)
        yield pd.DataFrame({"email_id": [key[0]], "tags": pd.Series([",".join(tags)], dtype=object), "tagged_by": pd.Series([by], dtype=object)})

    clean = stream.where("email_id is not null and seq is not null").select("email_id", "seq", "op", normal_tags(F.col("add_tags")).alias("add"), normal_tags(F.col("remove_tags")).alias("drop"), "tagged_by")
    return clean.groupBy("email_id").applyInPandasWithState(step, "email_id string, tags string, tagged_by string", "events string", "update", GroupStateTimeout.NoTimeout)
