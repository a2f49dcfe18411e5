"""Streams of postings: first-wins deduplication, keyed change detection with state, and merges batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernwork.functions.jobtext import content_hash
from quernwork.operators.resolve import MATERIAL, merge_links

POSTING = (
    "ingest_seq bigint, batch_id bigint, source string, source_id string, url string, title string, company string, location string, city string, description string, "
    "salary string, job_type string, apply_url string, posted_date date, content_hash string, seen_at timestamp, seen boolean"
)


def posting_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of postings as a stream."""
    return spark.readStream.schema(POSTING).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_sightings(postings: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each (source, source_id) once; later ones within the watermark are dropped, and so is the state behind it."""
    return postings.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["source", "source_id"])


def sightings_by_hour(postings: DataFrame, delay: str = "2 days") -> DataFrame:
    """(hour, source, postings): tumbling windows; rows later than the delay no longer count."""
    w = postings.withWatermark("seen_at", delay).groupBy(F.window("seen_at", "1 hour"), "source").agg(F.count("*").alias("postings"))
    return w.select(F.col("window.start").alias("hour"), "source", "postings")


def change_stream(postings: DataFrame, keep_days: int = 60) -> DataFrame:
    """(source, source_id, ingest_seq, label): new, changed or seen against the last state of each link, in the order of ingest_seq.

    The exact sequential form: A to B to A gives two changes. State per link is one hash; it expires after keep_days without a sighting.
    Null fields count as blank. A replayed posting (seen false) changes the hash but doesn't extend the state's life.
    """
    hashed = postings.select("source", "source_id", "ingest_seq", F.coalesce("seen", F.lit(False)).alias("seen"), content_hash(*MATERIAL).alias("h"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ingest_seq")
        last = state.get[0] if state.exists else None
        labels = []
        for h in rows["h"]:
            labels.append("new" if last is None else "seen" if h == last else "changed")
            last = h
        state.update((last,))
        if bool(rows["seen"].any()) or not state.exists:
            state.setTimeoutDuration(keep_days * 86_400_000)
        yield pd.DataFrame({"source": key[0], "source_id": key[1], "ingest_seq": rows["ingest_seq"].to_numpy(), "label": labels})

    return hashed.groupBy("source", "source_id").applyInPandasWithState(step, "source string, source_id string, ingest_seq bigint, label string", "h string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch of postings into the link table: read() gives the present table, write(table, batch) a new snapshot beside it, so a batch that is run again gives the same snapshot."""
    from quernwork.operators.closure import is_class

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(
            "source", "source_id", "url", F.lit(None).cast("string").alias("raw"), F.coalesce("apply_url", F.lit("")).alias("apply_url"), F.coalesce("seen", F.lit(False)).alias("seen"),
            is_class("source", "full_listing").alias("full_listing"), "seen_at", F.col("ingest_seq").alias("seq"),
        )
        write(merge_links(read(), new), number)

    return step
