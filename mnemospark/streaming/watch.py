"""Folder watch and usage stream.

Sinks run in ``foreachBatch`` with keyed, insert-or-ignore writes, so a batch that
is replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark import schemas
from mnemospark.functions import fixed_values as fv
from mnemospark.plans import ingest
from mnemospark.plans.store import Store
from mnemospark.sources import files


def watch_folder(
    spark: SparkSession,
    store: Store,
    folder: str,
    wing: str,
    rooms: list[dict],
    checkpoint: str,
    embed: Callable | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Files new drawers from files that appear or change below a folder.

    A known chunk position is never overwritten.
    """
    schema = "value string"
    source = (
        spark.readStream.format("text")
        .schema(schema)
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    path = files.local_path(F.col("_metadata.file_path"))
    base = folder.rstrip("/") + "/"
    texts = source.select(
        path.alias("path"), F.substring(path, len(base) + 1, 2**31 - 1).alias("relative"),
        F.col("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("changed"),
    )

    def file_batch(batch: DataFrame, _: int) -> None:
        rows = ingest.project_drawers(
            batch.select("path", "relative", "content"), wing, rooms, "watch", F.current_timestamp()
        )
        store.add_drawers(rows, embed)
        store.index_new()

    writer = texts.writeStream.foreachBatch(file_batch).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def usage_events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Usage events from JSON files as they arrive."""
    return spark.readStream.schema(schemas.USAGE_EVENTS).json(folder)


def first_asked(events: DataFrame) -> DataFrame:
    """The first event of each question within 24 hours.

    The state holds one entry per question of the last day and forgets it after
    the watermark, so it is bounded by distinct questions, not by events.
    """
    asked = events.filter(F.col("query_hash").isNotNull())
    return asked.withWatermark("ts", f"{fv.REPEAT_WINDOW_HOURS} hours").dropDuplicatesWithinWatermark(
        ["query_hash"]
    )


def record_usage(
    events: DataFrame, store: Store, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Appends events with their repeat flag set from the day before each of them."""
    from mnemospark.operators import usage

    def append_batch(batch: DataFrame, _: int) -> None:
        known = store.read("usage_events")
        fresh = batch.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])
        bounds = fresh.agg(F.min("ts")).first()[0]
        if bounds is None:
            return
        day = F.make_dt_interval(hours=F.lit(fv.REPEAT_WINDOW_HOURS))
        recent = known.filter(F.col("ts") >= F.lit(bounds) - day)
        store.append("usage_events", usage.mark_repeats(fresh, recent))

    writer = events.writeStream.foreachBatch(append_batch).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
