"""From files and conversations to drawer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t
from mnemospark.functions.columns import trim_ws
from mnemospark.operators import chunking, memories
from mnemospark.sources import chats, files, transcripts


def _drawers(rows: DataFrame, wing: str | None, added_by: str, filed_at: Column, importance) -> DataFrame:
    """Drawer rows from (room, source_file, chunk_index, content[, wing])."""
    if wing is not None:
        rows = rows.withColumn("wing", F.lit(wing))
    return rows.select(
        t.drawer_id("wing", "room", "source_file", "chunk_index").alias("id"),
        "wing", "room", "content", "source_file", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.lit(added_by).alias("added_by"), filed_at.alias("filed_at"),
        F.lit(importance).cast("double").alias("importance"),
    )


def project_drawers(
    found: DataFrame, wing: str, rooms: list[dict], added_by: str, filed_at: Column
) -> DataFrame:
    """Chunks of project files (path, relative, content), routed to rooms."""
    trimmed = files.readable(found).withColumn("content", trim_ws("content")).filter(
        F.octet_length("content") >= fv.MIN_CHUNK_BYTES
    )
    routed = trimmed.select(
        t.detect_file_room("relative", "content", rooms).alias("room"),
        F.col("path").alias("source_file"), "content",
    )
    chunks = chunking.chunk_rows(routed, "content")
    return _drawers(chunks, wing, added_by, filed_at, fv.DEFAULT_IMPORTANCE)


def conversation_drawers(
    found: DataFrame, wing: str, added_by: str, filed_at: Column, general: bool = False
) -> DataFrame:
    """Exchanges of chat exports, or typed memories with ``general``."""
    chosen = files.conversations(found)
    texts = chats.normalized(chosen, "content", files.extension_of(F.col("relative"))).select(
        F.col("path").alias("source_file"), "content"
    ).filter(F.octet_length(trim_ws("content")) >= fv.MIN_CONVO_CHUNK_BYTES)
    if general:
        typed = memories.extract_memories(texts, "content")
        rows = memories.number_memories(typed, "source_file").withColumnRenamed("memory_type", "room")
    else:
        with_room = texts.withColumn("room", t.detect_convo_room("content"))
        rows = chunking.exchange_rows(with_room, "content")
    slug = wing.lower().replace(" ", "_").replace("-", "_")
    return _drawers(rows, slug, added_by, filed_at, fv.DEFAULT_IMPORTANCE)


def message_drawers(found: DataFrame, wing: str | None, filed_at: Column) -> DataFrame:
    rows = transcripts.message_rows(found).select(
        F.lit("messages").alias("room"), F.col("path").alias("source_file"), "chunk_index", "content"
    )
    return _drawers(rows, wing or fv.CONVERSATION_WING, "sweep", filed_at, fv.DEFAULT_IMPORTANCE)


def turn_drawers(conversations: DataFrame, added_by: str, filed_at: Column) -> DataFrame:
    """Exchanges of (conv_id, turn, role, text) and the memories found in them.

    Conversation and turn are part of the source, so a later turn never collides
    with an earlier one.
    """
    source = F.concat_ws("/", F.lit(fv.TURN_SOURCE), "conv_id", "turn")
    pairs = memories.pair_turns(conversations).withColumn("source_file", source)
    whole = pairs.select(
        F.lit(fv.TURN_ROOM).alias("room"), "source_file", F.lit(0).alias("chunk_index"), "content"
    )
    typed = memories.number_memories(
        memories.extract_memories(pairs.select("source_file", "content"), "content"), "source_file"
    ).select(F.col("memory_type").alias("room"), "source_file", "chunk_index", "content")
    wing = fv.CONVERSATION_WING
    return _drawers(whole, wing, added_by, filed_at, fv.DEFAULT_IMPORTANCE).unionByName(
        _drawers(typed, wing, added_by, filed_at, fv.DEFAULT_IMPORTANCE + 1)
    )
