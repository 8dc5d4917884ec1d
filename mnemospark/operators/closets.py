"""Closets: topic pointers to drawers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as t
from mnemospark.operators.bm25 import narrow


def closet_rows(requests: DataFrame) -> DataFrame:
    """Closets from (wing, room, topic, pointer_drawer_ids), with ids."""
    return requests.withColumn("id", t.closet_id("wing", "room", "topic"))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All closets; a known id takes the new pointers."""
    kept = existing.join(incoming.select("id"), "id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def list_closets(
    closets: DataFrame, wing: str | None = None, room: str | None = None
) -> DataFrame:
    order = [c for c, v in (("wing", wing), ("room", room)) if v is None]
    return narrow(closets, wing, room).orderBy(*order, "topic")


def resolve(closets: DataFrame, drawers: DataFrame) -> DataFrame:
    """One row per (closet, drawer) pointer that still leads somewhere."""
    pointers = closets.select("topic", F.posexplode("pointer_drawer_ids").alias("pos", "id"))
    return pointers.join(drawers.select("id", "wing", "room", "content"), "id")
