"""Agent diaries: drawers of room ``diary`` in one wing per agent.

Rows need ``project_path`` besides the usual drawer columns.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t

OWN_HOURS = 24
ANY_AGENT_HOURS = 24 * 7
ENTRIES = 3


def entries(drawers: DataFrame) -> DataFrame:
    """Diary rows with their metadata keys as columns."""
    def meta(key: str, default: str) -> Column:
        return F.coalesce(F.get_json_object("metadata", f"$.{key}"), F.lit(default)).alias(key)

    return drawers.filter(
        F.col("wing").startswith(fv.DIARY_WING_PREFIX) & (F.col("room") == fv.DIARY_ROOM)
    ).select(
        "id", "wing", "content", "filed_at",
        meta("topic", "general"), meta("session_id", ""), meta("project_path", ""),
        meta("date", ""), meta("agent", ""), meta("tags", "[]"),
    )


def agents(diary: DataFrame) -> DataFrame:
    name = F.substring("wing", len(fv.DIARY_WING_PREFIX) + 1, 2**31 - 1)
    return diary.select("wing").distinct().select(name.alias("agent"))


def latest(diary: DataFrame, n: int) -> DataFrame:
    """The n newest entries of every agent; the limit works before the shuffle."""
    order = Window.partitionBy("wing").orderBy(F.desc("filed_at"), "id")
    return diary.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def recent(
    diary: DataFrame,
    as_of: Column,
    hours: int,
    n: int,
    agent: str | None = None,
    project: str | None = None,
) -> DataFrame:
    rows = diary.filter(F.col("filed_at") >= as_of - F.lit(timedelta(hours=hours)))
    if agent is not None:
        rows = rows.filter(F.col("wing") == t.diary_wing(F.lit(agent)))
    if project is not None:
        rows = rows.filter(F.col("project_path") == project)
    return rows.orderBy(F.desc("filed_at"), "id").limit(n)


def session_context(
    diary: DataFrame, agent: str, as_of: Column, project: str | None = None
) -> DataFrame:
    """Own entries of the last day, else anyone's of the last week."""
    own = recent(diary, as_of, OWN_HOURS, ENTRIES, agent, project)
    anyone = recent(diary, as_of, ANY_AGENT_HOURS, ENTRIES, None, project)
    none_of_mine = own.agg(F.count(F.lit(1))).scalar() == 0
    return own.withColumn("cross_agent", F.lit(False)).unionByName(
        anyone.filter(none_of_mine).withColumn("cross_agent", F.lit(True))
    )


def last_session(diary: DataFrame, as_of: Column) -> DataFrame:
    """The three newest entries of any agent within a day."""
    return recent(diary, as_of, OWN_HOURS, ENTRIES)


def entry_rows(requests: DataFrame) -> DataFrame:
    """Drawer rows from diary entries (agent, content, topic, session_id,
    project_path, tags, filed_at)."""
    wing = t.diary_wing("agent")
    meta = F.to_json(
        F.struct(
            F.lit("hall_diary").alias("hall"), "topic", F.lit("diary_entry").alias("type"), "agent",
            F.date_format("filed_at", "yyyy-MM-dd").alias("date"), "session_id", "project_path",
            "tags",
        )
    )
    return requests.select(
        t.diary_id(wing, "filed_at", "content").alias("id"), wing.alias("wing"),
        F.lit(fv.DIARY_ROOM).alias("room"), "content", F.lit("").alias("source_file"),
        F.lit(0).cast("long").alias("chunk_index"), F.col("agent").alias("added_by"), "filed_at",
        F.lit(fv.DEFAULT_IMPORTANCE).alias("importance"), meta.alias("metadata"),
    )
