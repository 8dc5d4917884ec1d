"""Counts, listings, neighbouring chunks and the wings registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t
from mnemospark.operators.bm25 import narrow


# ------------------------------------------------------------------- counts
def count_drawers(drawers: DataFrame) -> DataFrame:
    return drawers.agg(F.count(F.lit(1)).alias("drawers"))


def wing_counts(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing").agg(F.count(F.lit(1)).alias("drawers"))


def room_counts(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    return narrow(drawers, wing, None).groupBy("room").agg(F.count(F.lit(1)).alias("drawers"))


def taxonomy(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing", "room").agg(F.count(F.lit(1)).alias("drawers"))


def taxonomy_rollup(drawers: DataFrame) -> DataFrame:
    """Total, per-wing and per-(wing, room) counts in one pass.

    Rolled up from the taxonomy, so the rows are expanded after, not before,
    the aggregation.
    """
    return taxonomy(drawers).rollup("wing", "room").agg(F.sum("drawers").alias("drawers"))


def average_drawer_tokens(drawers: DataFrame) -> DataFrame:
    chars = F.round(F.coalesce(F.avg(F.char_length("content")), F.lit(0.0)))
    return drawers.agg(F.floor(chars / 4).cast("long").alias("avg_tokens"))


# ----------------------------------------------------------------- listings
LISTED = [
    "id", "wing", "room", "content", "source_file", "chunk_index", "filed_at", "importance",
]


def list_recent(
    drawers: DataFrame, n: int, wing: str | None = None, room: str | None = None
) -> DataFrame:
    rows = narrow(drawers, wing, room).select(*LISTED)
    return rows.orderBy(F.desc("filed_at"), "id").limit(n)


def list_by_importance(drawers: DataFrame, n: int) -> DataFrame:
    rows = drawers.select(*LISTED)
    return rows.orderBy(F.desc("importance"), F.desc("filed_at"), "id").limit(n)


def get_drawer(drawers: DataFrame, drawer_id: str) -> DataFrame:
    return drawers.filter(F.col("id") == drawer_id)


def source_context(
    drawers: DataFrame, source_file: str, center: int, radius: int
) -> DataFrame:
    near = F.col("chunk_index").between(center - radius, center + radius)
    return drawers.filter((F.col("source_file") == source_file) & near).orderBy("chunk_index")


def not_yet_mined(files: DataFrame, drawers: DataFrame) -> DataFrame:
    """Files with no stored chunk.  Known files are reduced to one row each first."""
    known = drawers.select("source_file").distinct()
    return files.join(known, "source_file", "left_anti")


def story_rows(drawers: DataFrame, wing: str | None = None, pool: int | None = None) -> DataFrame:
    """Lines of the wake-up story: rank, room, text, cut at the byte budget.

    The best drawers of the wing are told; with ``pool`` only those among so many of all wings.
    At most 15 rows reach the unpartitioned window.
    """
    chosen = narrow(drawers if pool is None else list_by_importance(drawers, pool), wing, None)
    picked = chosen.orderBy(F.desc("importance"), F.desc("filed_at"), "id").limit(fv.STORY_LIMIT)
    by_rank = Window.orderBy(F.desc("importance"), F.desc("filed_at"), "id")
    by_room = Window.orderBy("room", "rank")
    source = t.base_name("source_file")
    entry = F.concat(
        F.lit("  - "),
        t.snippet("content", fv.STORY_SNIPPET),
        F.when(source != "", F.concat(F.lit("  ("), source, F.lit(")"))).otherwise(""),
    )
    header = len("## L1 — ESSENTIAL STORY".encode())
    opens_room = F.col("room") != F.coalesce(F.lag("room").over(by_room), F.lit(""))
    room_bytes = F.when(
        opens_room | (F.row_number().over(by_room) == 1), F.octet_length("room") + 3
    ).otherwise(0)
    sized = (
        picked.withColumn("rank", F.row_number().over(by_rank))
        .withColumn("line", entry)
        .withColumn("_bytes", F.octet_length("line") + room_bytes)
        .withColumn("_total", F.lit(header) + F.sum("_bytes").over(by_room))
    )
    return sized.select(
        "rank", "room", "id", "line", (F.col("_total") <= fv.STORY_MAX_BYTES).alias("fits")
    )


# ----------------------------------------------------------------- registry
def registry(wings: DataFrame, drawers: DataFrame) -> DataFrame:
    """Registered wings with their drawer counts, most populated first."""
    counted = wings.join(
        wing_counts(drawers).withColumnRenamed("drawers", "drawer_count"),
        wings["name"] == F.col("wing"),
        "left",
    ).drop("wing")
    return counted.withColumn(
        "drawer_count", F.coalesce("drawer_count", F.lit(0).cast("long"))
    ).orderBy(F.desc("drawer_count"), "name")


def inferred_kind(wing: Column) -> Column:
    topic = wing.startswith(fv.DIARY_WING_PREFIX) | wing.isin(fv.TOPIC_ONLY_WINGS)
    return F.when(topic, "topic").otherwise("project")


def backfill_wings(wings: DataFrame, drawers: DataFrame) -> DataFrame:
    """Registry rows missing for wings that already hold drawers."""
    present = drawers.select(F.col("wing").alias("name")).distinct()
    missing = present.join(wings.select("name"), "name", "left_anti")
    return missing.select("name", inferred_kind(F.col("name")).alias("kind"))


def upsert_wings(wings: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full registry after the upsert: filled values win, a project stays one."""
    old, new = wings.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col("o.name") == F.col("n.name"), "full_outer")
    kinds = [F.col("o.kind"), F.col("n.kind")]
    is_project = F.coalesce(kinds[0] == "project", F.lit(False)) | F.coalesce(
        kinds[1] == "project", F.lit(False)
    )
    return joined.select(
        F.coalesce("n.name", "o.name").alias("name"),
        F.when(is_project, "project").otherwise(F.coalesce(kinds[1], kinds[0])).alias("kind"),
        F.coalesce(
            F.nullif(F.col("n.description"), F.lit("")), F.col("o.description"), F.lit("")
        ).alias("description"),
        F.coalesce(F.nullif(F.col("n.project_path"), F.lit("")), F.col("o.project_path")).alias(
            "project_path"
        ),
        F.coalesce(F.col("n.last_mined_at"), F.col("o.last_mined_at")).alias("last_mined_at"),
        F.coalesce(F.col("o.created_at"), F.col("n.created_at")).alias("created_at"),
    )


def wing_state(counted: DataFrame) -> DataFrame:
    """Mined or merely registered, for each registry row."""
    mined = F.col("last_mined_at").isNotNull() | (F.col("drawer_count") > 0)
    return counted.withColumn(
        "state", F.when(mined, "mined").otherwise("registered_not_mined")
    )


# ------------------------------------------------------------ file rooms
def rooms_from_file_names(paths: DataFrame, profile: str = "coding") -> DataFrame:
    """Rooms whose keywords occur most in file names.

    Each keyword counts once per file, so a file may count twice for a room.
    """
    name = F.translate(F.lower(t.base_name("path")), "- ", "__")
    pairs = [
        F.when(name.contains(word), F.lit(room))
        for room, words in fv.FOLDER_ROOMS[profile].items()
        for word in words
    ]
    hits = paths.select(F.explode(F.filter(F.array(*pairs), F.isnotnull)).alias("room"))
    counted = hits.groupBy("room").agg(F.count(F.lit(1)).alias("files"))
    return (
        counted.filter(F.col("files") >= fv.FILE_ROOM_MIN_COUNT)
        .orderBy(F.desc("files"), "room")
        .limit(fv.FILE_ROOM_LIMIT)
    )


def name_candidates(texts: DataFrame) -> DataFrame:
    """Capitalised words seen at least twice, as people or projects."""
    words = texts.select(F.explode(t.capitalised_words("content")).alias("name"))
    counted = words.groupBy("name").agg(F.count(F.lit(1)).alias("seen"))
    person = (F.octet_length("name") <= 12) & ~F.col("name").contains("-")
    return counted.filter(F.col("seen") >= 2).withColumn(
        "kind", F.when(person, "person").otherwise("project")
    )
