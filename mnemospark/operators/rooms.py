"""Room graph: rooms are nodes, and a room seen in several wings is a tunnel.

The base table holds one row per (room, wing); nothing lists the wing pairs of a
room, whose number is quadratic.  Pair counts come from k(k-1)/2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t
from mnemospark.session import set_checkpoints


def _usable(drawers: DataFrame) -> DataFrame:
    return drawers.filter(
        (F.col("room") != fv.DEFAULT_ROOM) & (F.col("room") != "") & (F.col("wing") != "")
    )


def room_wings(drawers: DataFrame) -> DataFrame:
    return _usable(drawers).groupBy("room", "wing").agg(F.count(F.lit(1)).alias("drawers"))


def room_dates(drawers: DataFrame) -> DataFrame:
    """The five earliest filing days of each room, and which of them is last."""
    days = _usable(drawers).select("room", "day").distinct()
    order = Window.partitionBy("room").orderBy("day")
    first = days.withColumn("at", F.row_number().over(order)).filter(
        F.col("at") <= fv.NODE_DATE_LIMIT
    )
    return first.groupBy("room").agg(
        F.array_join(F.array_sort(F.collect_list("day")), ",").alias("dates"),
        F.max("day").alias("recent"),
    )


def room_nodes(drawers: DataFrame) -> DataFrame:
    """One row per room: number of wings, drawers, first dates and newest date."""
    counts = room_wings(drawers).groupBy("room").agg(
        F.count(F.lit(1)).alias("wings"), F.sum("drawers").alias("drawers")
    )
    newest = _usable(drawers).groupBy("room").agg(F.max("day").alias("max_date"))
    return counts.join(room_dates(drawers), "room").join(newest, "room")


def edge_counts(drawers: DataFrame) -> DataFrame:
    """Wing pairs per room, counted instead of listed."""
    pairs = F.floor(F.col("wings") * (F.col("wings") - 1) / 2)
    nodes = room_wings(drawers).groupBy("room").agg(
        F.count(F.lit(1)).alias("wings"), F.sum("drawers").alias("drawers")
    )
    return nodes.filter(F.col("wings") >= 2).withColumn("edges", pairs.cast("long"))


def edges_of_wing(drawers: DataFrame, wing: str) -> DataFrame:
    """Rooms that join one wing to each other wing; linear in the result."""
    rw = room_wings(drawers)
    mine = rw.filter(F.col("wing") == wing).select("room")
    other = rw.filter(F.col("wing") != wing).join(mine, "room", "left_semi")
    return other.select(
        "room",
        F.least(F.lit(wing), F.col("wing")).alias("wing_a"),
        F.greatest(F.lit(wing), F.col("wing")).alias("wing_b"),
    )


def find_tunnels(
    drawers: DataFrame, wing_a: str | None = None, wing_b: str | None = None,
    limit: int | None = fv.GRAPH_RESULT_LIMIT,
) -> DataFrame:
    """The ``limit`` fullest rooms (None: all) that join at least two wings, one row per wing of each."""
    rw = room_wings(drawers)
    totals = rw.groupBy("room").agg(
        F.count(F.lit(1)).alias("wings"),
        F.sum("drawers").alias("drawers"),
        *[
            F.bool_or(F.col("wing") == w).alias(f"_has{i}")
            for i, w in enumerate([wing_a, wing_b])
            if w is not None
        ],
    )
    keep = F.col("wings") >= 2
    for i, w in enumerate([wing_a, wing_b]):
        if w is not None:
            keep = keep & F.col(f"_has{i}")
    top = totals.filter(keep).select("room", "wings", "drawers")
    if limit is not None:
        top = top.orderBy(F.desc("drawers"), "room").limit(limit)
    dated = room_dates(drawers.join(top.select("room"), "room", "left_semi"))
    return (
        rw.select("room", "wing")
        .join(top, "room")
        .join(dated.select("room", "recent"), "room")
    )


def graph_stats(drawers: DataFrame) -> DataFrame:
    nodes = room_wings(drawers).groupBy("room").agg(F.count(F.lit(1)).alias("k"))
    return nodes.agg(
        F.count(F.lit(1)).alias("total_rooms"),
        F.count_if(F.col("k") >= 2).alias("tunnel_rooms"),
        F.coalesce(F.sum(F.floor(F.col("k") * (F.col("k") - 1) / 2)), F.lit(0))
        .cast("long")
        .alias("total_edges"),
    )


def rooms_per_wing(drawers: DataFrame) -> DataFrame:
    return room_wings(drawers).groupBy("wing").agg(F.count(F.lit(1)).alias("rooms"))


def top_tunnels(drawers: DataFrame) -> DataFrame:
    return (
        edge_counts(drawers)
        .orderBy(F.desc("wings"), F.desc("drawers"), "room")
        .limit(fv.GRAPH_TOP_TUNNELS)
        .select("room", "wings", "drawers")
    )


def traverse(
    drawers: DataFrame, start: str, max_hops: int = 2, limit: int | None = fv.GRAPH_RESULT_LIMIT
) -> DataFrame:
    """Breadth-first walk over rooms that share a wing.

    A hop goes frontier -> wings -> rooms.  Each wing first keeps only its
    smallest frontier room, so a wing with many rooms meets one row and no room
    pairs appear.  The smallest frontier room sharing a wing is the discoverer.
    The room graph and each frontier are written once, so a hop reads them and plans nothing
    of the hops before; the walk ends with the first empty frontier.  ``limit`` rooms are
    returned, all of them if it is None.
    """
    set_checkpoints(drawers.sparkSession)
    rw = room_wings(drawers).checkpoint()
    edges = rw.select("room", "wing")
    seen = edges.filter(F.col("room") == start).select("room").distinct().select(
        "room", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via_room")
    )
    frontier = seen
    for hop in range(1, max_hops + 1):
        reach = edges.join(frontier.select("room"), "room").groupBy("wing").agg(
            F.min("room").alias("via_room")
        )
        found = (
            edges.join(reach, "wing")
            .groupBy("room")
            .agg(F.min("via_room").alias("via_room"))
            .join(seen.select("room"), "room", "left_anti")
        )
        frontier = found.select("room", F.lit(hop).alias("hop"), "via_room").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    totals = rw.groupBy("room").agg(F.sum("drawers").alias("drawers"))
    walked = totals.join(seen, "room").orderBy("hop", F.desc("drawers"), "room")
    return walked if limit is None else walked.limit(limit)


def connecting_wings(drawers: DataFrame, walk: DataFrame) -> DataFrame:
    """Wings a walked room shares with its discoverer, one row per wing."""
    edges = room_wings(drawers).select("room", "wing")
    steps = walk.filter(F.col("hop") > 0).select("room", "via_room")
    mine = edges.join(steps, "room").select("room", "via_room", "wing")
    theirs = edges.select(F.col("room").alias("via_room"), "wing")
    return mine.join(theirs, ["via_room", "wing"]).select("room", "via_room", "wing")


def suggest_rooms(drawers: DataFrame, query: str) -> DataFrame:
    """Up to five room names that resemble a name that was not found."""
    low = query.lower()
    room = F.col("room")
    score = F.when(room.contains(low), 2)
    for part in low.split("-"):
        score = score.when(room.contains(part), 1)
    rooms = _usable(drawers).select("room").distinct()
    scored = rooms.withColumn("score", score.otherwise(0)).filter(
        (F.col("score") > 0) & F.lit(low != "")
    )
    return scored.orderBy(F.desc("score"), "room").limit(fv.SUGGESTION_LIMIT)


# ----------------------------------------------------------- stored tunnels
def tunnel_rows(requests: DataFrame) -> DataFrame:
    """Tunnels from (wing_a, room_a, wing_b, room_b, kind), with ids, one per id."""
    kind = F.coalesce(F.nullif(F.btrim("kind"), F.lit("")), F.lit("explicit"))
    rows = requests.select(
        t.wing_name("wing_a").alias("wing_a"), "room_a",
        t.wing_name("wing_b").alias("wing_b"), "room_b", kind.alias("kind"),
    )
    ided = rows.withColumn("id", t.tunnel_id("wing_a", "room_a", "wing_b", "room_b", "kind"))
    return ided.dropDuplicates(["id"])


def list_tunnels(tunnels: DataFrame, wing: str | None = None, kind: str | None = None) -> DataFrame:
    rows = tunnels
    if wing is not None:
        w = t.wing_name(F.lit(wing))
        rows = rows.filter((F.col("wing_a") == w) | (F.col("wing_b") == w))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return rows.orderBy(F.desc("created_at"), "id")


def follow_tunnels(tunnels: DataFrame, wing: str, room: str) -> DataFrame:
    w = t.wing_name(F.lit(wing))
    here = ((F.col("wing_a") == w) & (F.col("room_a") == room)) | (
        (F.col("wing_b") == w) & (F.col("room_b") == room)
    )
    return tunnels.filter(here).orderBy(F.desc("created_at"), "id")
