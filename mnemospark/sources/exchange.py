"""Export, import and migration of drawers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as t

EXPORTED = [
    "id", "wing", "room", "content", "source_file", "chunk_index", "added_by", "filed_at",
    "created_at", "importance", "metadata",
]


def export_rows(drawers: DataFrame) -> DataFrame:
    """Portable rows: no vectors, they are made anew on import."""
    if "created_at" not in drawers.columns:
        drawers = drawers.withColumn("created_at", F.col("filed_at"))
    if "metadata" not in drawers.columns:
        drawers = drawers.withColumn("metadata", F.lit("{}"))
    return drawers.select(*EXPORTED)


def write_export(drawers: DataFrame, path: str) -> None:
    """JSON lines in parallel files, each file newest first."""
    export_rows(drawers).sortWithinPartitions(F.desc("filed_at"), "id").write.mode(
        "errorifexists"
    ).json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "id string, wing string, room string, content string, source_file string, "
        "chunk_index long, added_by string, filed_at timestamp, created_at timestamp, "
        "importance double, metadata string"
    )
    return spark.read.schema(schema).json(path)


def import_rows(exported: DataFrame, filed_at: Column) -> DataFrame:
    """Drawer rows to add, under their exported ids and with their metadata.

    Only a row without an id gets one from its place and position.
    """
    metadata = F.col("metadata") if "metadata" in exported.columns else F.lit(None).cast("string")
    return exported.select(
        F.coalesce("id", t.drawer_id("wing", "room", "source_file", "chunk_index")).alias("id"),
        "wing", "room", "content", "source_file", "chunk_index", "added_by",
        filed_at.alias("filed_at"), "importance", F.coalesce(metadata, F.lit("{}")).alias("metadata"),
    )


def read_legacy(spark: SparkSession, url: str, table: str = "drawers", **options) -> DataFrame:
    """Eight columns of an older database, over JDBC, to be imported without vectors.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    to read a large table in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    rows = reader.options(**options).load()
    return rows.select(
        "id", "wing", "room", "content", "source_file", F.col("chunk_index").cast("long"),
        "added_by", F.col("importance").cast("double"),
    )
