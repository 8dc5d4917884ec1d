"""Stored tables and the write paths.

Tables are versions of Parquet folders (``plans.commits``): rows are appended, updated and deleted by
key without a rewrite, and a job that dies half-way leaves the last version in place.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t
from mnemospark.operators import bm25
from mnemospark.plans.commits import RowTable


# ------------------------------------------------------------------ row logic
def json_fields(metadata: str, dropped: tuple[str, ...]) -> Column:
    """The members of a JSON object but for some keys, as texts ``"key":value`` in their order.

    Values keep their types and nesting; text that is no JSON object has no members.
    """
    values = F.expr(f"CAST(try_parse_json({metadata}) AS MAP<STRING, VARIANT>)")
    keys = F.coalesce(F.map_keys(F.from_json(F.col(metadata), "map<string,string>")), F.array().cast("array<string>"))
    return F.transform(
        F.filter(keys, lambda k: ~k.isin(*dropped)),
        lambda k: F.concat(json_text(k), F.lit(":"), F.coalesce(F.to_json(F.element_at(values, k)), F.lit("null"))),
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(value))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def json_object(fields: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def merged_metadata(metadata: str, content: str) -> Column:
    """Metadata JSON with the preference keys set from, or cleared by, the text."""
    kept = json_fields(metadata, ("preference", "preference_span"))
    span = t.preference_span(content)
    extra = F.array(F.lit('"preference":true'), F.concat(F.lit('"preference_span":'), json_text(span)))
    return json_object(F.when(span.isNull(), kept).otherwise(F.concat(kept, extra)))


def enriched(rows: DataFrame, embed=None) -> DataFrame:
    """Full drawer rows from (id, wing, room, content, source_file, chunk_index,
    added_by, filed_at, importance[, embedding, metadata]).

    ``embed`` maps a text column to a vector column; without it vectors stay as
    given.
    """
    cols = set(rows.columns)
    if "metadata" not in cols:
        rows = rows.withColumn("metadata", F.lit("{}"))
    if "embedding" not in cols:
        rows = rows.withColumn(
            "embedding", embed(F.col("content")) if embed else F.lit(None).cast("array<float>")
        )
    rows = rows.withColumn("_span", t.preference_span("content"))
    pref = F.when(F.col("_span").isNotNull(), F.col("embedding"))
    if embed:
        spanned = rows.withColumn("_sv", embed(F.coalesce("_span", F.lit(""))))
        rows = spanned
        pref = F.when(F.col("_span").isNotNull() & F.col("embedding").isNotNull(), F.col("_sv"))
    full = rows.withColumns(
        {
            "created_at": F.col("filed_at"),
            "entity_metadata": t.entity_metadata("content"),
            "hall": F.coalesce(F.get_json_object("metadata", "$.hall"), t.detect_hall("content")),
            "normalize_version": F.lit(1).cast("long"),
            "metadata": merged_metadata("metadata", "content"),
            "is_preference": F.col("_span").isNotNull(),
            "pref_embedding": pref.cast("array<float>"),
        }
    )
    return conform(full, "drawers")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns, order and types of a stored table; absent columns become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.TABLES[name].fields
        ]
    )


def new_rows(
    existing: DataFrame, incoming: DataFrame, order: list[str], key: str = "id"
) -> DataFrame:
    """Incoming rows with an unknown key, the first per key.

    ``min_by`` keeps one row per key with partial aggregation, so copies of a hot
    key shrink before the shuffle.
    """
    rest = [c for c in incoming.columns if c != key]
    fresh = incoming.join(existing.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(key, "_r.*").select(*incoming.columns)


def pruned(drawers: DataFrame, older_than_days: int, as_of: Column) -> DataFrame:
    """Drawers younger than the limit."""
    if older_than_days <= 0:
        raise ValueError("older_than_days must be a positive integer")
    return drawers.filter(F.col("filed_at") > as_of - F.lit(timedelta(days=older_than_days)))


# --------------------------------------------------------------------- tables
class Store:
    """Tables under one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> RowTable:
        return RowTable(
            self.spark, f"{self.root}/{name}", schemas.TABLES[name], schemas.KEYS.get(name), schemas.PARTITIONED.get(name, [])
        )

    def exists(self, name: str) -> bool:
        return self.table(name).state().version > 0

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def append(self, name: str, df: DataFrame) -> None:
        self.table(name).append(conform(df, name))

    def replace(self, name: str, df: DataFrame) -> None:
        """A new whole table; rows that others add meanwhile stay."""
        self.table(name).replace(conform(df, name))

    def update(self, name: str, rows: DataFrame) -> None:
        """Whole rows in the place of those with their keys."""
        self.table(name).update(conform(rows, name))

    def delete(self, name: str, keys: DataFrame) -> None:
        self.table(name).delete(keys)

    def compact(self, names: tuple[str, ...] = tuple(schemas.TABLES)) -> None:
        for name in names:
            self.table(name).compact()

    # ---------------------------------------------------------------- drawers
    def add_drawers(self, rows: DataFrame, embed=None) -> int:
        """Insert-or-ignore; returns how many rows were new.

        Known and repeated ids are dropped before anything is enriched.
        """
        order = ["filed_at", "content"]
        return self.table("drawers").append_new(
            lambda known: conform(enriched(new_rows(known, rows, order), embed), "drawers")
        )

    def index_new(self) -> None:
        """Postings and lengths of drawers that are not indexed yet."""
        todo = self.read("drawers").join(
            self.read("doc_stats").select(F.col("drawer_id").alias("id")), "id", "left_anti"
        )
        post = bm25.postings(todo).withColumn("term_bucket", bm25.term_bucket(F.col("term")))
        self.append("postings", post)
        # Lengths come last: a drawer without one is indexed again after a failure.
        self.append("doc_stats", bm25.doc_stats(todo))

    def rebuild_index(self) -> None:
        rows = self.read("drawers")
        post = bm25.postings(rows).withColumn("term_bucket", bm25.term_bucket(F.col("term")))
        self.replace("postings", post)
        self.replace("doc_stats", bm25.doc_stats(rows))

    def index(self) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of drawers that still exist."""
        return self.read("postings"), self.read("doc_stats")

    def drop_drawers(self, ids: DataFrame) -> None:
        """Takes out drawers (id).  The index goes first: a drawer without a length is indexed again."""
        if self.exists("doc_stats"):
            keys = ids.select(F.col("id").alias("drawer_id"))
            for name in ("doc_stats", "postings"):
                self.delete(name, keys)
        self.delete("drawers", ids)

    def delete_drawers(self, ids: list[str]) -> int:
        hit = self.read("drawers").filter(F.col("id").isin(ids)).select("id")
        gone = hit.count()
        if gone:
            self.drop_drawers(hit)
        return gone

    def update_content(self, drawer_id: str, content: str, embed=None) -> bool:
        hit = self.read("drawers").filter(F.col("id") == drawer_id)
        if hit.isEmpty():
            return False
        base = hit.select(
            "id", "wing", "room", F.lit(content).alias("content"), "source_file", "chunk_index",
            "added_by", "filed_at", "importance",
            # The hall is routed anew from the new text.
            json_object(json_fields("metadata", ("hall",))).alias("metadata"),
        )
        self.update("drawers", enriched(base, embed))
        if self.exists("doc_stats"):
            one = self.spark.createDataFrame([(drawer_id,)], "drawer_id string")
            for name in ("doc_stats", "postings"):
                self.delete(name, one)
        self.index_new()
        return True

    def embed_missing(self, embed) -> int:
        """Vectors for drawers that lack one, preference vectors included; other drawers are not written."""
        missing = self.read("drawers").filter(F.col("embedding").isNull())
        count = missing.count()
        if count:
            self.update("drawers", enriched(missing.drop("embedding", "pref_embedding"), embed))
        return count

    def embed_all(self, embed, refresh_preferences: bool = False) -> int:
        """New vectors for every drawer after a model change."""
        rows = self.read("drawers")
        fresh = rows.withColumn("embedding", embed(F.col("content")))
        if refresh_preferences:
            span = t.preference_span("content")
            fresh = fresh.withColumn("_v", embed(F.coalesce(span, F.lit("")))).withColumn(
                "pref_embedding", F.when(span.isNotNull(), F.col("_v"))
            )
        self.replace("drawers", fresh)
        return self.read("drawers").count()

    def prune(self, older_than_days: int, as_of: Column) -> int:
        """Takes out drawers beyond the limit; rows without a time go too."""
        rows = self.read("drawers")
        young = pruned(rows, older_than_days, as_of).select("id")
        old = rows.select("id").join(young, "id", "left_anti")
        gone = old.count()
        if gone:
            self.drop_drawers(old)
        return gone
