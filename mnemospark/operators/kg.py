"""Temporal knowledge graph over ``entities`` (id, name, ...) and ``triples``.

Validity dates are text and compare as text; both ends of an interval count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t

FACT = ["direction", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "current"]


def valid_on(as_of: str | None) -> Column:
    if as_of is None:
        return F.lit(True)
    started = F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)
    running = F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)
    return started & running


def _named(triples: DataFrame, entities: DataFrame, side: str, alias: str) -> DataFrame:
    names = entities.select(F.col("id").alias(side), F.col("name").alias(alias))
    return triples.join(names, side)


def _id(name: str) -> str:
    return name.lower().replace(" ", "_").replace("'", "")


def query_entity(
    triples: DataFrame,
    entities: DataFrame,
    name: str,
    as_of: str | None = None,
    direction: str = "both",
) -> DataFrame:
    """Facts around one entity.  A self-loop shows up once per direction."""
    valid = triples.filter(valid_on(as_of))
    parts = []
    if direction in ("outgoing", "both"):
        out = _named(valid.filter(F.col("subject") == _id(name)), entities, "object", "_other")
        parts.append(_facts(out, "outgoing", F.lit(name), F.col("_other")))
    if direction in ("incoming", "both"):
        inc = _named(valid.filter(F.col("object") == _id(name)), entities, "subject", "_other")
        parts.append(_facts(inc, "incoming", F.col("_other"), F.lit(name)))
    if not parts:
        return _facts(triples.limit(0), "outgoing", F.lit(name), F.lit(name))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _facts(rows: DataFrame, direction: str, subject: Column, object_: Column) -> DataFrame:
    return rows.select(
        F.lit(direction).alias("direction"), subject.alias("subject"), "predicate",
        object_.alias("object"), "valid_from", "valid_to", "confidence",
        F.col("valid_to").isNull().alias("current"),
    )


def _both_names(triples: DataFrame, entities: DataFrame) -> DataFrame:
    return _named(_named(triples, entities, "subject", "_s"), entities, "object", "_o")


def query_relationship(
    triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None
) -> DataFrame:
    pred = predicate.lower().replace(" ", "_")
    rows = triples.filter((F.col("predicate") == pred) & valid_on(as_of))
    return _facts(_both_names(rows, entities), "outgoing", F.col("_s"), F.col("_o"))


def timeline(
    triples: DataFrame, entities: DataFrame, name: str | None = None, limit: int | None = fv.TIMELINE_LIMIT
) -> DataFrame:
    """The ``limit`` earliest facts (None: all), undated ones last.

    Names are joined after the limit: every triple has both entities.
    """
    rows = triples
    if name is not None:
        rows = rows.filter((F.col("subject") == _id(name)) | (F.col("object") == _id(name)))
    tie = ["subject", "predicate", "object", "valid_to"]
    first = rows.orderBy(F.asc_nulls_last("valid_from"), *tie)
    first = first if limit is None else first.limit(limit)
    return _facts(_both_names(first, entities), "outgoing", F.col("_s"), F.col("_o"))


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row.  Predicates are counted first; their set is small."""
    per_predicate = triples.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_to").isNull()).alias("cur")
    )
    facts = per_predicate.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("triples"),
        F.coalesce(F.sum("cur"), F.lit(0)).alias("current_facts"),
        F.array_sort(F.collect_list("predicate")).alias("relationship_types"),
    )
    return facts.select(
        entities.agg(F.count(F.lit(1))).scalar().alias("entities"),
        "triples", "current_facts",
        (F.col("triples") - F.col("current_facts")).alias("expired_facts"),
        F.array_join("relationship_types", ",").alias("relationship_types"),
    )


def conflict_groups(
    triples: DataFrame,
    entities: DataFrame,
    name: str | None = None,
    current_only: bool = False,
) -> DataFrame:
    """(subject, predicate) with more than one object, ended versions included.

    Smallest and largest object are enough to see a conflict, so a group is never
    collected and partial aggregation shrinks a hot one before the shuffle.
    """
    rows = triples
    if current_only:
        rows = rows.filter(F.col("valid_to").isNull())
    if name is not None:
        rows = rows.filter((F.col("subject") == _id(name)) | (F.col("object") == _id(name)))
    named = _both_names(rows, entities)
    grouped = named.groupBy(F.col("_s").alias("subject"), "predicate").agg(
        F.count(F.lit(1)).alias("facts"),
        F.min("_o").alias("first_object"),
        F.max("_o").alias("last_object"),
    )
    return grouped.filter(F.col("first_object") != F.col("last_object"))


def conflict_facts(
    triples: DataFrame,
    entities: DataFrame,
    name: str | None = None,
    current_only: bool = False,
) -> DataFrame:
    """The facts of every conflicting group, one row per fact."""
    groups = conflict_groups(triples, entities, name, current_only)
    rows = triples.filter(F.col("valid_to").isNull()) if current_only else triples
    if name is not None:
        rows = rows.filter((F.col("subject") == _id(name)) | (F.col("object") == _id(name)))
    facts = _facts(_both_names(rows, entities), "outgoing", F.col("_s"), F.col("_o"))
    return facts.drop("direction", "confidence").join(
        groups.select("subject", "predicate"), ["subject", "predicate"], "left_semi"
    )


# ------------------------------------------------------------------- writes
def with_ids(facts: DataFrame, stamp: Column) -> DataFrame:
    """Triples from named facts (subject, predicate, object, valid_from, ...)."""
    ids = facts.withColumns(
        {
            "subject": t.entity_id("subject"),
            "predicate": t.predicate_id("predicate"),
            "object": t.entity_id("object"),
        }
    )
    return ids.withColumn("id", t.triple_id("subject", "predicate", "object", stamp))


def entities_of(facts: DataFrame) -> DataFrame:
    """Entities named by facts, one row per id; the smallest spelling is kept."""
    names = facts.select(F.explode(F.array("subject", "object")).alias("name"))
    return names.groupBy(t.entity_id("name").alias("id")).agg(F.min("name").alias("name"))


def new_triples(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming triples (with ids) that no active identical triple covers.

    Within the batch an ended fact always enters; of several open copies only
    the smallest by start date does.
    """
    key = ["subject", "predicate", "object"]
    active = existing.filter(F.col("valid_to").isNull()).select(*key).distinct()
    fresh = incoming.join(active, key, "left_anti")
    columns = [c for c in fresh.columns if c not in key]
    open_ = fresh.filter(F.col("valid_to").isNull())
    first = open_.groupBy(*key).agg(
        F.min_by(F.struct(*columns), F.struct(F.coalesce("valid_from", F.lit("")), "id")).alias("f")
    )
    return (
        first.select(*key, "f.*")
        .select(*fresh.columns)
        .unionByName(fresh.filter(F.col("valid_to").isNotNull()))
    )


def _active(subject: str, predicate: str, object_: str) -> Column:
    return (
        (F.col("subject") == _id(subject))
        & (F.col("predicate") == predicate.lower().replace(" ", "_"))
        & (F.col("object") == _id(object_))
        & F.col("valid_to").isNull()
    )


def ended_rows(triples: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    """The active copies of one fact, ended: the only rows that ending it changes."""
    return triples.filter(_active(subject, predicate, object_)).withColumn("valid_to", F.lit(ended))


def invalidate(
    triples: DataFrame, subject: str, predicate: str, object_: str, ended: str
) -> DataFrame:
    """All triples, with the active copies of one fact ended."""
    hit = _active(subject, predicate, object_)
    return triples.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def invalidate_many(triples: DataFrame, endings: DataFrame) -> DataFrame:
    """The same for a table (subject, predicate, object, ended) of entity ids."""
    key = ["subject", "predicate", "object"]
    ends = endings.groupBy(*key).agg(F.min("ended").alias("_ended"))
    joined = triples.join(ends, key, "left")
    ended = F.when(F.col("valid_to").isNull(), F.col("_ended")).otherwise(F.col("valid_to"))
    return joined.withColumn("valid_to", ended).select(*triples.columns)


def upsert_entities(existing: DataFrame, incoming: DataFrame, replace: bool) -> DataFrame:
    """All entities; a known id keeps its old row unless ``replace``."""
    keep, add = (incoming, existing) if replace else (existing, incoming)
    return keep.unionByName(add.join(keep.select("id"), "id", "left_anti"), allowMissingColumns=True)


def facts_from_profiles(profiles: DataFrame) -> DataFrame:
    """Facts from person profiles (name, birthday, parent, partner, interests)."""
    def fact(predicate: str, value: Column, since: Column) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                F.lit(predicate).alias("predicate"),
                F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 2**31 - 1)).alias("object"),
                since.cast("string").alias("valid_from"),
            ),
        )

    nothing = F.lit(None).cast("string")
    rows = profiles.withColumn(
        "_f",
        F.concat(
            F.array(
                fact("child_of", F.col("parent"), F.nullif(F.col("birthday"), F.lit(""))),
                fact("married_to", F.col("partner"), nothing),
            ),
            F.transform(
                F.coalesce("interests", F.array().cast("array<string>")),
                lambda i: fact("loves", i, F.lit("2025-01-01")),
            ),
        ),
    )
    one = rows.select("name", F.explode(F.filter("_f", F.isnotnull)).alias("f"))
    return one.select(
        F.col("name").alias("subject"), "f.predicate", "f.object", "f.valid_from",
        nothing.alias("valid_to"),
    )
