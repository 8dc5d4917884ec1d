"""Audit of filters that interact, by relations of failing ids.

Each filter is stored as one table of the rows that fail it, before any filter is applied.  What a
filter does at a place of an order depends on the set of filters before it alone, so the 120 orders
of five filters have 32 different prefixes.  For every failing row and every prefix without its
filter, a left anti join with the failing rows of the prefix gives what the filter removes there, a
left semi join what is redundant, and an anti join of all rows what is kept.  Label losses are the
same joins over the failing rows that a left semi join with the labelled ids leaves.

Rows are exchanged by their number before prefixes multiply them, and again only as counts; a text
takes part in no shuffle, only its digest does.

Defined results: null and empty texts have no words and fail the filter of short texts; a null
language is the part ''; every row counts as one document, also where it repeats an id; rows of one
id are not copies of each other by id, and a row with a null id is no copy and has no label; ids
that labels repeat have a label if any of their rows has; a part without failures has rows of zeros;
an empty table gives no row.  Only doc_id, text and lang are read: other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"


def text_rules(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def measured(df: DataFrame) -> DataFrame:
    """(row, doc_id, part, digest, failed) of each document; failed: letters of the failed text rules."""
    text = F.coalesce("text", F.lit(""))
    failed = F.array_compact(F.array(*(F.when(rule, F.lit(letter)) for letter, rule in text_rules(text).items())))
    return df.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), failed.alias("failed"),
    )


def copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller doc_id has: those that an anti join with each text's smallest id leaves.

    The join is by id and text, so a text that many documents share is spread over tasks.
    """
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return known.join(first, ["doc_id", "digest"], "left_anti")


def prefixes(letters: str) -> list[str]:
    """All sets of filters, letters in order."""
    return ["".join(some) for size in range(len(letters) + 1) for some in combinations(letters, size)]


def interactions(rows: DataFrame, fails: DataFrame, labelled: dict[str, DataFrame], letters: str) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, <label>_lost ..., shapley).

    rows: (row, part); fails: (filter, row, part), one stored relation for each filter; labelled:
    relations (row) whose removals are counted as <label>_lost.
    """
    seen = F.array(*map(F.lit, prefixes(letters)))
    of = fails.select(F.col("row"), F.col("filter").alias("other"))

    def failed_before(kind: str, these: DataFrame) -> DataFrame:
        met = (these["row"] == of["row"]) & (F.instr(these["seen"], of["other"]) > 0)
        return these.join(of, met, kind)

    kinds = [fails.withColumn("label", F.lit(""))]
    kinds += [fails.join(ids, "row", "left_semi").withColumn("label", F.lit(label)) for label, ids in labelled.items()]
    failing = kinds[0]
    for more in kinds[1:]:
        failing = failing.unionByName(more)
    failing = (
        failing.repartition("row")
        .select("*", F.explode(seen).alias("seen")).where(F.instr("seen", F.col("filter")) == 0)
    )
    keys = ["part", "filter", "seen"]
    removed = failed_before("left_anti", failing).groupBy(*keys).agg(
        F.count(F.when(F.col("label") == "", 1)).alias("removed"),
        *(F.count(F.when(F.col("label") == label, 1)).alias(f"{label}_lost") for label in labelled),
    )
    redundant = failed_before("left_semi", failing.where("label = ''")).groupBy(*keys).agg(F.count(F.lit(1)).alias("redundant"))
    everything = rows.select("row", "part").repartition("row").select("*", F.explode(seen).alias("seen"))
    kept = failed_before("left_anti", everything).groupBy("part", "seen").agg(F.count(F.lit(1)).alias("kept"))

    orders = F.array(*(F.lit("".join(order)) for order in permutations(letters)))
    steps = F.sequence(F.lit(1), F.lit(len(letters)))

    def sorted_letters(text: Column) -> Column:
        return F.array_join(F.array_sort(F.split(text, "")), "")

    grid = (
        rows.select("part").distinct()
        .select("part", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(steps).alias("step"))
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("seen", sorted_letters(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
        .withColumn("after", sorted_letters(F.substring("filter_order", F.lit(1), F.col("step"))))
        .withColumn("others", F.replace(F.lit(letters), F.col("filter"), F.lit("")))
    )
    removed = written(removed)
    unique = removed.select("part", "filter", F.col("seen").alias("others"), F.col("removed").alias("unique_fails"))
    sizes = ["kept", "removed", "redundant", "unique_fails", *(f"{label}_lost" for label in labelled)]
    found = (
        grid.join(removed, keys, "left").join(redundant, keys, "left")
        .join(unique, ["part", "filter", "others"], "left")
        .join(kept.withColumnRenamed("seen", "after"), ["part", "after"], "left")
        .select("part", "filter_order", "step", "filter", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sizes))
    )
    total = found.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return found.join(total, ["part", "filter"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over documents, with losses of good and toxic rows by labels."""
    rows = written(measured(docs))
    at = ["row", "part"]
    by_text = rows.select(*at, F.explode("failed").alias("filter"))
    fails = written(by_text.unionByName(copies(rows).select(*at, F.lit("E").alias("filter"))), "filter")
    labelled = {
        label: written(
            rows.where("doc_id is not null")
            .join(labels.where(F.col(column) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .select("row")
        )
        for label, column in (("good", "quality"), ("toxic", "toxic"))
    }
    return interactions(rows, fails, labelled, "ABCDE").drop("filter")


#: The audit by patterns of failures, for DuckDB.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), marked AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM words
), tags AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), patterns AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x
  FROM marked LEFT JOIN tags USING (doc_id) GROUP BY part, failed
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(failed, before || f, '') = failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN x ELSE 0 END) AS toxic_lost
  FROM patterns, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed,
  cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost,
  cast(sum(removed) OVER (PARTITION BY part, f) AS bigint) AS shapley
FROM counted
"""
