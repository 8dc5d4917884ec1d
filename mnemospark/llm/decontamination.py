"""Benchmark decontamination: item-sized windows, SimHash with Hamming blocks, exact similarity.

Each place where a document holds one of an item's shingles suggests a window: as many words as the
item has, set so that the shingle lies where it lies in the item (windows that share no shingle
with any item have similarity 0 and are not looked at).  Windows and items get 64-bit SimHashes of
their shingles, weighted by how often each occurs.  The hash is cut into BLOCKS blocks; two hashes
within RADIUS bits differ by at most NEAR bits in one block, so items are listed under all block
values within NEAR bits and every item of a window's length within RADIUS is found.  Candidates
are verified by the weighted Jaccard similarity of their shingles (minimum over maximum counts).

All expressions run on the JVM.  Defined results: null and empty texts, and texts shorter than a
shingle, have no match; items shorter than a shingle are not searched; documents shorter than an item
are one window for it; repeated rows are judged alike, also if they repeat or lack an id; without
items no document matches.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import written

SHINGLE = 5
BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: All block values within NEAR bits of 0.
MASKS = sorted(sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(BLOCK_BITS), n))


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(of: str) -> Column:
    """The hashes of an array of words; a column of its own, so that each word is hashed once."""
    return F.transform(of, lambda w: F.xxhash64(w))


def shingles(of: str) -> Column:
    """Hashes of the SHINGLE-word shingles of an array of word hashes, in order."""
    last = F.size(of) - SHINGLE
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(of), i + k) for k in range(SHINGLE))))


def simhash(of: str) -> Column:
    """The bits that most shingles have set."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft("
        f"if(2 * size(filter({of}, x -> (shiftright(x, b) & 1L) = 1L)) > size({of}), 1L, 0L), b))"
    )


def numbered(of: str) -> Column:
    """Shingles with their occurrence numbers: sets of these compare as weighted shingles do."""
    return F.expr(f"transform(sort_array({of}), (x, i) -> struct(x, i - array_position(sort_array({of}), x) AS k))")


def block(of: Column, number: Column) -> Column:
    return F.expr(f"shiftright({of}, {BLOCK_BITS} * {number}) & {2**BLOCK_BITS - 1}L")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, shingles) of the items that can be searched."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("w"))
    rows = rows.select("item_id", hashed("w").alias("w"))
    return rows.select("item_id", F.size("w").alias("size"), shingles("w").alias("shingles")).where(F.col("size") >= SHINGLE)


def keyed(df: DataFrame) -> DataFrame:
    """(_d, _t, text): the name of a row by its id and text, and the text."""
    return df.select(*_key(df), df["text"].alias("text"))


def _key(df: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(df["doc_id"].cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(df["text"]).alias("_t")


def windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(_d, _t, start, size): item-sized windows where a shingle of a document lies as in an item."""
    known = items.select("size", F.posexplode("shingles").alias("at", "h")).distinct()
    own = rows.select("_d", "_t", words("text").alias("w")).select("_d", "_t", hashed("w").alias("w")).select(
        "_d", "_t", F.size("w").alias("n"), F.posexplode(shingles("w")).alias("place", "h")
    )
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("at"), F.col("n") - F.col("size")))
    return own.join(known, "h").select("_d", "_t", start.alias("start"), "size").distinct()


def matches(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(_d, _t, item_id, start, size, similarity) of windows whose similarity to an item is at least ``least``."""
    items = written(items_of(benchmark))
    rows = keyed(documents)
    found = written(windows(rows, items)).groupBy("_d", "_t").agg(F.collect_list(F.struct("start", "size")).alias("windows"))
    # Written, so that no later condition repeats the work of these columns.
    of_windows = written(
        rows.dropDuplicates(["_d", "_t"]).join(found, ["_d", "_t"])
        .withColumn("w", words("text"))
        .withColumn("w", hashed("w"))
        .select("_d", "_t", "w", F.explode("windows").alias("at"))
        .select("_d", "_t", "at.start", "at.size", F.slice("w", F.col("at.start") + 1, F.col("at.size")).alias("part"))
        .select("_d", "_t", "start", "size", shingles("part").alias("h"))
        .select("_d", "_t", "start", "size", simhash("h").alias("sim"), numbered("h").alias("x"))
    )
    of_items = written(items.select("item_id", "size", simhash("shingles").alias("item_sim"), numbered("shingles").alias("y")))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("number")
    left = of_windows.select("*", numbers).withColumn("value", block("sim", "number"))
    right = (
        of_items.drop("y").select("*", numbers)
        .withColumn("value", F.explode(F.array(*(F.lit(m).cast("long") for m in MASKS))))
        .withColumn("value", F.col("value").bitwiseXOR(block("item_sim", "number")))
    )
    apart = F.col("sim").bitwiseXOR(F.col("item_sim"))
    # A pair may meet in several blocks; it is kept in the first.
    first = F.expr(
        f"array_min(filter(sequence(0, {BLOCKS - 1}), j -> bit_count(shiftright(apart, {BLOCK_BITS} * j) & {2**BLOCK_BITS - 1}L) <= {NEAR}))"
    )
    near = (
        left.join(right, ["size", "number", "value"]).withColumn("apart", apart)
        .where((F.bit_count("apart") <= RADIUS) & (F.col("number") == first))
        .select("_d", "_t", "start", "size", "x", "item_id")
    )
    sets = of_items.select("item_id", "y")
    both = F.size(F.array_intersect("x", "y"))
    return (
        near.join(sets, "item_id")
        .select("_d", "_t", "item_id", "start", "size", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
        .where(F.col("similarity") >= least)
    )


def contamination(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, contaminated, items, n_windows, similarity) of each row of documents."""
    found = matches(documents, benchmark, least).groupBy("_d", "_t").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.countDistinct("start", "size").alias("n_windows"),
        F.max("similarity").alias("similarity"),
    )
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), *_key(documents))
    return rows.join(found, ["_d", "_t"], "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows that hold no window similar to an item, with their own columns."""
    found = written(matches(documents, benchmark, least).select(F.col("_d").alias("_found_d"), F.col("_t").alias("_found_t")).distinct())
    d, t = _key(documents)
    return documents.join(found, (d == found["_found_d"]) & (t == found["_found_t"]), "left_anti")
