"""Document fingerprints from spot signatures: chains of content words behind common words.

Each common word (an anchor) starts one signature: the anchor and the next CHAIN words that are not
common.  The k-th anchor at word i has i - k content words before it, so chains are looked up in
the list of content words, in one pass over the words.  A fingerprint is the sorted set of a text's
signatures; likeness is the Jaccard similarity of two sets, pruned by their lengths.

All expressions run on the JVM.  Defined results: null texts count as empty; a text without common
words uses every word as an anchor, followed by the next words; a text without words has an empty
fingerprint; two empty fingerprints have likeness 1, an empty and another one 0; equal texts have
equal fingerprints.  The next document is the next row by descending id, then by text; rows without
an id come last, and after the last row comes the first; a single row is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import written

CHAIN = 2
#: Rows of one bucket when neighbours are looked for, and the most buckets (their bounds are numbers on the driver).
BUCKET_ROWS = 1000
MOST_BUCKETS = 1 << 14
# Common words of four languages.
COMMON = (
    "the of and to in is a that it for was on be with as by at this from are or an he his not but had have were which they "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es er sie hat bei einer wird "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur il elle avec ne se ce sont "
    "el los las del y por con para una su al lo como más pero sus"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sorted set of a text column's signatures (64-bit)."""
    w, anchors, content = (f"{name}_{x}" for x in ("w", "anchors", "content"))
    common = lambda x: x.isin(COMMON)
    indexed = F.filter(F.transform(F.col(w), lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: common(x["w"]))

    def chain(first: Column, of: str, at: Column) -> Column:
        return F.xxhash64(first, *(F.get(F.col(of), at + k) for k in range(CHAIN)))

    return (
        df.withColumn(w, words(F.col(text)))
        .withColumn(anchors, indexed)
        .withColumn(content, F.filter(F.col(w), lambda x: ~common(x)))
        .withColumn(
            name,
            F.sort_array(
                F.array_distinct(
                    F.when(F.size(anchors) > 0, F.transform(anchors, lambda x, k: chain(x["w"], content, x["i"] - k)))
                    .otherwise(F.transform(w, lambda x, i: chain(x, w, i + 1)))
                )
            ),
        )
        .drop(w, anchors, content)
    )


def fingerprint(signatures: str) -> Column:
    """A set of signatures as a string: twelve hexadecimal digits each, ascending."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 16))), 12, "0")), "")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where the lengths keep it below least."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < least * large), 0.0)
        .otherwise(both / (small + large - both))
    )


def with_next(df: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) of each row of df.

    Rows are dealt once, to buckets of neighbouring ids between at most MOST_BUCKETS bounds.  The
    first row of a bucket also goes to the bucket before it, where it comes last: so each row finds
    its next one inside its bucket.  Bounds and first ids are numbers on the driver.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = min(MOST_BUCKETS, rows.count() // BUCKET_ROWS)
    bounds: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        bounds = sorted(set(rows.select(F.percentile_approx("k", shares, 20 * wanted)).first()[0]))
    rows = rows.withColumn("bucket", _bucket(F.col("k"), bounds))
    heads = {r["bucket"]: r["head"] for r in rows.groupBy("bucket").agg(F.max("k").alias("head")).collect()}
    filled = sorted(heads)
    before = dict(zip(filled, [*filled[1:], *filled[:1]]))  # ids descend, so a bucket follows the one above it
    every = range(len(bounds) + 1)
    head, above = (F.array(*(F.lit(x.get(i)).cast("long") for i in every)) for x in (heads, before))
    own = F.struct(F.col("bucket").cast("long").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(above, F.col("bucket")).alias("b"), F.lit(True).alias("guest"))
    placed = rows.withColumn("at", F.explode(F.when(F.get(head, F.col("bucket")) == F.col("k"), F.array(own, guest)).otherwise(F.array(own))))
    down = Window.partitionBy("at.b").orderBy("at.guest", F.desc("k"), "text")
    return placed.withColumn("next_text", F.lead("text").over(down)).where(~F.col("at.guest")).select("doc_id", "text", "next_text")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search in the expression."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    known = F.array(*(F.lit(x).cast("long") for x in bounds))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(known, low + step - 1) <= key, low + step).otherwise(low))


def with_fingerprints(df: DataFrame) -> DataFrame:
    """df (doc_id, text, ...) with its fingerprint."""
    return with_signatures(df, "text", "_signatures").withColumn("fingerprint", fingerprint("_signatures")).drop("_signatures")


def edited(df: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text (its second half replaced by as much of the next
    document's beginning) and their likeness."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(df).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    )
    for text, name in (("text", "s"), ("edited", "e"), ("next_text", "x")):
        rows = with_signatures(rows, text, name)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("s").alias("fingerprint"),
        fingerprint("e").alias("edited_fingerprint"),
        likeness("s", "e").alias("near_edited"),
        likeness("s", "x").alias("near_next"),
    )


def classes(df: DataFrame) -> DataFrame:
    """(doc_id, class_id, signatures): the class of equal fingerprints is named by its smallest id."""
    rows = with_signatures(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "signatures")
    rows = rows.withColumn("name", F.sha2(fingerprint("signatures"), 256))
    smallest = rows.groupBy("name").agg(F.min("doc_id").alias("class_id"))
    return rows.join(smallest, "name").select("doc_id", "class_id", "signatures")


def near_pairs(df: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): classes of equal fingerprints whose likeness is at least ``least``; a < b.

    Sets are dealt to partitions by length, so that similar sets lie in one partition or the next;
    inside, two sets meet only if the prefixes of their signatures share one.
    """
    sets = written(classes(df).where("doc_id = class_id and size(signatures) > 0").select("class_id", "signatures"))
    size = F.size("signatures")
    band = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    keep = (size - F.ceil(size * least - 1e-9) + 1).cast("int")
    keys = sets.select("class_id", band.alias("band"), F.explode(F.slice("signatures", F.lit(1), keep)).alias("s"))
    low = keys.select(F.col("class_id").alias("a"), "s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("p"), F.col("band").alias("own"))
    met = (
        low.join(keys.select(F.col("class_id").alias("b"), "s", F.col("band").alias("p")), ["p", "s"])
        .where("own < p or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    x = sets.select(F.col("class_id").alias("a"), F.col("signatures").alias("x"))
    y = sets.select(F.col("class_id").alias("b"), F.col("signatures").alias("y"))
    return met.join(x, "a").join(y, "b").select("a", "b", likeness("x", "y", least).alias("likeness")).where(F.col("likeness") >= least)
