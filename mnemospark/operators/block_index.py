"""A stored BM25 index in blocks, with bounds that let a search leave blocks unread.

Drawers are numbered in the order of their length within each partition they are read in, and SLOT neighbours
make a slot: drawers of like length, so that what a term can add within a slot has a tight bound.  Each text is
cut into words once and never shuffled.  Three tables:

``docs``    (doc, slot, id, wing, room, filed_at, doc_len, runs): one row per drawer; runs, its terms with counts, is
            only read when drawers are taken out;
``blocks``  (term, slot, n, max_tf, min_len, best_tf, best_len, entries): the postings of one term in one slot with
            the bounds of their weights, ordered by term so that a term filter skips row groups;
``terms``   (term, df): how many drawers hold a term.

Bounds are kept as counts and lengths, not as scores: document frequency and average length enter at
query time, so bounds stay right whatever the corpus becomes.

A search reads the heads of its terms' blocks first.  The n-th best entry known from one term's heads
is a score that the n best reach, and slots whose bounds add up to less are left out; the rest are read and summed.
All n best are found, ties included.  The driver sees the statistics of the query's own terms and n rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import text as t
from mnemospark.operators import bm25

#: Drawers in a slot: a power of two, so that a drawer's number holds its slot.
SLOT_BITS = 7
#: Sums differ in their last digits with the order of terms; rounded, equal drawers tie.
SCORE_DIGITS = 9


def numbered(drawers: DataFrame) -> DataFrame:
    """The docs table; in each partition numbers follow length, newest first within a length."""
    runs = bm25.term_runs(drawers.select(F.col("id").alias("drawer_id"), "wing", "room", "filed_at", "content"))
    ordered = runs.sortWithinPartitions("doc_len", F.desc("filed_at"), "drawer_id")
    doc = F.monotonically_increasing_id()
    return ordered.select(
        doc.alias("doc"), F.shiftright(doc, SLOT_BITS).alias("slot"), F.col("drawer_id").alias("id"), "wing", "room",
        "filed_at", "doc_len", "runs",
    )


def blocks_of(docs: DataFrame) -> DataFrame:
    """The blocks table.  The best entry of a block is the one of greatest weight where lengths are average.

    Entries are shuffled once, to the range of their term, and grouped where they lie.
    """
    rows = docs.select("doc", "slot", "doc_len", F.explode("runs").alias("r")).select("doc", "slot", "doc_len", "r.term", "r.tf")
    rows = rows.repartitionByRange("term", "slot")
    entry = F.struct("doc", F.col("tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("len"))
    ratio = F.col("tf") / (F.col("tf") + fv.BM25_K1)
    grouped = rows.groupBy("term", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"),
        F.max_by(F.struct("tf", "doc_len"), F.struct(ratio, -F.col("doc_len"))).alias("_best"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    kept = grouped.select("term", "slot", "n", "max_tf", "min_len", F.col("_best.tf").alias("best_tf"), F.col("_best.doc_len").alias("best_len"), "entries")
    return kept.sortWithinPartitions("term", "slot")


@dataclass
class BlockIndex:
    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    #: Numbers of drawers that blocks still hold but docs no longer does, and how many.
    dead: DataFrame | None = None
    n_dead: int = 0

    @staticmethod
    def write(drawers: DataFrame, path: str) -> "BlockIndex":
        """Builds the tables below a shared folder, each from the one written before it."""
        spark = drawers.sparkSession
        numbered(drawers).write.parquet(f"{path}/docs")
        blocks_of(spark.read.parquet(f"{path}/docs")).write.parquet(f"{path}/blocks")
        heads = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
        heads.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return BlockIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "BlockIndex":
        return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "blocks", "terms")))

    def corpus(self) -> DataFrame:
        """One row (n, avg_len)."""
        return self.docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("doc_len").alias("avg_len"))

    def statistics(self, terms: list[str]) -> tuple[float, dict[str, float]]:
        """(average length, idf of each term that occurs): rows of the query's terms only."""
        n, avg_len = self.corpus().first()
        known = self.terms.where(F.col("term").isin(terms)).select("term", bm25.idf(F.lit(n), F.col("df").cast("double"))).collect()
        return avg_len, dict(map(tuple, known))


class Search:
    """One query over an index: its statistics, and frames of scores."""

    def __init__(self, index: BlockIndex, query: str):
        self.index = index
        self.avg_len, self.idf = index.statistics(bm25.query_terms(query))
        self.heads = index.blocks.where(F.col("term").isin(list(self.idf)))

    def part(self, tf: str, length: str) -> Column:
        """What an entry of the row's term adds."""
        factor = F.lit(None).cast("double")
        for term, value in self.idf.items():
            factor = F.when(F.col("term") == term, F.lit(value)).otherwise(factor)
        return factor * bm25.term_weight(F.col(tf).cast("double"), F.col(length).cast("double"), F.lit(self.avg_len))

    def reached(self, n: int) -> float:
        """A score that the n best of all drawers reach: the n-th best entry that one term's heads show."""
        part = self.heads.select("term", self.part("best_tf", "best_len").alias("part"))
        order = Window.partitionBy("term").orderBy(F.desc("part"))
        nth = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        return nth.where(F.col("rank") == n).agg(F.coalesce(F.max("part"), F.lit(0.0))).first()[0]

    def open_slots(self, least: float) -> DataFrame:
        """Slots whose bounds add up to the score, or nearly."""
        bound = self.heads.groupBy("slot").agg(F.sum(self.part("max_tf", "min_len")).alias("bound"))
        return bound.where(F.col("bound") >= least * (1 - 1e-9)).select("slot")

    def scores(self, least: float = 0.0, always: list[int] = ()) -> DataFrame:
        """(doc, slot, bm25) of the drawers with a term, whole for all that can reach the score and in the slots of ``always``."""
        rows = self.heads
        if least > 0:
            slots = self.open_slots(least)
            if always:
                slots = slots.union(slots.sparkSession.createDataFrame([(s,) for s in always], "slot long")).distinct()
            rows = rows.join(slots, "slot")
        entries = rows.select("term", "slot", F.explode("entries").alias("e")).select("term", "slot", "e.*")
        if self.index.dead is not None:
            entries = entries.join(self.index.dead, "doc", "left_anti")
        return entries.groupBy("doc", "slot").agg(F.round(F.sum(self.part("tf", "len")), SCORE_DIGITS).alias("bm25"))

    def named(self, scores: DataFrame, wing: str | None = None, room: str | None = None) -> DataFrame:
        """Scores with id and time, of the drawers in the filter."""
        docs = bm25.narrow(self.index.docs, wing, room).select("doc", "slot", "id", "filed_at")
        return docs.join(scores, ["doc", "slot"])

    def top(self, n: int, wing: str | None = None, room: str | None = None) -> DataFrame:
        """(id, filed_at, bm25) of the n best, best first."""
        if not self.idf:
            return self.named(self.index.docs.select("doc", "slot", F.lit(0.0).alias("bm25")).limit(0)).select("id", "filed_at", "bm25")
        if wing is None and room is None:
            found = self.scores(self.reached(n + self.index.n_dead))
            # Tasks pass on n scores at most; ties of the last place stay until time and id decide.
            last = found.select("bm25").orderBy(F.desc("bm25")).limit(n).agg(F.min("bm25")).scalar()
            found = self.named(found.where(F.col("bm25") >= last))
        else:
            found = self.named(self.scores(), wing, room)
        return found.select("id", "filed_at", "bm25").orderBy(F.desc("bm25"), F.desc("filed_at"), "id").limit(n)


def search(index: BlockIndex, query: str, n: int, wing: str | None = None, room: str | None = None) -> DataFrame:
    """(id, filed_at, bm25) of the n best drawers."""
    return Search(index, query).top(n, wing, room)


def without(index: BlockIndex, ids: DataFrame) -> BlockIndex:
    """The index as if the drawers (id) had never been in it.

    Counts of their terms go down and their entries are left out when scores are summed; bounds may now be
    higher than need be, which costs blocks but no results.
    """
    gone = index.docs.join(ids.select("id").distinct(), "id", "left_semi")
    fewer = gone.select(F.explode("runs.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_gone"))
    terms = index.terms.join(fewer, "term", "left").select("term", (F.col("df") - F.coalesce("_gone", F.lit(0))).alias("df")).where("df > 0")
    dead = gone.select("doc") if index.dead is None else index.dead.union(gone.select("doc"))
    return BlockIndex(index.docs.join(ids.select("id").distinct(), "id", "left_anti"), index.blocks, terms, dead, dead.count())
