"""Hard negatives of anchors by exact integer scores from Kronecker-packed products.

Vectors are whole numbers.  The j-th components of several candidates, biased so that none is
negative, are packed into separated fields of one wide integer, a field being wide enough for the
largest score.  Multiplying that integer once by an anchor's (biased) j-th component multiplies all
fields, and the sum over j holds every candidate's score in its own field; unpacking and taking the
biases off gives exact scores.  As long as two fields or more fit 52 bits, the wide integers lie in the
mantissas of doubles, where sums of whole numbers are exact in any order, and one matrix product does
all multiplications of a block; larger components go through Python's integers of any width.

Anchors are the stated query set: they meet all rows in cells, each one block of anchors and one
block of rows, so neither side is ever whole in a task or in the driver.  A first round of cells gives
each anchor's best rows of its own label, a second one the best rows of other labels below each
positive's score; of every cell only that many rows leave.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component
take no part; vectors of different lengths are compared as if the shorter one went on with zeros, and
an empty vector scores 0 with all; rows that repeat an id are rows of their own (an anchor never meets
its own row); equal scores go to the smaller id; anchors without another row of their label, or
positives without a negative in range, give no row; an empty table gives none.  Components beyond 53
bits and scores beyond 64 are held at these limits.  Other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import written

#: Most anchors, and most rows, in a block.
ANCHOR_BLOCK, ROW_BLOCK, LEAST_BLOCK = 16_384, 65_536, 1_024
#: Whole numbers up to this many bits are exact in a double, whatever the order of sums.
MANTISSA = 52
#: Scores that a task holds at once.
SCORES = 1 << 21
LONG = (-(2**63), 2**63 - 1)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchors x rows) of whole-number vectors; int64, or Python integers if those are too small."""
    if not len(anchors) or not len(rows) or not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    dims, low_a, low_r = anchors.shape[1], int(anchors.min()), int(rows.min())
    range_a, range_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    width = max(1, (dims * range_a * range_r).bit_length())
    fields = MANTISSA // width
    if fields >= 2:
        groups = -(-len(rows) // fields)
        biased = np.zeros((groups * fields, dims), np.int64)
        biased[: len(rows)] = rows - low_r
        shifts = np.arange(fields) * width
        wide = (biased.reshape(fields, groups, dims) << shifts[:, None, None]).sum(axis=0)
        sums = ((anchors - low_a).astype(np.float64) @ wide.astype(np.float64).T).astype(np.int64)
        products = np.concatenate([(sums >> s) & ((1 << width) - 1) for s in shifts], axis=1)[:, : len(rows)]
    else:
        size = -(-width // 8)
        wide = [int.from_bytes(b"".join((int(x) - low_r).to_bytes(size, "little") for x in rows[:, j]), "little") for j in range(dims)]
        products = np.empty((len(anchors), len(rows)), object)
        for i, anchor in enumerate(anchors):
            held = sum((int(a) - low_a) * w for a, w in zip(anchor, wide)).to_bytes(size * len(rows), "little")
            products[i] = [int.from_bytes(held[k : k + size], "little") for k in range(0, len(held), size)]
    # sum (a - la)(r - lr) = sum a r - lr sum a - la sum r + d la lr
    if fields < 2 or max(abs(low_a) + range_a, abs(low_r) + range_r) >= 1 << 24 or dims >= 1 << 13:
        products, anchors, rows = products.astype(object), anchors.astype(object), rows.astype(object)
    exact = products + low_r * anchors.sum(axis=1)[:, None] + low_a * rows.sum(axis=1)[None, :] - dims * low_a * low_r
    return np.clip(exact, *LONG).astype(np.int64) if exact.dtype == object else exact


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one array, shorter ones filled with zeros."""
    if not len(lists):
        return np.zeros((0, width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def dimensions(*tables: pa.Table) -> int:
    return max((int(np.diff(t["q"].combine_chunks().offsets.to_numpy()).max()) for t in tables if t.num_rows), default=0)


class Block:
    """One side of a cell: ids ascending, so that the first of equal scores has the smaller id."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.ids, self.rows, self.labels = (table[c].to_numpy() for c in ("vec_id", "row", "label"))
        self.q = matrix(table["q"].combine_chunks(), width)
        self.table = table

    def cut(self, width: int):
        """Slices of the anchors, so that their scores with so many rows stay within bounds."""
        step = max(1, SCORES // max(1, width))
        return (slice(k, k + step) for k in range(0, len(self.ids), step))


def firsts(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the first k fitting places of each line: highest score, then leftmost."""
    line, place = np.nonzero(fit)
    score = scores[line, place]
    # Only places that reach a line's k-th best score can be among the first.
    if scores.shape[1] > k:
        held = np.where(fit, scores, LONG[0])
        bound = np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        near = score >= bound[line]
        line, place, score = line[near], place[near], score[near]
    order = np.lexsort((place, ~score, line))  # ~s falls as s rises and does not overflow
    line, place = line[order], place[order]
    start = np.searchsorted(line, np.arange(len(scores)))
    rank = np.arange(len(line)) - start[line]
    return line[rank < k], place[rank < k]


def positives_of(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Best rows of an anchor's own label in one cell."""
    width = dimensions(anchors, rows)
    a, r = Block(anchors, width), Block(rows, width)
    out = []
    for cut in a.cut(len(r.ids)):
        scores = packed_scores(a.q[cut], r.q)
        fit = (a.labels[cut][:, None] == r.labels[None, :]) & (a.rows[cut][:, None] != r.rows[None, :])
        line, place = firsts(scores, fit, k)
        out.append((a.rows[cut][line], r.ids[place], r.rows[place], scores[line, place]))
    return pa.table([np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(4)], ["anchor", "positive_id", "positive", "positive_score"])


def negatives_of(anchors: pa.Table, rows: pa.Table, k: int, percent: int) -> pa.Table:
    """Best rows of other labels in one cell, from percent of a positive's score up to it, for each positive."""
    width = dimensions(anchors, rows)
    a, r = Block(anchors, width), Block(rows, width)
    lists = a.table["positives"].combine_chunks()
    bounds = [np.array(x, np.int64) for x in lists.to_pylist()]
    out = []
    for cut in a.cut(len(r.ids)):
        scores = packed_scores(a.q[cut], r.q)
        other = a.labels[cut][:, None] != r.labels[None, :]
        for n in range(max(map(len, bounds[cut]), default=0)):
            has = np.array([len(x) > n for x in bounds[cut]])
            most = np.array([x[n] if len(x) > n else 0 for x in bounds[cut]], np.int64)
            least = np.array([-((-percent * int(x)) // 100) for x in most], object).clip(*LONG).astype(np.int64)
            fit = other & has[:, None] & (scores <= most[:, None]) & (scores >= least[:, None])
            line, place = firsts(scores, fit, k)
            out.append((a.rows[cut][line], np.full(len(line), n + 1), r.ids[place], r.rows[place], scores[line, place]))
    return pa.table([np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(5)], ["anchor", "n", "negative_id", "negative", "negative_score"])


def whole_numbers(df: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, q) of the rows that take part; q: floor(scale * x), x as double."""
    limit = float(2**MANTISSA)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.least(F.lit(limit), F.greatest(F.lit(-limit), x.cast("double") * scale))))
    return (
        df.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                F.col("label").cast("long").alias("label"), q.alias("q"))
    )


def shifted_labels(df: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """(label + 1) % labels on the rows whose vec_id is divisible by every."""
    return df.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def best(found: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """With the rank of each row among its keys."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties)))


def hard_negatives(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (row, vec_id, label, q); anchors: condition on these columns that marks the anchors.
    """
    vectors = written(vectors)
    size, asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(anchors, 1))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    block = min(ROW_BLOCK, max(LEAST_BLOCK, math.ceil(size / (4 * cores))))
    columns, lines = max(1, math.ceil(size / block)), max(1, math.ceil(asked / ANCHOR_BLOCK))

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    # Columns of their own: both sides of a cell come from one table.
    sides = vectors.select(*(F.col(c).alias(c) for c in vectors.columns), dealt(columns).alias("c")).select("*", spread(lines).alias("l")).groupBy("l", "c")

    def cells(these: DataFrame, function, schema: str) -> DataFrame:
        asking = these.select("*", dealt(lines).alias("l")).select("*", spread(columns).alias("c")).groupBy("l", "c")
        return asking.cogroup(sides).applyInArrow(function, schema)

    asking = vectors.where(anchors)
    found = cells(asking, lambda a, r: positives_of(a, r, positives), "anchor long, positive_id long, positive long, positive_score long")
    chosen = written(best(found, ["anchor"], "positive_score", "positive_id", "positive").where(F.col("rank") <= positives))
    scores = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    ready = asking.join(scores.select(F.col("anchor").alias("row"), F.col("p.positive_score").alias("positives")), "row")
    found = cells(ready, lambda a, r: negatives_of(a, r, negatives, percent), "anchor long, n long, negative_id long, negative long, negative_score long")
    ranked = best(found, ["anchor", "n"], "negative_score", "negative_id", "negative").where(F.col("rank") <= negatives)
    named = asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = chosen.select("anchor", F.col("rank").cast("long").alias("n"), "positive_id", "positive_score")
    return ranked.join(pairs, ["anchor", "n"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def mined(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by every, with the labels of every seventh row shifted."""
    return hard_negatives(shifted_labels(whole_numbers(embeddings)), F.col("vec_id") % every == 0)


#: The same by comparing every anchor with every row, for DuckDB.
SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, cast(list_inner_product(a.q, r.q) AS bigint) AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), pairs AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, cast(rank AS integer) AS rank, negative_id, positive_score, negative_score
FROM pairs WHERE rank <= 5
"""
