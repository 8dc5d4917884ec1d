"""Hybrid retrieval: vector and BM25 candidates, fused and boosted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import scoring
from mnemospark.functions.columns import computed, round_to
from mnemospark.operators import block_index, bm25, vectors

RESULT_COLUMNS = [
    "id", "wing", "room", "content", "source_file", "chunk_index", "filed_at", "cosine", "bm25",
    "coding_boost", "preference_match", "rerank_score", "combined",
]


def _order(score: str = "combined") -> list[Column]:
    return [F.desc(score), F.desc("filed_at"), F.asc("id")]


def _fuse(cands: DataFrame, query: str, as_of: Column, max_bm25: Column) -> DataFrame:
    lowered = computed(cands, {"_text": F.lower("content"), "_room": F.lower("room")})
    scored = lowered.withColumns(
        {
            "coding_boost": F.expr(scoring.coding_boost(query, "_text", "_room")),
            "preference_match": F.expr(scoring.preference_match(query, "content", "_room")),
            "_recency": scoring.recency(F.col("filed_at"), as_of),
            "_norm": F.when(max_bm25 > 0, F.col("bm25") / max_bm25).otherwise(0.0),
        }
    )
    combined = (
        F.col("cosine") * fv.COSINE_WEIGHT
        + F.col("_norm") * fv.BM25_WEIGHT
        + F.col("coding_boost")
        + F.col("preference_match")
        + F.col("_recency")
    )
    return scored.withColumns(
        {"rerank_score": F.lit(None).cast("double"), "combined": combined}
    )


def hybrid_search(
    drawers: DataFrame,
    query: str,
    vector: Sequence[float] | None,
    n: int,
    as_of: Column,
    wing: str | None = None,
    room: str | None = None,
    index: tuple[DataFrame, DataFrame] | block_index.BlockIndex | None = None,
) -> DataFrame:
    """The n best drawers of the filter.

    Vector candidates number at most max(4n, 20), so the planner can broadcast them and the
    BM25 side is never shuffled for the union of both candidate sets.  With an
    ``index`` (postings and doc_stats, or blocks) text is read only for candidates that can
    still reach the first n.
    """
    query = q.sanitize(query) or query
    pool = max(n * fv.VECTOR_POOL_FACTOR, fv.VECTOR_POOL_MIN)
    keep = ["id", "wing", "room", "content", "source_file", "chunk_index", "filed_at"]
    near = None
    if vector is not None:
        near = vectors.vector_top_k(drawers, vector, pool, wing, room).select(
            "id", F.col("similarity").alias("_sim")
        )
    if index is not None:
        if near is not None:
            # A few rows that three branches below use: one vector scan, not three.
            near = drawers.sparkSession.createDataFrame(near.collect(), near.schema)
        find = _block_candidates if isinstance(index, block_index.BlockIndex) else _indexed_candidates
        cands = find(index, near, query, n, wing, room)
        cands = bm25.narrow(drawers.select(*keep), wing, room).join(cands, "id")
    else:
        rows = bm25.score_text(drawers.select(*keep), query, wing, room)
        # Vector-only candidates have no BM25 score and cannot raise the maximum.
        max_bm25 = rows.agg(F.coalesce(F.max("bm25"), F.lit(0.0))).scalar()
        if near is None:
            cands = rows.filter(F.col("bm25").isNotNull()).withColumn("cosine", F.lit(0.0))
        else:
            cands = (
                rows.join(near, "id", "left")
                .filter(F.col("bm25").isNotNull() | F.col("_sim").isNotNull())
                .withColumn("cosine", _floored(F.col("_sim")))
                .drop("_sim")
            )
        cands = cands.withColumns({"bm25": F.coalesce("bm25", F.lit(0.0)), "_max": max_bm25})
    fused = _fuse(cands, query, as_of, F.col("_max"))
    return fused.select(*RESULT_COLUMNS).orderBy(*_order()).limit(n)


def _floored(similarity: Column) -> Column:
    return F.greatest(F.coalesce(similarity, F.lit(0.0)), F.lit(0.0))


def _indexed_candidates(
    index: tuple[DataFrame, DataFrame],
    near: DataFrame | None,
    query: str,
    n: int,
    wing: str | None,
    room: str | None,
) -> DataFrame:
    """(id, cosine, bm25, _max) of drawers that can still be among the n best.

    Bonuses need the text but never exceed a bound the query fixes.  A drawer
    whose base plus that bound stays below the n-th best base is out, exactly.
    """
    parts = bm25.contributions(*index, query, wing, room).select(
        F.col("drawer_id").alias("id"), "part", F.lit(None).cast("double").alias("_sim")
    )
    if near is not None:
        parts = parts.unionByName(
            near.select("id", F.lit(None).cast("double").alias("part"), "_sim")
        )
    cands = parts.groupBy("id").agg(
        F.coalesce(F.sum("part"), F.lit(0.0)).alias("bm25"), _floored(F.max("_sim")).alias("cosine")
    )
    max_bm25 = cands.agg(F.coalesce(F.max("bm25"), F.lit(0.0))).scalar()
    based = cands.withColumn("_max", max_bm25).withColumn(
        "_base",
        F.col("cosine") * fv.COSINE_WEIGHT
        + F.when(F.col("_max") > 0, F.col("bm25") / F.col("_max")).otherwise(0.0) * fv.BM25_WEIGHT,
    )
    best = based.select("_base").orderBy(F.desc("_base")).limit(n)
    # With fewer than n candidates nothing is ruled out.
    floor = best.agg(
        F.when(F.count(F.lit(1)) >= n, F.min("_base")).otherwise(F.lit(0.0))
    ).scalar()
    slack = scoring.highest_bonus(query) + 1e-9
    return based.filter(F.col("_base") + F.lit(slack) >= floor).drop("_base")


def _block_candidates(
    index: block_index.BlockIndex,
    near: DataFrame | None,
    query: str,
    n: int,
    wing: str | None,
    room: str | None,
) -> DataFrame:
    """(id, cosine, bm25, _max) as above, from blocks.

    The n best by BM25 and the few near rows fix the maximum and a base that the n best reach; from
    these follows the BM25 score that a drawer which is not near must have, and so which slots are read.
    """
    spark = index.docs.sparkSession
    asked = block_index.Search(index, query)
    sims = {r["id"]: max(0.0, r["_sim"]) for r in near.collect()} if near is not None else {}
    best = {r["id"]: r["bm25"] for r in asked.top(n, wing, room).collect()}
    highest = max(best.values(), default=0.0)

    def base(key: str) -> float:
        share = best.get(key, 0.0) / highest if highest > 0 else 0.0
        return sims.get(key, 0.0) * fv.COSINE_WEIGHT + share * fv.BM25_WEIGHT

    bases = sorted((base(key) for key in sims.keys() | best.keys()), reverse=True)
    spare = (bases[n - 1] if len(bases) >= n else 0.0) - scoring.highest_bonus(query) - 1e-9
    least = max(0.0, spare) / fv.BM25_WEIGHT * highest
    known = spark.createDataFrame([(key, value) for key, value in sims.items()], "id string, cosine double")
    here = index.docs.where(F.col("id").isin(list(sims))).select("doc", "slot").collect() if sims else []
    if not asked.idf:
        scored = spark.createDataFrame([], "id string, bm25 double")
    else:
        scores = asked.scores(least, sorted({r["slot"] for r in here}))
        if least > 0:
            scores = scores.where((F.col("bm25") >= least) | F.col("doc").isin([r["doc"] for r in here]))
        scored = asked.named(scores, wing, room).select("id", "bm25")
    return scored.join(known, "id", "full").select(
        "id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"),
        F.lit(highest).alias("_max"),
    )


def merge_preferences(
    results: DataFrame,
    drawers: DataFrame,
    vector: Sequence[float],
    n: int,
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    """Adds preference drawers that the first pass missed; n rows at most."""
    pool = vectors.preference_top_k(drawers, vector, fv.PREFERENCE_POOL, wing, room)
    extra = pool.filter(F.col("similarity") >= fv.PREFERENCE_MIN_COSINE).join(
        results.select("id"), "id", "left_anti"
    )
    text = drawers.select("id", "content", "chunk_index")
    added = text.join(extra, "id").select(
        "id", "wing", "room", "content", "source_file", "chunk_index", "filed_at",
        F.col("similarity").alias("cosine"),
        F.lit(0.0).alias("bm25"),
        F.lit(0.0).alias("coding_boost"),
        F.col("similarity").alias("preference_match"),
        F.lit(None).cast("double").alias("rerank_score"),
        (F.col("similarity") * fv.PREFERENCE_COMBINED_WEIGHT).alias("combined"),
    )
    return results.unionByName(added).orderBy(*_order()).limit(n)


def rerank(results: DataFrame, query: str) -> DataFrame:
    """Blends the interaction score into the few rows found so far."""
    blended = results.withColumn(
        "rerank_score", scoring.interaction_score(query, "content")
    ).withColumn(
        "combined",
        F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.5),
                F.col("combined") * fv.RERANK_KEEP_WEIGHT
                + F.col("rerank_score") * fv.RERANK_SCORE_WEIGHT,
            ),
        ),
    )
    return blended.orderBy(*_order())


def with_source_context(results: DataFrame, drawers: DataFrame, radius: int = 1) -> DataFrame:
    """One row per hit and neighbouring chunk of the same file."""
    hits = results.select(
        F.col("id").alias("hit_id"), F.col("source_file").alias("_file"),
        F.col("chunk_index").alias("_at"),
    )
    near = F.col("chunk_index").between(F.col("_at") - radius, F.col("_at") + radius)
    rows = drawers.select("id", "wing", "room", "content", "source_file", "chunk_index", "filed_at")
    return rows.join(hits, (F.col("source_file") == F.col("_file")) & near).drop(
        "_file", "_at"
    )


def recall_check(
    drawers: DataFrame, checks: list[dict], n: int, as_of: Column
) -> DataFrame:
    """One row per probe: rank of the expected source among its n best drawers."""
    asked = [q.sanitize(c["query"]) or c["query"] for c in checks]
    bonuses = [
        F.expr(f"{scoring.coding_boost(text, '_text', '_room')} + {scoring.preference_match(text, 'content', '_room')}")
        for text in asked
    ]
    pairs = bm25.multi_query_scores(
        drawers.select("id", "wing", "room", "content", "source_file", "filed_at"),
        [{**c, "query": text} for c, text in zip(checks, asked)], bonuses,
    )
    spark = drawers.sparkSession
    table = spark.createDataFrame(
        [(i, c["query"], c["expected_source"]) for i, c in enumerate(checks)],
        "probe int, query string, expected_source string",
    )
    top = pairs.groupBy("probe").agg(F.max("bm25").alias("_max"))
    combined = (
        F.when(F.col("_max") > 0, F.col("bm25") / F.col("_max")).otherwise(0.0) * fv.BM25_WEIGHT
        + F.col("bonus") + scoring.recency(F.col("filed_at"), as_of)
    )
    # One row per probe in ``top``: bounded by the literal list of checks.
    scored = computed(pairs.join(top, "probe"), {"combined": combined}).select(
        "probe", "id", "source_file", "filed_at", "combined"
    )
    order = Window.partitionBy("probe").orderBy(*_order())
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    found = ranked.join(table, "probe").groupBy("probe").agg(
        F.min(F.when(F.col("source_file") == F.col("expected_source"), F.col("rank"))).alias("rank"),
        F.min_by("source_file", "rank").alias("top_source"),
        F.min_by("combined", "rank").alias("top_similarity"),
    )
    return table.join(found, "probe", "left").select(
        "query", "expected_source", F.col("rank").isNotNull().alias("passed"), "rank",
        "top_source", round_to(F.col("top_similarity"), 3).alias("top_similarity"),
    )
