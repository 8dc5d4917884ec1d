"""Cosine search over an ``embedding`` column.

Vectors go to Arrow-batched numpy: array lambdas in the JVM are interpreted and
box every float, while one matrix product per batch does not.  Sums are in double.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.columns import round_to
from mnemospark.operators.bm25 import narrow


def _cosines(vectors, query: np.ndarray) -> np.ndarray:
    """Cosine of each Arrow list against the query; 0 where a norm is 0."""
    size = len(query)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == size).all():
        matrix = flat.reshape(len(lengths), size)
        dots, norms = matrix @ query, np.sqrt((matrix * matrix).sum(axis=1))
    else:  # damaged vectors of another length: pair up what there is
        ends = np.cumsum(lengths.astype(np.int64))
        rows = [flat[e - int(n): e] for e, n in zip(ends, lengths)]
        dots = np.array([r[:size] @ query[: len(r)] for r in rows], dtype=np.float64)
        norms = np.array([np.sqrt(r @ r) for r in rows], dtype=np.float64)
    scale = norms * np.sqrt(query @ query)
    return np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)


def cosine_to(vector: Sequence[float], embedding: Column) -> Column:
    """Cosine between a literal query vector and a non-null embedding column."""
    query = np.asarray(vector, dtype=np.float64)

    @F.arrow_udf("double")
    def cosine(batch: pa.Array) -> pa.Array:
        return pa.array(_cosines(batch, query))

    return cosine(embedding)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("similarity"), F.desc("filed_at"), "id").limit(k)


def _scored(
    drawers: DataFrame, vector: Sequence[float], wing: str | None, room: str | None
) -> DataFrame:
    rows = narrow(drawers, wing, room).filter(F.col("embedding").isNotNull())
    keep = ["id", "wing", "room", "source_file", "filed_at"]
    return rows.select(
        *keep, round_to(cosine_to(vector, F.col("embedding")), 3).alias("similarity")
    )


def vector_top_k(
    drawers: DataFrame,
    vector: Sequence[float],
    k: int,
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    """(id, wing, room, source_file, filed_at, similarity) of the k nearest drawers.

    Text stays out of the scan; callers join it to the k rows.
    """
    return _ranked(_scored(drawers, vector, wing, room), k)


def preference_top_k(
    drawers: DataFrame,
    vector: Sequence[float],
    k: int,
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    """The k nearest preference-tagged drawers, by the preference vector if any."""
    best = F.coalesce("pref_embedding", "embedding")
    rows = narrow(drawers, wing, room).filter(F.col("is_preference") & best.isNotNull())
    keep = ["id", "wing", "room", "source_file", "filed_at"]
    scored = rows.select(*keep, best.alias("_v")).select(
        *keep, round_to(cosine_to(vector, F.col("_v")), 3).alias("similarity")
    )
    return _ranked(scored, k)


def check_duplicate(
    drawers: DataFrame,
    vector: Sequence[float],
    threshold: float = fv.DUPLICATE_THRESHOLD,
    wing: str | None = None,
    room: str | None = None,
    limit: int | None = fv.DUPLICATE_POOL,
) -> DataFrame:
    """Drawers at or over the threshold: the ``limit`` nearest of them (None: all, in no order)."""
    same = _scored(drawers, vector, wing, room).filter(F.col("similarity") >= threshold)
    return same if limit is None else _ranked(same, limit)


def unembedded(drawers: DataFrame) -> DataFrame:
    return drawers.filter(F.col("embedding").isNull()).select("id", "content", "filed_at")


def corrupted(drawers: DataFrame, dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    bad = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
    return drawers.filter(bad).select("id", F.size("embedding").alias("dim"))
