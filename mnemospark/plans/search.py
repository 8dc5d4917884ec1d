"""Search pipelines.  The entry points differ only in the stages they run."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.operators import hybrid


@dataclass(frozen=True)
class Stages:
    rewrite: bool = True
    preferences: bool = True
    rerank: bool = False


TOOL = Stages()
FACADE = Stages(rewrite=False)
COMMAND_LINE = Stages(preferences=False)
LAYER = Stages(rewrite=False, preferences=False)


def effective_query(query: str, stages: Stages) -> str:
    text = q.rewrite(query) if stages.rewrite else query
    return q.sanitize(text) or query


def search(
    drawers: DataFrame,
    query: str,
    vector: Sequence[float] | None,
    n: int,
    as_of: Column,
    wing: str | None = None,
    room: str | None = None,
    stages: Stages = TOOL,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Best drawers for an effective query, best first."""
    found = hybrid.hybrid_search(drawers, query, vector, n, as_of, wing, room, index)
    if stages.preferences and vector is not None:
        found = hybrid.merge_preferences(found, drawers, vector, n, wing, room)
    return hybrid.rerank(found, query) if stages.rerank else found


def query_id(query: str, ids: list[str], epoch_seconds: int) -> str:
    bucket = epoch_seconds // fv.QUERY_ID_BUCKET_SECONDS
    digest = hashlib.sha256(f"{query}|{','.join(ids)}|{bucket}".encode()).hexdigest()
    return f"query_{digest[:16]}"
