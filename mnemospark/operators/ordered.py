"""Neighbour lookups that stay distributed when one key holds most rows.

A plain ``lag`` over a key sorts that whole key in one task.  Here rows are
windowed per (key, bucket) and only one edge row per bucket is ordered per key,
so the work of a hot key spreads over its buckets and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[str],
    values: list[str],
    step: int,
) -> DataFrame:
    """Adds ``<value>_near``: the value of the row before (step=-1) or after (+1).

    ``bucket`` must be non-decreasing in ``order`` within a key.
    """
    back = step < 0
    sort = [F.desc(c) for c in order] if not back else [F.asc(c) for c in order]
    local = Window.partitionBy(*keys, bucket).orderBy(*sort)
    carried = F.struct(*values)
    inner = df.withColumns(
        {"_near": F.lag(carried).over(local), "_pos": F.row_number().over(local)}
    )
    pick = F.max_by if back else F.min_by
    edges = df.groupBy(*keys, bucket).agg(pick(carried, F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(F.asc(bucket) if back else F.desc(bucket))
    outer = edges.select(*keys, bucket, F.lag("_edge").over(across).alias("_outer"))
    joined = inner.join(outer, [*keys, bucket], "left")
    near = F.when(F.col("_pos") == 1, F.col("_outer")).otherwise(F.col("_near"))
    out = joined.withColumn("_n", near)
    return out.withColumns({f"{v}_near": F.col("_n")[v] for v in values}).drop(
        "_near", "_pos", "_outer", "_n"
    )
