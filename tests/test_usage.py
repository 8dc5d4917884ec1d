"""Exact quantiles by ranges against the sorted values."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import usage

POINTS = {"p0": 0, "p50": 50, "p95": 95, "p100": 100}


def by_order(values):
    ranked = sorted(values, key=lambda v: (v is not None, v))
    found = {"calls": len(values)}
    for name, p in POINTS.items():
        at = -(-(len(values) - 1) * p // 100)
        found[name] = next((v for v in ranked[at:] if v is not None), None)
    return found


RNG = random.Random(6)
CASES = [
    [5],
    [None],
    [None, None, 3],
    [7] * 40 + [RNG.randrange(100) for _ in range(60)],
    [RNG.randrange(-(10**6), 10**6) for _ in range(300)] + [None] * 30,
    [-(2**63), 2**63 - 1, 0, 1],
    [RNG.choice([0, 1, 2, 10**12, 10**15]) for _ in range(99)],
]


@pytest.mark.parametrize("values", CASES)
def test_points_equal_the_sorted_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "d long")
    assert usage.exact_points(df, "d", POINTS, ranges=8) == by_order(values)


def test_points_equal_percentiles_and_need_no_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1013).alias("duration_ms"), F.lit("t").alias("tool"))
    one = usage.tool_latency(df).drop("tool").first()
    all_ = usage.overall_latency(df)
    assert tuple(all_.first()) == tuple(one)
    assert usage.overall_latency(df.limit(0)).collect() == []
