"""Duplicate checks over more equal vectors than a result holds."""

import datetime

from mnemospark.operators import vectors

SCHEMA = "id string, wing string, room string, source_file string, filed_at timestamp, embedding array<double>"


def test_every_duplicate_is_found_without_a_limit(spark):
    day = datetime.datetime(2026, 1, 1)
    rows = [(f"d{i}", "w", "r", "f", day, [1.0, 0.0]) for i in range(12)] + [("far", "w", "r", "f", day, [0.0, 1.0])]
    drawers = spark.createDataFrame(rows, SCHEMA)
    found = vectors.check_duplicate(drawers, [2.0, 0.0], 0.9, limit=None).collect()
    assert {r["id"] for r in found} == {f"d{i}" for i in range(12)}
    assert vectors.check_duplicate(drawers, [2.0, 0.0], 0.9).count() == 5
    assert vectors.check_duplicate(drawers, [2.0, 0.0], 0.9, limit=7).count() == 7
