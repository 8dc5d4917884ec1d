"""What a search of a question table shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import batch_search, block_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawers(spark, count=400):
    rows = [(f"d{i}", f"wing_{i % 3}", f"room_{i % 2}", " ".join(f"w{(i * k) % 23}" for k in range(1, 4 + i % 9)), i) for i in range(count)]
    return spark.createDataFrame(rows, "id string, wing string, room string, content string, at long").withColumn("filed_at", F.timestamp_seconds("at")).withColumn("source_file", F.lit("f"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return block_index.BlockIndex.write(drawers(spark), str(tmp_path_factory.mktemp("index")))


def test_batch_keeps_ties_and_shuffles_no_scores_of_pairs(spark, index):
    asked = spark.createDataFrame([(1, "w3 w5"), (2, "w7"), (3, None)], "qid long, query string")
    found = batch_search.best_by_terms(index, asked, 4)
    assert "WindowGroupLimit" in plan(found)
    # Pairs of question and drawer are summed where their slot lies.
    assert not re.findall(r"Exchange hashpartitioning\(qid#\d+L?, doc#\d+L?, slot#\d+L?", plan(found))
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for qid, text in ((1, "w3 w5"), (2, "w7")):
        assert got[qid] == [r["id"] for r in block_index.search(index, text, 4).collect()]
    assert 3 not in got
