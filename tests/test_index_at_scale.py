"""What building and searching the stored index shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import block_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawers(spark, count=400):
    rows = [(f"d{i}", f"wing_{i % 3}", f"room_{i % 2}", " ".join(f"w{(i * k) % 23}" for k in range(1, 4 + i % 9)), i) for i in range(count)]
    return spark.createDataFrame(rows, "id string, wing string, room string, content string, at long").withColumn("filed_at", F.timestamp_seconds("at")).withColumn("source_file", F.lit("f"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return block_index.BlockIndex.write(drawers(spark), str(tmp_path_factory.mktemp("index")))


def test_texts_are_numbered_without_a_shuffle(spark):
    assert "Exchange" not in plan(block_index.numbered(drawers(spark)))


def test_postings_are_shuffled_once(spark, index):
    assert len(re.findall(r"\bExchange (?:range|hash)partitioning", plan(block_index.blocks_of(index.docs)))) == 1


def test_slots_hold_neighbours_by_length(index):
    sizes = index.docs.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 1 << block_index.SLOT_BITS
    assert index.docs.count() == index.docs.select("doc").distinct().count() == 400


def test_search_ranks_no_whole_table_in_one_task(index):
    found = block_index.Search(index, "w3 w5").top(4)
    assert "Window" not in plan(found) and len(found.collect()) == 4
