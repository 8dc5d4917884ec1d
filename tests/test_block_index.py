"""The stored index in blocks and the batch search against plain scans."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.operators import batch_search, block_index, bm25, hybrid

WORDS = ["rail", "cost", "ship", "label", "order", "printer", "archive", "game", "failed", "prefer"] + [f"w{i}" for i in range(120)]


def texts(count, seed):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(f"d{i:04d}", f"wing_{i % 3}", f"room_{i % 2}", " ".join(rng.choices(WORDS, weights, k=rng.choice([2, 9, 60]))) if i % 17 else "rail cost", i)
            for i in range(count)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, wing string, room string, content string, at long").withColumn("filed_at", F.timestamp_seconds("at")).withColumn("source_file", F.lit("f"))


def plain(rows, query, n, keep=lambda r: True):
    tokens = {r[0]: Counter(re.findall(r"\w{2,}", r[3].lower())) for r in rows}
    size = {i: sum(c.values()) for i, c in tokens.items()}
    average = sum(size.values()) / len(size)
    terms = set(re.findall(r"\w{2,}", query.lower()))
    df = {t: sum(t in c for c in tokens.values()) for t in terms}
    scored = []
    for r in rows:
        c = tokens[r[0]]
        s = sum(math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[r[0]] / average)) for t in terms if c[t])
        if s and keep(r):
            scored.append((-round(s, 9), -r[4], r[0]))
    return [(i, round(-s, 6)) for s, _, i in sorted(scored)[:n]]


@pytest.fixture(scope="module")
def rows():
    return texts(1500, 1)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return block_index.BlockIndex.write(frame(spark, rows), str(tmp_path_factory.mktemp("index")))


QUERIES = ["rail cost", "w100 w7 order", "order", "w119", "nothing here at all", "", "printer label archive game w3 w60"]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("n", [1, 7])
def test_search_equals_a_scan(index, rows, query, n):
    got = [(r["id"], round(r["bm25"], 6)) for r in block_index.search(index, query, n).collect()]
    assert got == plain(rows, query, n)


def test_filtered_search_keeps_the_statistics_of_all(index, rows):
    got = [(r["id"], round(r["bm25"], 6)) for r in block_index.search(index, "rail w50 order", 9, "wing_1", "room_0").collect()]
    assert got == plain(rows, "rail w50 order", 9, lambda r: r[1] == "wing_1" and r[2] == "room_0")


def test_slots_out_of_reach_stay_unread(index):
    asked = block_index.Search(index, "w119 w118 order")
    least = asked.reached(3)
    assert least > 0
    every, opened = asked.heads.select("slot").distinct().count(), asked.open_slots(least).count()
    assert opened < every


def test_removed_drawers_are_gone_from_results_and_statistics(spark, index, rows):
    gone = {r[0] for r in rows if r[4] % 5 == 0} | {"d0017"}
    left = block_index.without(index, spark.createDataFrame([(i,) for i in gone], "id string"))
    kept = [r for r in rows if r[0] not in gone]
    for query in QUERIES[:4]:
        got = [(r["id"], round(r["bm25"], 6)) for r in block_index.search(left, query, 5).collect()]
        assert got == plain(kept, query, 5)


@pytest.mark.parametrize("query, n", [("rail cost order", 3), ("w100 prefer", 5), ("zzz", 4), ("why was rail chosen, cost", 2)])
def test_hybrid_over_blocks_equals_the_scan(spark, index, rows, query, n):
    drawers = frame(spark, rows).withColumn("chunk_index", F.col("at") % 4).withColumn(
        "embedding", F.when(F.col("at") % 3 == 0, F.array(*(F.sin(F.col("at") * k).cast("float") for k in range(1, 5)))))
    as_of = F.timestamp_seconds(F.lit(2000))
    for vector in ([0.5, -0.2, 0.1, 0.9], None):
        for where in ({}, {"wing": "wing_2"}):
            got, want = (
                [(r["id"], round(r["combined"], 6), round(r["bm25"], 6)) for r in hybrid.hybrid_search(drawers, query, vector, n, as_of, index=i, **where).collect()]
                for i in (index, None)
            )
            assert got == want


def test_batch_equals_single_searches(spark, index, rows):
    asked = [(i, q) for i, q in enumerate(QUERIES)] + [(90, None), (91, "rail cost")]
    table = spark.createDataFrame(asked, "qid long, query string")
    found = {}
    for r in batch_search.best_by_terms(index, table, 5).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append((r["id"], round(r["bm25"], 6)))
    assert found == {i: want for i, q in asked if (want := plain(rows, q or "", 5))}


def test_batch_ranks_as_hybrid_search_without_a_vector(spark, index, rows):
    drawers = frame(spark, rows).withColumn("chunk_index", F.lit(0))
    as_of = F.timestamp_seconds(F.lit(90_000))
    queries = ["why did we choose rail for cost", "what do i prefer for order", "run the test of label", "archive game"]
    table = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    found = batch_search.search_all(index, drawers, table, 4, as_of).orderBy("qid", "rank").collect()
    for i, text in enumerate(queries):
        want = hybrid.hybrid_search(drawers, text, None, 4, as_of).collect()
        assert [(r["id"], round(r["combined"], 6)) for r in found if r["qid"] == i] == [(r["id"], round(r["combined"], 6)) for r in want]
    checked = batch_search.recall(batch_search.search_all(index, drawers, table, 4, as_of), table, F.col("content").contains("prefer")).collect()
    assert {r["qid"] for r in checked} == {0, 1, 2, 3} and all(r["passed"] == (r["rank"] is not None) for r in checked)


def test_empty_index(spark, tmp_path):
    index = block_index.BlockIndex.write(frame(spark, []), str(tmp_path))
    assert block_index.search(index, "rail", 3).collect() == []
    assert batch_search.best_by_terms(index, spark.createDataFrame([(1, "rail")], "qid long, query string"), 3).collect() == []
    assert fv.BM25_WEIGHT > 0 and bm25.query_terms("") == []
