"""A recall check reads every text once."""

from pyspark.sql import functions as F

from mnemospark.operators import hybrid


def drawers(spark, count=400):
    rows = [(f"d{i}", f"wing_{i % 3}", f"room_{i % 2}", " ".join(f"w{(i * k) % 23}" for k in range(1, 4 + i % 9)), i) for i in range(count)]
    return spark.createDataFrame(rows, "id string, wing string, room string, content string, at long").withColumn("filed_at", F.timestamp_seconds("at")).withColumn("source_file", F.lit("f"))


def test_recall_check_reads_texts_once(spark):
    from pyspark.sql import types as T

    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.StringType())
    def read(text):
        seen.add(1)
        return text

    rows = drawers(spark, 50).select("id", "wing", "room", read("content").alias("content"), "source_file", "filed_at")
    checks = [{"query": "w3 w5", "expected_source": "f"}, {"query": "w7", "expected_source": "g", "wing": "wing_1"}, {"query": "?", "expected_source": "f"}]
    found = hybrid.recall_check(rows, checks, 3, F.timestamp_seconds(F.lit(1000)))
    passed = {r["query"]: (r["passed"], r["rank"], r["top_source"]) for r in found.collect()}
    assert passed == {"w3 w5": (True, 1, "f"), "w7": (False, None, "f"), "?": (False, None, None)}
    assert seen.value == 50


def test_recall_check_without_words(spark):
    found = hybrid.recall_check(drawers(spark, 5), [{"query": "?", "expected_source": "f"}], 3, F.timestamp_seconds(F.lit(0)))
    assert [(r["passed"], r["top_source"]) for r in found.collect()] == [(False, None)]
