"""Members of hot groups are described once, not for the leader of each group, and texts are fetched without a shuffle."""

import random

from pyspark.sql import functions as F

from mnemospark.llm import jaccard_join


def test_a_leader_that_is_linked_with_another_gives_its_members_to_it(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(f"n{rng.randint(0, 10**9)}" if k == i else w for k, w in enumerate(base))) for i in range(12)]
    rows.append((50, " ".join(f"v{i}" for i in range(80))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = [(1, {i: 9 if i == 3 else 5 for i in range(8)}), (2, {5: 8, 6: 4, 7: 4, 8: 4, 9: 4}), (3, {50: 20, 10: 3, 11: 3})]
    members = spark.createDataFrame([(sig, a, h) for sig, of in groups for a, h in of.items()] + [(1, 5, 8)], "sig long, a long, h int").groupBy("sig", "a").agg(F.max("h").alias("h"))
    stars = jaccard_join.starred(members)
    assert {r["a"] for r in stars.collect()} == {3, 5, 50}
    sets = jaccard_join.sets_of(df, 4, stars)
    got = {tuple(r) for r in jaccard_join.gathered_stars(members, stars, sets, 85).collect()}
    assert got == {(3, i) for i in range(10) if i != 3} | {(50, 10), (50, 11)}


def test_the_last_hot_signatures_of_a_document_are_left_aside(spark):
    tag = 7 * jaccard_join.TAG + 3  # three signatures are shared at least
    hot = [(sig, doc, tag) for sig, members in ((10, range(4)), (11, range(5)), (12, range(6)), (13, range(7))) for doc in members]
    hot += [(20, 0, 8 * jaccard_join.TAG), (20, 1, 8 * jaccard_join.TAG)]  # no number is sure: all are kept
    kept = {tuple(r) for r in jaccard_join.least_hot(spark.createDataFrame(hot, "sig long, a long, ta int")).collect()}
    four = {(sig, doc, 4) for sig in (10, 11) for doc in range(4)}
    assert kept == four | {(11, 4, 3), (20, 0, 1), (20, 1, 1)}


def test_wanted_rows_are_never_lost(spark):
    df = spark.range(-5000, 5000).selectExpr("id * 7919 as doc_id", "cast(id as string) as text").union(spark.sql("select null, 'x'"))
    wanted = df.where("doc_id % 10 = 0").select("doc_id")
    ids = {r[0] for r in wanted.collect()}
    got = [r[0] for r in jaccard_join.perhaps_among(df, wanted).collect()]
    assert ids <= set(got) and len(got) == len(set(got)) < 2 * len(ids)
    assert jaccard_join.perhaps_among(df, wanted.limit(0)).count() == 0
