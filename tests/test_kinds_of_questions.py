"""Questions that differ in rare words only are searched together, with the results of searching each."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import batch_search, block_index

TEXTS = [
    "run cargo test before order {n} leaves", "Noted for order {n}. I prefer rail handling. We never use labels!",
    "My convention is to always use tabs {n}7 here. Orders like {n} must wait.", "order a{n} and 9{n} failed, the root cause of bug {n}1",
    "RUN cargo test before order {n}5!", "what do i prefer for order {n} handling?", "{n} was the last order of cargo run cargo test before order {n}{n}",
    "We decided to ship by rail because of cost {n}", "design of the database, order {n} by rail", "never prefer x{n}y handling of order",
    "ship {n}3 by rail", "12{n} by rail {n}", "a\\Eb order {n}",
]
ASKED = [
    "run cargo test before order {n}", "what do i prefer for order {n} handling?", "do i prefer tabs {n}", "{n} by rail", "{n} order {m}",
    "root cause of bug {n}", "a\\Eb order {n}",
]


def drawers(spark, count=390):
    rows = [
        (f"d{i}", f"wing_{i % 3}", ["preferences", "decisions", "commands", "general"][i % 4], TEXTS[i % len(TEXTS)].format(n=10 + i * 37 % 1999), i * 30_000 if i % 17 else None)
        for i in range(count)
    ]
    frame = spark.createDataFrame(rows, "id string, wing string, room string, content string, at long")
    return frame.withColumn("filed_at", F.timestamp_seconds("at")).withColumn("source_file", F.lit("f"))


def questions(spark, each=60):
    rows = [(k * 1000 + i, text.format(n=10 + i * 7, m=500 + i)) for k, text in enumerate(ASKED) for i in range(each)]
    rows += [(9001, "run cargo test"), (9002, None), (None, "order by rail 12"), (9003, "order 44 by rail"), (9003, "order 44 by rail"), (9004, "wholly other words")]
    return spark.createDataFrame(rows, "qid long, query string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return block_index.BlockIndex.write(drawers(spark), str(tmp_path_factory.mktemp("index")))


def rounded(found):
    names = ["qid", "rank", "id", "bm25", "coding_boost", "preference_match", "combined", "query", "content", "source_file"]
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in found.select(*names).collect())


def test_kinds_return_what_each_question_alone_does(spark, index):
    asked, at = questions(spark), F.timestamp_seconds(F.lit(12_000_000))
    assert batch_search.kinds(asked).select("kind").distinct().count() >= len(ASKED) - 1
    got = rounded(batch_search.search_all(index, drawers(spark), asked, 3, at))
    assert got == rounded(batch_search.search_each(index, drawers(spark), asked, 3, at))
    assert len({r[0] for r in got}) > 300


def test_pairs_do_not_grow_with_questions_times_drawers(spark, index, monkeypatch):
    """Scores by shared words are summed once a kind, so their rows stay the same for twice the questions."""
    seen, plain = [], batch_search.reaching

    def counted(*args):
        found = plain(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(batch_search, "reaching", counted)
    totals = []
    for each in (30, 60):
        asked = questions(spark, each).where("qid < 1000")
        batch_search.search_all(index, drawers(spark), asked, 3, F.timestamp_seconds(F.lit(12_000_000))).count()
        totals.append(sum(seen))
        seen.clear()
    assert totals[0] == totals[1] <= 2 * 390
