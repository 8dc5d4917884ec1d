"""Row-level writes: versions, conflicts, tombstones, compaction."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.plans.commits import ConflictError, RowTable, State

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("wing", T.StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return RowTable(spark, str(tmp_path / "t"), SCHEMA, "id", ["wing"])


def rows(spark, *pairs):
    return spark.createDataFrame([(i, n, f"w{n % 3}") for i, n in pairs], SCHEMA)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def held(table, state=None):
    return sorted((r["id"], r["n"]) for r in table.read(state).collect())


def test_empty_and_appended(spark, table):
    assert table.state() == State() and held(table) == []
    table.append(rows(spark, ("a", 1), ("b", 2)))
    table.append(rows(spark, ("c", 3)))
    assert held(table) == [("a", 1), ("b", 2), ("c", 3)]
    assert table.state().version == 2


def test_deleted_rows_can_come_back(spark, table):
    table.append(rows(spark, ("a", 1), ("b", 2)))
    old = table.state()
    table.delete(keys(spark, "a", "nowhere", None))
    assert held(table) == [("b", 2)]
    table.append(rows(spark, ("a", 9)))
    assert held(table) == [("a", 9), ("b", 2)]
    assert held(table, old) == [("a", 1), ("b", 2)]  # a reader keeps the version it began with


def test_update_replaces_whole_rows_once(spark, table):
    table.append(rows(spark, ("a", 1), ("b", 2), ("b", 3)))
    table.update(rows(spark, ("b", 7), ("new", 8)))
    assert held(table) == [("a", 1), ("b", 7), ("new", 8)]
    table.update(rows(spark, ("b", 70)))
    assert held(table) == [("a", 1), ("b", 70), ("new", 8)]
    assert table.read().where("wing = 'w1'").count() == 2


def test_an_append_during_a_delete_is_kept(spark, table):
    table.append(rows(spark, ("a", 1), ("b", 2)))
    write = table._write_keys

    def slow(found):
        name = write(found)
        table.append(rows(spark, ("c", 3)))  # another writer, after the keys are down and before the commit
        return name

    table._write_keys = slow
    table.delete(keys(spark, "a"))
    assert held(table) == [("b", 2), ("c", 3)]


def test_an_append_during_replace_and_compaction_is_kept(spark, table):
    table.append(rows(spark, ("a", 1)))
    base = table.state()
    table.append(rows(spark, ("b", 2)))
    table.replace(rows(spark, ("a", 10)), base)
    assert held(table) == [("a", 10), ("b", 2)]
    base = table.state()
    compacted = table.read(base)
    table.delete(keys(spark, "b"))
    table.replace(compacted, base)  # a compaction that a delete has overtaken
    assert held(table) == [("a", 10)]
    table.compact()
    assert held(table) == [("a", 10)] and len(table.state().data) == 1 and not table.state().deleted


def test_two_replacements_of_the_same_rows_conflict(spark, table):
    table.append(rows(spark, ("a", 1)))
    base = table.state()
    table.replace(rows(spark, ("a", 2)), base)
    with pytest.raises(ConflictError):
        table.replace(rows(spark, ("a", 3)), base)
    assert held(table) == [("a", 2)]


def test_a_version_has_one_writer(spark, table):
    results = []
    state = table.append(rows(spark, ("a", 1)))

    def put():
        results.append(table._put(State(state.version + 1, dict(state.data), {})))

    threads = [threading.Thread(target=put) for _ in range(2)]
    put()
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(results) == [False, False, True]


def test_new_rows_of_two_writers_are_filed_once(spark, table):
    table.append(rows(spark, ("a", 1)))

    def make(known):
        if "raced" not in seen:
            seen.append("raced")
            table.append(rows(spark, ("b", 5)))
        return rows(spark, ("a", 2), ("b", 6), ("c", 7)).join(known.select("id"), "id", "left_anti").select(*SCHEMA.names)

    seen = []
    assert table.append_new(make) == 1
    assert held(table) == [("a", 1), ("b", 5), ("c", 7)]


def test_a_job_that_dies_leaves_the_last_version(spark, table):
    table.append(rows(spark, ("a", 1)))
    table._write(rows(spark, ("lost", 0)))
    broken = rows(spark, ("x", 1)).withColumn("n", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        table.append(broken)
    assert held(table) == [("a", 1)]
