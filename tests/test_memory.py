"""The store, the handle and the tools end to end on a small store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.functions.embedding import HashingEmbedder
from mnemospark.operators import bm25, hybrid, kg, ordered, rooms, usage, vectors
from mnemospark.plans import search, tools
from mnemospark.plans.memory import Memory
from mnemospark.plans.store import Store
from mnemospark.streaming import watch

NOW = dt.datetime(2025, 3, 1, 12, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("store")), HashingEmbedder(64), clock=lambda: NOW)
    base = [
        ("ship", "decisions", "We decided to ship by rail because the tradeoff was cost"),
        ("ship", "preferences", "I prefer small parcels. Nothing else matters"),
        ("desk", "problems", "The printer failed twice, root cause was a broken cable"),
        ("desk", "decisions", "We chose sqlite rather than files for the database"),
    ]
    rows = spark.createDataFrame([(f"d{i}", *r, "f.md", i) for i, r in enumerate(base)],
        "id string, wing string, room string, content string, source_file string, chunk_index long")
    full = rows.withColumns({"added_by": F.lit("t"), "filed_at": m.now(), "importance": F.lit(3.0)})
    assert m.add_drawers(full.unionByName(full)) == 4
    assert m.add_drawers(full) == 0
    return m


def test_enriched_columns(memory):
    rows = {r["id"]: r for r in memory.drawers().collect()}
    assert rows["d1"]["is_preference"] and '"preference_span":"I prefer small parcels."' in rows["d1"]["metadata"]
    assert rows["d1"]["pref_embedding"] is not None and rows["d0"]["pref_embedding"] is None
    assert rows["d3"]["hall"] == "technical"


def test_index_and_text_rank_alike(memory):
    rows, index = memory.drawers(), memory.store.index()
    plain = bm25.bm25_search(rows, "rail cost decided", 5).select("id", F.round("bm25", 9)).collect()
    scored = bm25.score_postings(*index, "rail cost decided")
    stored = {r["drawer_id"]: round(r["bm25"], 9) for r in scored.collect()}
    assert {r[0]: r[1] for r in plain} == stored


@pytest.mark.parametrize("query", ["rail cost", "what do i prefer", "why database chose", "printer", "zzz"])
@pytest.mark.parametrize("n", [1, 2, 10])
def test_indexed_hybrid_equals_the_scan(memory, query, n):
    vec, rows = memory.embedder.one(query), memory.drawers()
    found = [
        [(r["id"], round(r["combined"], 9)) for r in hybrid.hybrid_search(
            rows, query, v, n, memory.now(), index=i).collect()]
        for v in (vec, None) for i in (None, memory.store.index())
    ]
    assert found[0] == found[1] and found[2] == found[3]


def test_search_stages(memory):
    top = memory.search("why did we ship by rail", 2).collect()
    assert top[0]["id"] == "d0"
    ids = [r["id"] for r in memory.search("small parcels preference", 3, stages=search.TOOL).collect()]
    assert "d1" in ids
    assert {r["id"] for r in memory.search("rail", 4, "desk").collect()} <= {"d2", "d3"}
    near = [r["id"] for r in memory.drawer_grep("ship by rail cost", 1).collect()]
    assert near == ["d0", "d1"]


def test_tool_calls_are_recorded(memory):
    before = tools.call(memory, "gain")["tool_calls"]
    tools.call(memory, "search", {"query": "which cable did the printer need?"})
    tools.call(memory, "search", {"query": "which cable did the printer need?"})
    tools.call(memory, "search", {})
    after = tools.call(memory, "gain")
    assert after["tool_calls"] == before + 3
    seen = memory.store.read("usage_events").filter("tool = 'search' and outcome in ('hit', 'miss')")
    assert seen.filter("get_json_object(meta, '$.is_repeat') = 'true'").count() >= 1


def test_tools(memory):
    out = tools.call(memory, "search", {"query": "why did we ship by rail?", "limit": 2, "rerank": True})
    # The rewrite strips "why did", so the intent is no longer a decision.
    assert out["results"][0]["id"] == "d0" and out["intent"] == "unknown"
    assert [c["id"] for c in out["results"][0]["source_context"]] == ["d0", "d1"]
    same = tools.call(memory, "check_duplicate", {"content": "We decided to ship by rail because the tradeoff was cost"})
    assert same["is_duplicate"]
    assert tools.call(memory, "search", {}) == {"error": "query is required"}
    assert tools.call(memory, "status")["total_drawers"] == 4
    check = tools.call(memory, "recall_check", {"checks": [{"query": "printer cable", "expected_source": "f.md"}]})
    assert check["ok"] and check["checks"][0]["rank"] == 1
    assert "[decisions]" in memory.wake_up() and "L2" in memory.recall("ship") and "d" in memory.search_text("rail")
    assert tools.call(memory, "create_wing", {"name": " My Wing! "})["wing"]["name"] == "my_wing"
    assert tools.call(memory, "verify")["ok"]


def test_diary_and_hooks(memory):
    first = tools.call(memory, "diary_write", {"agent_name": "Ann B", "entry": "Looked at drawer_1 and the rail plan", "project_path": "/p/ship"})
    assert first["success"]
    again = tools.call(memory, "diary_write", {"agent_name": "Ann B", "entry": "Looked at drawer_1 and the rail plan"})
    assert again["reason"] == "duplicate"
    assert tools.call(memory, "list_agents") == {"agents": ["ann_b"]}
    assert tools.call(memory, "session_context", {"agent_name": "other"})["cross_agent"]
    found = tools.call(memory, "diary_search", {"agent_name": "x", "query": "rail plan", "all_agents": True, "project_path": "/p/ship"})
    assert len(found["results"]) == 1
    assert "rail" in memory.hook_recall({"tool_input": {"pattern": "ship by rail decided"}})
    assert memory.hook_recall({"tool_input": {"content": "x"}}) is None
    assert "Recent diary" in memory.hook_session_start("/p/ship")


def test_writes(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "s"), HashingEmbedder(32), clock=lambda: NOW)
    kept = tools.call(m, "remember", {"text": "Rail is cheap in winter"})
    assert kept["inserted"] and not tools.call(m, "remember", {"text": "Rail is cheap in winter"})["inserted"]
    other = tools.call(m, "remember", {"text": "Harbours close early on friday evening"})
    assert other["inserted"]
    assert tools.call(m, "update_drawer", {"drawer_id": kept["id"], "content": "I prefer boats"})["success"]
    assert bm25.score_postings(*m.store.index(), "winter").count() == 0
    assert m.search("boats", 1).first()["id"] == kept["id"]
    m.export(str(tmp_path / "out"))
    n = Memory(spark, str(tmp_path / "t"), HashingEmbedder(32), clock=lambda: NOW)
    assert n.import_from(str(tmp_path / "out")) == 2 and n.import_from(str(tmp_path / "out")) == 0
    assert tools.call(m, "forget", {"id": kept["id"]})["success"] and m.drawers().count() == 1
    assert tools.call(m, "prune", {"older_than_days": 0}).get("error")
    assert tools.call(m, "upgrade_embeddings", {"refresh_preferences": True})["reembedded"] == 1
    tools.call(m, "create_tunnel", {"wing_a": "A", "room_a": "r", "wing_b": "B", "room_b": "s"})
    assert len(tools.call(m, "follow_tunnels", {"wing": "b", "room": "s"})["tunnels"]) == 1


def test_graph(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "g"), HashingEmbedder(16), clock=lambda: NOW)
    fact = {"subject": "Ann O'Neil", "predicate": "works at", "object": "Dock 1"}
    for _ in range(2):
        tools.call(m, "kg_add", {**fact, "valid_from": "2024"})
    assert tools.call(m, "kg_stats")["triples"] == 1
    tools.call(m, "kg_invalidate", {**fact, "ended": "2025-02-01"})
    tools.call(m, "kg_add", {**fact, "object": "Dock 2", "valid_from": "2025-02-01"})
    ask = {"entity": "ann o'neil", "as_of": "2025-02-01"}
    assert tools.call(m, "kg_query", ask)["count"] == 2  # both ends of an interval count
    assert tools.call(m, "kg_query", {**ask, "as_of": "2024-01-01"})["count"] == 1  # text order
    assert tools.call(m, "conflicts")["count"] == 1
    assert kg.conflict_groups(m.store.read("triples"), m.store.read("entities"), current_only=True).count() == 0
    assert m.seed_facts([("A", "b", "C"), ("A", "b", "D")])["inserted"] == 2
    assert m.seed_facts([("A", "b", "C")])["unchanged"] == 1


def test_percentile_takes_the_upper_element(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long")
    got = usage.percentiles(df.withColumn("g", F.lit(1)), ["g"], "v", {"p50": 50, "p95": 95}).first()
    assert (got["p50"], got["p95"]) == (3, 4)


def test_windows():
    assert usage.parse_window("7d") == dt.timedelta(days=7) and usage.parse_window("ALL") is None
    assert usage.window_label("24h") == "last 24h"
    for bad in ("", "7", "0d", "-1h", "7w"):
        with pytest.raises(ValueError):
            usage.parse_window(bad)


def test_neighbour_equals_a_plain_window(spark):
    from pyspark.sql import Window

    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 50).alias("v"))
    rows = rows.filter("o % 11 <> 0").withColumn("b", F.floor(F.col("o") / 40))
    w = Window.partitionBy("k").orderBy("o")
    for step, fn in ((-1, F.lag), (1, F.lead)):
        want = {r["o"]: r["x"] for r in rows.withColumn("x", fn("v").over(w)).collect()}
        got = {r["o"]: r["v_near"] for r in ordered.neighbour(rows, ["k"], "b", ["o"], ["v"], step).collect()}
        assert got == want


def test_walk_is_bounded_and_finds_parents(spark):
    rows = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "9"), ("general", "1")]
    seen = spark.createDataFrame([(r, w, "2024-01-01") for r, w in rows], "room string, wing string, day string")
    walk = {r["room"]: (r["hop"], r["via_room"]) for r in rooms.traverse(seen, "a", 2).collect()}
    assert walk == {"a": (0, None), "b": (1, "a"), "c": (2, "b")}
    assert rooms.traverse(seen, "zz", 2).count() == 0


def test_deep_walk_with_checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(f"r{i}", f"w{j}", "2024-01-01") for i in range(9) for j in (i, i + 1)]
    seen = spark.createDataFrame(rows, "room string, wing string, day string")
    walk = {r["room"]: r["hop"] for r in rooms.traverse(seen, "r0", 20).collect()}
    assert walk == {f"r{i}": i for i in range(9)}


def test_damaged_vectors(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None), ("e", [1.0, 1.0])], "id string, embedding array<float>"
    ).withColumns({c: F.lit("x") for c in ("wing", "room", "source_file")}).withColumn("filed_at", F.lit(0))
    got = {r["id"]: r["similarity"] for r in vectors.vector_top_k(df, [1.0, 0.0], 9).collect()}
    assert got == {"a": 1.0, "c": 1.0, "e": 0.707, "b": 0.0}


# ------------------------------------------------------------------- streams
def test_watch_equals_batch_and_survives_replay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.md").write_text("First note about rail freight and its cost. " * 30)
    store = Store(spark, str(tmp_path / "store"))
    args = (spark, store, str(folder), "w", [])
    watch.watch_folder(*args, str(tmp_path / "cp"), once=True).awaitTermination()
    first = store.read("drawers").count()
    assert first == 2
    (folder / "two.md").write_text("Second note about boats, long enough to be kept as a chunk.")
    watch.watch_folder(*args, str(tmp_path / "cp"), once=True).awaitTermination()
    assert store.read("drawers").count() == first + 1
    watch.watch_folder(*args, str(tmp_path / "cp2"), once=True).awaitTermination()
    assert store.read("drawers").count() == first + 1
    assert store.read("doc_stats").count() == first + 1


def test_usage_stream_flags_repeats(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [(1, "2025-03-01T00:00:00Z", "q1"), (2, "2025-03-01T10:00:00Z", "q1"), (3, "2025-03-03T00:00:00Z", "q1"), (4, "2025-03-01T11:00:00Z", "q2")]
    df = spark.createDataFrame(rows, "id long, ts string, query_hash string").withColumn("meta", F.lit("{}")).withColumn("tool", F.lit("search"))
    df.coalesce(1).write.json(str(src))
    store = Store(spark, str(tmp_path / "st"))
    stream = watch.usage_events_stream(spark, str(src))
    watch.record_usage(stream, store, str(tmp_path / "c1"), once=True).awaitTermination()
    watch.record_usage(stream, store, str(tmp_path / "c2"), once=True).awaitTermination()
    got = {r["id"]: r["meta"] for r in store.read("usage_events").collect()}
    assert got == {1: "{}", 2: '{"is_repeat":true}', 3: "{}", 4: "{}"}
    first = watch.first_asked(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    first.awaitTermination()
    assert spark.table("firsts").select("query_hash").distinct().count() == 2
