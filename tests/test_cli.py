"""Commands, configuration and small helpers."""

import json

from pyspark.sql import functions as F

from mnemospark import __main__ as cli
from mnemospark.functions import text as t
from mnemospark.functions.embedding import HashingEmbedder
from mnemospark.operators import closets, kg, usage
from mnemospark.plans import tools
from mnemospark.plans.memory import Memory
from mnemospark.plans.store import conform
from mnemospark.sources import room_config


def test_commands(spark, tmp_path):
    project = tmp_path / "proj"
    project.mkdir()
    (project / "plan.md").write_text("The rail plan of this project is long enough to be filed as a chunk.")
    rooms = tmp_path / "rooms.json"
    rooms.write_text(json.dumps({"wing": "p", "rooms": [{"name": "plan", "keywords": ["rail"]}]}))
    m = Memory(spark, str(tmp_path / "store"), HashingEmbedder(32))

    def do(*argv):
        return cli.run(m, cli.parser().parse_args(["--store", "x", *argv]))

    assert do("mine", str(project), "--rooms", str(rooms), "--dry-run") == 1
    assert do("mine", str(project), "--rooms", str(rooms)) == 1
    assert do("mine", str(project), "--rooms", str(rooms)) == 0
    assert do("search", "rail plan")[0]["room"] == "plan"
    assert do("status")["total_drawers"] == 1
    assert do("wings")["wings"][0]["kind"] == "project"
    assert "rail plan" in do("wake-up") and "L2" in do("recall")
    assert do("timeline") == [] and do("prune", "400")["pruned"] == 0
    assert do("backfill-wings") == 0

    talk = tmp_path / "talk"
    talk.mkdir()
    (talk / "c.jsonl").write_text(
        '{"role":"user","content":"is the harbour closed on friday evening"}\n{"role":"assistant","content":"yes"}\n'
    )
    assert do("sweep", str(talk)) == 2
    assert do("mine-convos", str(talk), "Talk-1") == 0  # the file is known by now
    turns = spark.createDataFrame(
        [(1, 0, "user", "We decided on rail because of the tradeoff"), (1, 1, "assistant", "good approach"),
         (1, 2, "user", "And the second turn"), (1, 3, "assistant", "is kept as well")],
        "conv_id long, turn long, role string, text string",
    )
    assert m.ingest_turns(turns) == 3

    events = spark.createDataFrame(
        [(1, "search", "hit", 10, "w"), (2, "search", "miss", 30, None)],
        "id long, tool string, outcome string, duration_ms long, wing string",
    ).withColumns({
        "ts": m.now(), "session_id": F.lit("s"), "project": F.lit("p"), "meta": F.lit("{}"),
        "result_count": F.lit(1), "est_tokens_saved": F.lit(1234567),
    })
    m.store.append("usage_events", conform(events, "usage_events"))
    text = do("gain")
    assert "Hit rate           : 50%" in text and "~2,469,134" in text and "n/a" in text
    assert m.hook_stop({}) and not m.hook_stop({"stop_hook_active": True})
    told = tools.call(m, "gain", {"record": {"query_id": "q", "drawer_id": "d", "verdict": "useful"}})
    assert told["success"]
    assert "error" in tools.call(m, "gain", {"record": {"query_id": "q", "drawer_id": "d", "verdict": "bad"}})
    assert tools.call(m, "gain", {"reset": True, "project": "p"})["deleted"] == 2


def test_replace_fact(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "s"), HashingEmbedder(8))
    assert m.replace_fact("A", "uses", "X", "Y") == {"inserted": 1, "unchanged": 0, "invalidated": 0}
    assert m.replace_fact("A", "uses", "Y", "Z") == {"inserted": 1, "unchanged": 0, "invalidated": 1}
    assert m.replace_fact("A", "uses", "Z", "Z") == {"inserted": 0, "unchanged": 1, "invalidated": 0}


def test_profiles(spark):
    rows = [("Ann", "1990-01-01", "bob", None, ["rail"]), ("Cy", "", None, "dee", None)]
    df = spark.createDataFrame(rows, "name string, birthday string, parent string, partner string, interests array<string>")
    got = {(r["subject"], r["predicate"], r["object"], r["valid_from"]) for r in kg.facts_from_profiles(df).collect()}
    assert got == {
        ("Ann", "child_of", "Bob", "1990-01-01"), ("Ann", "loves", "Rail", "2025-01-01"), ("Cy", "married_to", "Dee", None)
    }


def test_closet_upsert(spark):
    rows = spark.createDataFrame([("w", "r", "t", ["a"])], "wing string, room string, topic string, pointer_drawer_ids array<string>")
    first = closets.closet_rows(rows)
    second = closets.closet_rows(rows.withColumn("pointer_drawer_ids", F.array(F.lit("b"), F.lit("c"))))
    assert closets.upsert(first, second).first()["pointer_drawer_ids"] == ["b", "c"]


def test_feedback_upsert_checks_verdicts(spark):
    schema = "query_id string, drawer_id string, verdict string, source string, note string, created_at timestamp"
    old = spark.createDataFrame([("q", "d", "useful", "explicit", None, None)], schema)
    new = spark.createDataFrame([("q", "d", "wrong_answer", "explicit", "n", None)], schema)
    assert [r["verdict"] for r in usage.upsert_feedback(old, new).collect()] == ["wrong_answer"]


def test_locales_and_config():
    assert t.locale("PT_br")["code"] == "pt-br" and t.locale("xx") is None
    assert len(t.supported_languages()) == 14
    config = room_config.parse(room_config.dump("w", [{"name": "a", "description": "", "keywords": ["k"]}]))
    assert config == {"wing": "w", "rooms": [{"name": "a", "description": "", "keywords": ["k"]}]}
