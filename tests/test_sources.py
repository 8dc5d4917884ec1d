"""Files, chat exports, logs."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.plans import ingest
from mnemospark.sources import chats, files, transcripts
from tests import plain_chats

WANT = "> hi there\nhello you\n"


def lines(*records):
    return "\n".join(json.dumps(r) for r in records)


@pytest.mark.parametrize(
    "name, content, want",
    [
        (
            "session lines",
            lines(
                {"type": "user", "message": {"content": "hi there"}},
                {"type": "assistant", "message": {"content": [{"type": "text", "text": "hello you"}, {"type": "tool"}]}},
            ),
            WANT,
        ),
        (
            "event lines",
            lines(
                {"type": "session_meta"},
                {"type": "event_msg", "payload": {"type": "user_message", "message": "hi there"}},
                {"type": "event_msg", "payload": {"type": "agent_message", "message": "hello you"}},
            ),
            WANT,
        ),
        ("list", json.dumps({"messages": [{"role": "human", "content": "hi there"}, {"role": "ai", "content": {"text": "hello you"}}]}), WANT),
        (
            "privacy list",
            json.dumps([{"chat_messages": [{"role": "user", "content": "hi there"}, {"role": "assistant", "content": "hello you"}]}]),
            WANT,
        ),
        (
            "tree with a cycle",
            json.dumps({"mapping": {
                "r": {"parent": None, "children": ["a"]},
                "a": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["hi there"]}}, "children": ["b"]},
                "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["hello", "you"]}}, "children": ["a"]},
            }}),
            WANT,
        ),
        (
            "channel",
            json.dumps([
                {"type": "message", "user": "u1", "text": "hi there"},
                {"type": "join", "user": "u9"},
                {"type": "message", "user": "u2", "text": "hello you"},
            ]),
            WANT,
        ),
        ("broken", '{"type": "user"', '{"type": "user"'),
        ("no header", lines({"type": "event_msg", "payload": {"type": "user_message", "message": "x"}}), None),
        ("quoted already", "> a\n> b\n> c", "> a\n> b\n> c"),
    ],
)
def test_normalize(spark, name, content, want):
    want = content if want is None else want
    assert plain_chats.normalize(content, "json" if "quoted" not in name else "md") == want
    df = spark.createDataFrame([(content,)], "s string")
    got = chats.normalized(df, "s", F.lit("json" if "quoted" not in name else "md")).first()[0]
    assert got == want


def test_transcript_blocks(spark):
    turns = [("assistant", "a0"), ("user", "q1"), ("user", "q2"), ("assistant", "a2"), ("assistant", "a3")]
    want = "a0\n\n> q1\n\n> q2\na2\n\na3\n"
    assert plain_chats.transcript(turns) == want
    assert spark.createDataFrame([(turns,)], f"t {chats.TURNS}").select(chats.transcript(F.col("t"))).first()[0] == want


def mixed_up(rng, kind):
    """A JSON value near the shapes of exports, whole or damaged; most are of the kind."""
    said = rng.choice(["hi", "yo", "well"] * 6 + ["hi", " padded\t", "", 5, None, {"text": "in object"}, {"text": 1}, [{"type": "text", "text": "a"}, "b", {"type": "x", "text": "c"}, 7]])
    role = rng.choice(["user", "assistant"] * 5 + ["human", "ai", "system", 3, None])
    values = [
        {"type": role, "message": {"content": said}}, {"type": "session_meta"},
        {"type": "event_msg", "payload": {"type": rng.choice(["user_message", "agent_message", "x"]), "message": said}},
        {"role": role, "content": said}, {"role": role, "content": said},
        {"type": "message", "user": rng.choice(["u1", "u2", "u3", None]), "text": said}, {"type": "message", "username": "u4", "text": said},
        {"chat_messages": [{"role": "user", "content": said}, {"role": role, "content": "x"}]}, role, [],
    ]
    return values[kind if rng.random() < 0.8 else rng.randrange(len(values))]


def test_expressions_read_like_the_plain_parser(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "plain", "null", "[]", "{}", "[1, 2]", "not json {", '{"messages": null}', "> a\n> b\n> c\n{}"]
    for _ in range(800):
        kind = rng.randrange(9)
        items = [mixed_up(rng, kind) for _ in range(rng.randrange(1, 9))]
        shape = rng.randrange(6)
        if shape == 0:
            texts.append(lines(*items))
        elif shape == 1:
            texts.append(lines({"type": "session_meta"}, *(i for i in items if isinstance(i, dict) and "type" in i)))
        elif shape == 2:
            texts.append(json.dumps({rng.choice(["messages", "chat_messages", "other"]): items}))
        elif shape == 3:
            nodes = {f"n{k}": {"parent": None if k == 0 else f"n{k - 1}", "children": [f"n{(k + 1) % 5}"], **({"message": rng.choice([None, 4, {"author": {"role": rng.choice(["user", "assistant", "tool"])}, "content": {"parts": ["p", k, "q"]}}])} if k else {})} for k in range(4 + rng.randrange(2))}
            texts.append(json.dumps({"mapping": rng.choice([nodes, nodes, 3, {}])}))
        else:
            texts.append(json.dumps(items))
    rows = [(k, t, rng.choice(["json", "JSONL", "md", ""])) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, s string, ext string")
    got = {r["k"]: r["s"] for r in chats.normalized(df, "s", F.col("ext")).collect()}
    want = {k: None if t is None else plain_chats.normalize(t, ext) for k, t, ext in rows}
    assert got == want
    assert sum(want[k] != t for k, t, _ in rows) > 100


@pytest.fixture
def project(tmp_path):
    def put(name, text):
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(text)

    put("src/main.rs", "fn main() { run the api server }\n" * 4)
    put("docs/guide one.md", "A guide to the docs of this tool, long enough to keep.\n" * 3)
    put("build/out.txt", "ignored output that is long enough to be kept otherwise, really.")
    put("Cargo.toml", '[package]\nname = "shipper"\nversion = "1"\n')
    put("package.json", '{"name": "web-shipper"}')
    put("image.png", "no text")
    put(".gitignore", "build/\n*.log\n!keep.log\n")
    put("keep.log", "x")
    return str(tmp_path)


def test_project_files(spark, project):
    found = files.whole_texts(spark, project)
    rules = files.read_lines(spark, project + "/.gitignore")
    assert rules[0] == "build/"
    kept = files.not_ignored(found, rules)
    names = {r["relative"] for r in kept.select("relative").collect()}
    assert names == {"src/main.rs", "docs/guide one.md", "Cargo.toml", "package.json", "image.png", "keep.log"}
    forced = files.not_ignored(found, rules, ["build/out.txt"])
    assert forced.filter("relative = 'build/out.txt'").count() == 1
    rooms = [{"name": "documentation", "keywords": ["docs"]}, {"name": "backend", "keywords": ["api"]}]
    rows = ingest.project_drawers(kept, "w", rooms, "me", F.current_timestamp()).collect()
    assert {(os.path.basename(r["source_file"]), r["room"]) for r in rows} == {
        ("main.rs", "backend"), ("guide one.md", "documentation")
    }


def test_manifests_and_rooms(spark, project):
    found = files.whole_texts(spark, project)
    assert {r["name"] for r in files.manifest_projects(found).collect()} == {"shipper", "web-shipper"}
    rooms = {r["name"]: r["keywords"] for r in files.folder_rooms(found).collect()}
    assert rooms == {"documentation": ["documentation", "docs"], "src": ["src", "src"]}


def test_message_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"role":"user","content":"hi"}\nnot json\n{"type":"note","text":"there"}\n{"content":"  "}\n{"content":"x"}\n'
    )
    (tmp_path / "b.txt").write_text("skip")
    got = transcripts.message_rows(files.whole_texts(spark, str(tmp_path))).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["content"]) for r in got] == [(0, "user: hi"), (2, "note: there"), (4, "message: x")]


def test_session_split(spark):
    banner = "Claude Code v1.0"
    first = [banner, "⏺ 9:05 AM Monday, March 7, 2025", "> cd somewhere", "> fix the rail bug, Alice!", "Ben said hi"] + ["x"] * 8
    restored = [banner, "previous messages restored"] + ["y"] * 3
    second = [banner] + ["z"] * 10
    df = spark.createDataFrame([("/logs/my log.txt", "\n".join(first + restored + second))], "path string, content string")
    got = transcripts.session_parts(df).orderBy("part").collect()
    assert [r["file_name"] for r in got] == [
        "my_log_2025-03-07_905AM_Alice-Ben_fix-the-rail-bug-Alice.txt",
        "my_log_part02_unknown_session.txt",
    ]
    assert len(got[0]["lines"]) == len(first) + len(restored)
