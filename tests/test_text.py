"""Hand-written expectations for the text rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import scoring
from mnemospark.functions import text as t
from mnemospark.operators import chunking, memories


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello, a é wörld-42!", ["hello", "é", "wörld", "42"]),
        ("", []),
        ("x_y zz", ["zz"]),
        ("ÀB cd", ["àb", "cd"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, text, t.tokens("s")) == want
    assert q.tokenize(text) == want


@pytest.mark.parametrize(
    "query, want",
    [
        ("What do I prefer for tests?", "preference"),
        ("I know the answer", "temporal"),  # "know" holds "now"
        ("why was sqlite picked", "decision"),
        ("How do I build", "how_to"),
        ("what is a wing", "definition"),
        ("free text", "unknown"),
        ("why was this installed before", "temporal"),  # order of the rules
    ],
)
def test_intent(spark, query, want):
    assert one(spark, query, t.query_intent("s")) == want
    assert q.classify(query) == want


@pytest.mark.parametrize(
    "query, want",
    [
        ("What is the mcp server?", "the model context protocol server"),
        ("server mcp", "server mcp"),  # nothing follows the abbreviation
        ("an api and a db here", "an application interface and a database here"),
        ("graphql apis", "graphql apis"),
        ("what is", "what is"),
        ("   ", ""),
        ("dbx db now", "dbx db now"),  # only the first occurrence is tried
        ("debdb now", "debdatabase now"),  # nothing is asked of the left side
    ],
)
def test_rewrite(spark, query, want):
    assert q.rewrite(query) == want
    assert one(spark, query, q.rewrite_column("s")) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("query: one\nquery: two", "two"),
        ("Search query: why so?", "why so?"),
        ("You are a bot\n```\ncode?\n```\nwhy this\nplain", "why this"),
        ("just words\nand more", "just words and more"),
        ('{"tool": 1}\n<tag>\nleft over', "left over"),
        ("", ""),
        (" ".join(["w"] * 100), " ".join(["w"] * 80)),
    ],
)
def test_sanitize(spark, raw, want):
    assert q.sanitize(raw) == want
    assert one(spark, raw, q.sanitize_column("s")) == want
    assert q.sanitize(want) == want


def test_preference_span(spark):
    text = "We talked. I prefer tabs over spaces! Then lunch."
    assert one(spark, text, t.preference_span("s")) == "I prefer tabs over spaces!"
    assert one(spark, "no signal here", t.preference_span("s")) is None
    # A signal cut by a line break is only seen in the whole text.
    assert one(spark, " I prefer \ntabs ", t.preference_span("s")) == "I prefer \ntabs"


def test_hall_tie_goes_to_the_later_hall(spark):
    assert one(spark, "a happy family", t.detect_hall("s")) == "family"
    assert one(spark, "nothing", t.detect_hall("s")) == "memory"


def test_convo_room_cut_inside_a_character_reads_the_whole_text(spark):
    text = "a" * 2999 + "é" + " roadmap"
    assert one(spark, text, t.detect_convo_room("s", 3000)) == "planning"
    assert one(spark, "a" * 3000 + " roadmap", t.detect_convo_room("s", 3000)) == "general"


def test_convo_room_reads_whole_texts_by_default(spark):
    assert one(spark, "a" * 3000 + " roadmap", t.detect_convo_room("s")) == "planning"


def test_entities(spark):
    text = "Bob: hello\nAlice Walker met Claude at PricingAPI. The DB-Team uses CamelCase"
    found = {(r["name"], r["kind"]) for r in one(spark, text, t.detect_entities("s"))}
    assert ("Bob", "person") in found
    assert ("Alice Walker", "person") in found
    assert ("Claude", "agent_persona") in found
    assert ("PricingAPI", "project") in found
    assert ("CamelCase", "topic") in found
    assert not any(n == "The" for n, _ in found)


def test_file_room(spark):
    rooms = [
        {"name": "backend", "keywords": ["api"]},
        {"name": "docs", "keywords": []},
        {"name": "design", "keywords": ["color"]},
    ]
    rows = [
        ("src/api/x.rs", "text", "backend"),
        ("notes/docs.md", "text", "docs"),
        ("zz/q1.md", "color color api", "design"),
        ("zz/q1.md", "nothing", "general"),
    ]
    df = spark.createDataFrame(rows, "p string, c string, want string")
    got = df.select(t.detect_file_room("p", "c", rooms).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_dialect(spark):
    text = "Title  \n---\n\n\n\nThe Function of functions, in order to go.\n\n"
    assert one(spark, text, t.dialect_compress("s")) == "[AAAK] Title\n\nThe fn of functions, to go."


def test_boosts_by_hand(spark):
    df = spark.createDataFrame([("we chose rail because of cost", "decisions")], "x string, r string")
    score = df.select(F.expr(scoring.coding_boost("why rail", "x", "r"))).first()[0]
    assert score == pytest.approx(0.16)
    score = df.select(F.expr(scoring.coding_boost("why rail", "x", "'other'"))).first()[0]
    assert score == pytest.approx(0.16 * 0.7)
    df = spark.createDataFrame([("I prefer rail freight", "preferences")], "x string, r string")
    match = df.select(F.expr(scoring.preference_match("what do i prefer for rail", "x", "r"))).first()[0]
    assert match == pytest.approx(0.22)


# ------------------------------------------------------------------- chunks
def test_chunks_prefer_breaks():
    text = "a" * 500 + "\n\n" + "b" * 600
    assert chunking.chunk_text(text)[0] == "a" * 500
    early = "a" * 100 + "\n\n" + "b" * 400 + "\n" + "c" * 600
    # A blank line too early in the window stops the search for a line break.
    assert len(chunking.chunk_text(early)[0]) == 800
    assert chunking.chunk_text("short") == []
    assert chunking.chunk_text("é" * 401)[0] == "é" * 400


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n", min_size=0, max_size=4000))
def test_chunk_spans_cover_the_text(text):
    data = text.strip().encode()
    spans = list(chunking.chunk_spans(data))
    covered = 0
    for a, b in spans:
        assert a <= covered and b > a and b - a <= fv.CHUNK_BYTES
        data[a:b].decode()
        covered = b
    assert covered == len(data)


def test_chunk_rows_equal_plain_python(spark):
    texts = ["word " * 700, "x\n\n" * 900, "é" * 2000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, s string")
    got = {}
    for r in chunking.chunk_rows(df, "s").orderBy("n", "chunk_index").collect():
        got.setdefault(r["n"], []).append(r["content"])
    assert [got.get(i, []) for i in range(4)] == [chunking.chunk_text(s) for s in texts]


def test_exchange_chunks(spark):
    text = "> first question here\nan answer line\n\nmore answer\n---\ndropped\n> second one asked\n" + "\n".join(
        f"line {i}" for i in range(12)
    ) + "\n> short"
    df = spark.createDataFrame([(1, text)], "n int, s string")
    got = [(r["chunk_index"], r["content"]) for r in chunking.exchange_rows(df, "s").collect()]
    assert got == [
        (0, "> first question here\nan answer line more answer"),
        (1, "> second one asked\n" + " ".join(f"line {i}" for i in range(8))),
    ]


def test_paragraph_index_counts_dropped_ones(spark):
    df = spark.createDataFrame([(1, "tiny\n\n" + "long paragraph " * 5)], "n int, s string")
    assert [r["chunk_index"] for r in chunking.exchange_rows(df, "s").collect()] == [1]


# ----------------------------------------------------------------- memories
def kinds(spark, text):
    df = spark.createDataFrame([(1, text)], "n int, s string")
    found = memories.number_memories(memories.extract_memories(df, "s"), "n")
    return [(r["chunk_index"], r["memory_type"]) for r in found.orderBy("chunk_index").collect()]


def test_memory_kinds(spark):
    assert kinds(spark, "We decided to go with rail because of the tradeoff") == [(0, "decision")]
    fixed = "The bug was an error, a crash, root cause found and then resolved"
    assert kinds(spark, fixed) == [(0, "milestone")]
    assert kinds(spark, "The problem is an error. It keeps failing, a crash, broken") == [(0, "problem")]
    assert kinds(spark, "nothing to see in here at all") == []
    assert kinds(spark, "```\nwe decided because of error\n```") != []  # falls back to the text


def test_turns_open_segments(spark):
    text = "> why is this\nbecause reasons\nUser: next\nAssistant: fine\nmore"
    got = one(spark, text, memories.segments("s"))
    assert got == ["> why is this\nbecause reasons", "User: next", "Assistant: fine\nmore"]


def test_required_text_is_in_every_match():
    assert memories.required_text(r"\bthe reason (is|was|being)\b") == "the reason "
    assert memories.required_text(r"\blet'?s (use|go)\b") == "let"
    assert memories.required_text(r"\b(bug|error)\b") == ""
    assert memories.required_text(r"\d+x (faster)") == "x "
    assert memories.required_text(r"\*[^*]+\*") == ""


def test_pair_turns_across_blocks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(600)]
    got = memories.pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.count() == 300
    assert got.filter("turn = 254").first()["content"] == "User: t254\nAssistant: t255"
