"""Chat exports turned into transcripts: a user line starts with '>'.

Five formats are tried in a fixed order, and the first that gives two turns wins.  Documents are
parsed to variants, once as a whole and once line by line, and read by expressions: filters and
transforms for messages, a fold over the speakers for roles that alternate.  Only a tree of messages, where
one node names the next, is walked in Python, and only rows that hold one reach it.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.columns import computed, let, trim_ws

ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}
TURNS = "array<struct<role:string,text:string>>"
#: Turns that make a conversation.
LEAST_TURNS = 2
#: Quoted lines from which a text counts as a transcript already.
QUOTED_LINES = 3


# ------------------------------------------------------------------- variants
def parsed(text: Column) -> Column:
    """JSON text as a variant; NULL if it is none.

    The parser stops behind the first value, so the text is read as the only element of a list inside an
    object: anything that follows the value is then an error or a second element.
    """
    held = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":['), text, F.lit("]}"))), "$.v", "array<variant>")
    return let(held, lambda values: F.when(F.size(values) == 1, F.get(values, 0)))


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _field(value: Column, name: str) -> Column:
    """A member of an object; a member that is null is there, one that is missing is NULL."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column) -> Column:
    """The value if it is a string: numbers are no text."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _mapped(word: Column, names: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, role in names.items():
        found = F.when(word == name, F.lit(role)).otherwise(found)
    return found


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _said(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"].isNotNull() & (t["text"] != ""))


def plain_text(content: Column) -> Column:
    """Text of a message body: a string, text blocks, or an object with text."""

    def block(b: Column) -> Column:
        is_text = _string(_field(b, "type")) == "text"
        return F.when(is_text, _string(_field(b, "text"))).otherwise(_string(b))

    def body(c: Column) -> Column:
        blocks = F.array_join(F.filter(F.transform(_list(c), block), F.isnotnull), " ")
        return F.coalesce(trim_ws(_string(c)), trim_ws(blocks), trim_ws(_string(_field(c, "text"))), F.lit(""))

    return let(content, body)


# -------------------------------------------------------------------- formats
def session_lines(lines: Column) -> Column:
    """Line JSON with type and message.content."""
    roles = {k: v for k, v in ROLES.items() if k != "ai"}
    return _said(F.transform(lines, lambda r: _turn(_mapped(_string(_field(r, "type")), roles), plain_text(_field(_field(r, "message"), "content")))))


def event_lines(lines: Column) -> Column:
    """Line JSON of events, valid only with a session header and whole payloads."""

    def kind(r: Column) -> Column:
        return _string(_field(r, "type"))

    def message(r: Column) -> Column:
        return _string(_field(_field(r, "payload"), "message"))

    roles = {"user_message": "user", "agent_message": "assistant"}
    events = F.filter(lines, lambda r: kind(r) == "event_msg")
    whole = F.exists(lines, lambda r: F.coalesce(kind(r) == "session_meta", F.lit(False))) & ~F.exists(events, lambda r: message(r).isNull())
    turns = F.transform(events, lambda r: _turn(_mapped(_string(_field(_field(r, "payload"), "type")), roles), trim_ws(message(r))))
    return F.when(whole, _said(turns))


def message_list(whole: Column) -> Column:
    """A list of messages, or a list of conversations that hold such lists."""
    data = _list(F.coalesce(_field(whole, "messages"), _field(whole, "chat_messages"), whole))
    lists = F.transform(data, lambda c: _list(_field(c, "chat_messages")))
    nested = _field(F.get(data, 0), "chat_messages").isNotNull()
    all_lists = F.forall(lists, F.isnotnull)
    messages = F.when(~nested, data).when(all_lists, F.flatten(lists))
    return _said(F.transform(messages, lambda m: _turn(_mapped(_string(_field(m, "role")), ROLES), plain_text(_field(m, "content")))))


def channel_messages(whole: Column) -> Column:
    """Channel messages; new speakers take the role the last one did not have."""
    messages = F.filter(_list(whole), lambda m: _string(_field(m, "type")) == "message")
    spoken = F.filter(
        F.transform(
            messages,
            lambda m: F.struct(
                F.coalesce(_string(F.coalesce(_field(m, "user"), _field(m, "username"))), F.lit("")).alias("speaker"),
                F.coalesce(trim_ws(_string(_field(m, "text"))), F.lit("")).alias("text"),
            ),
        ),
        lambda m: (m["speaker"] != "") & (m["text"] != ""),
    )
    start = F.expr(f"named_struct('roles', CAST(map() AS MAP<STRING, STRING>), 'last', 'assistant', 'turns', CAST(array() AS {TURNS}))")

    def heard(so_far: Column, m: Column) -> Column:
        role = F.coalesce(
            F.try_element_at(so_far["roles"], m["speaker"]),
            F.when(so_far["last"] == "assistant", "user").otherwise("assistant"),
        )
        return let(
            role,
            lambda r: F.struct(
                F.when(F.map_contains_key(so_far["roles"], m["speaker"]), so_far["roles"])
                .otherwise(F.map_concat(so_far["roles"], F.create_map(m["speaker"], r))).alias("roles"),
                r.alias("last"),
                F.concat(so_far["turns"], F.array(_turn(r, m["text"]))).alias("turns"),
            ),
        )

    return F.aggregate(spoken, start, heard, lambda done: done["turns"])


def tree_turns(content: str) -> list[dict] | None:
    """A mapping of nodes, read from the root along first children."""
    data = json.loads(content)
    nodes = data["mapping"]
    # Objects are searched in key order, whatever order the file has.
    roots = [k for k, n in sorted(nodes.items()) if isinstance(n, dict) and n.get("parent", 0) is None]
    at = next(iter([k for k in roots if "message" not in nodes[k]] + roots), None)
    path, seen = [], set()
    while isinstance(at, str) and at not in seen:
        if at not in nodes:
            return None
        seen.add(at)
        path.append(nodes[at])
        children = nodes[at].get("children") if isinstance(nodes[at], dict) else None
        at = children[0] if isinstance(children, list) and children else None

    def inner(node, *keys):
        for key in ("message", *keys):
            node = node.get(key) if isinstance(node, dict) else None
        return node

    turns = []
    for node in path:
        parts = inner(node, "content", "parts")
        text = " ".join(p for p in parts if isinstance(p, str)).strip() if isinstance(parts, list) else ""
        role = inner(node, "author", "role")
        if role in ("user", "assistant") and text:
            turns.append({"role": role, "text": text})
    return turns


def message_tree(content: Column) -> Column:
    """Turns of documents that hold a tree; the column is null for all others."""

    @F.arrow_udf(TURNS)
    def walked(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return pa.array([None if t is None else tree_turns(t) for t in texts.to_pylist()], kind)

    return walked(content)


# ---------------------------------------------------------------- transcripts
def transcript(turns: Column) -> Column:
    """Quoted user lines with the direct reply below, a blank line between blocks."""

    def lines(turn: Column, i: Column) -> Column:
        said = F.when(turn["role"] == "user", F.concat(F.lit("> "), turn["text"])).otherwise(turn["text"])
        answered = (turn["role"] == "user") & (F.get(turns, i + 1)["role"] == "assistant")
        return F.when(F.coalesce(answered, F.lit(False)), F.array(said)).otherwise(F.array(said, F.lit("")))

    return F.array_join(F.flatten(F.transform(turns, lines)), "\n")


def normalized(df: DataFrame, content: str, extension: Column) -> DataFrame:
    """The rows with chat exports in ``content`` turned into transcripts; any other text stays as it is."""
    text = F.col(content)
    quoted = F.size(F.filter(F.split(text, "\n"), lambda s: F.startswith(trim_ws(s), F.lit(">"))))
    head = F.substring(trim_ws(text), 1, 1)
    candidate = (quoted < QUOTED_LINES) & (F.lower(extension).isin("json", "jsonl") | head.isin("{", "[")) & (head != "")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda s: trim_ws(s) != ""), parsed)
    variants = computed(
        df,
        {
            "_lines": F.when(candidate, let(lines, lambda ls: F.when(F.forall(ls, F.isnotnull), ls))),
            "_whole": F.when(candidate, parsed(text)),
        },
    )
    has_tree = _object(_field(F.col("_whole"), "mapping")).isNotNull()
    tried = variants.withColumn("_tree", message_tree(F.when(has_tree, text)))
    found = [session_lines(F.col("_lines")), event_lines(F.col("_lines")), message_list(F.col("_whole")), F.col("_tree"), channel_messages(F.col("_whole"))]
    turns = F.coalesce(*(let(f, lambda ts: F.when(F.size(ts) >= LEAST_TURNS, ts)) for f in found))
    read = computed(tried, {"_turns": turns})
    return read.withColumn(content, F.coalesce(transcript(F.col("_turns")), text)).drop("_lines", "_whole", "_tree", "_turns")
