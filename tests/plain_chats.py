"""The chat parser in plain Python, to compare with."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

Turn = tuple[str, str]
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}


def plain_text(content) -> str:
    """Text of a message body: a string, text blocks, or an object with text."""
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, dict):
        text = content.get("text")
        return text.strip() if isinstance(text, str) else ""
    if not isinstance(content, list):
        return ""
    blocks = (
        b.get("text") if isinstance(b, dict) and b.get("type") == "text" else b for b in content
    )
    return " ".join(b for b in blocks if isinstance(b, str)).strip()


def transcript(turns: list[Turn]) -> str:
    """Quoted user lines with the direct reply below, a blank line between blocks."""
    out: list[str] = []
    for i, (role, text) in enumerate(turns):
        answers = role == "assistant" and i > 0 and turns[i - 1][0] == "user"
        if answers:
            out.insert(len(out) - 1, text)
        else:
            out += [f"> {text}" if role == "user" else text, ""]
    return "\n".join(out)


def _said(items: Iterable, role_of: Callable, text_of: Callable) -> list[Turn]:
    pairs = ((ROLES.get(role_of(i)), text_of(i)) for i in items if isinstance(i, dict))
    return [(r, s) for r, s in pairs if r and s]


def _str(value) -> str:
    return value if isinstance(value, str) else ""


def session_lines(records: list) -> list[Turn] | None:
    """Line JSON with type and message.content."""
    def body(r):
        message = r.get("message")
        return plain_text(message.get("content")) if isinstance(message, dict) else ""

    known = [r for r in records if isinstance(r, dict) and r.get("type") in ("human", "user", "assistant")]
    return _said(known, lambda r: r["type"], body)


def event_lines(records: list) -> list[Turn] | None:
    """Line JSON of events, valid only with a session header and whole payloads."""
    kinds = {"user_message": "user", "agent_message": "assistant"}
    header, turns = False, []
    for r in records:
        kind = r.get("type") if isinstance(r, dict) else None
        header = header or kind == "session_meta"
        if kind != "event_msg":
            continue
        payload = r.get("payload")
        message = payload.get("message") if isinstance(payload, dict) else None
        if not isinstance(message, str):
            return None
        role = kinds.get(payload.get("type"))
        if role and message.strip():
            turns.append((role, message.strip()))
    return turns if header else None


def message_list(data) -> list[Turn] | None:
    """A list of messages, or a list of conversations that hold such lists."""
    if isinstance(data, dict):
        data = data["messages"] if "messages" in data else data.get("chat_messages", data)
    if not isinstance(data, list) or not data:
        return None
    if isinstance(data[0], dict) and "chat_messages" in data[0]:
        lists = [c.get("chat_messages") if isinstance(c, dict) else None for c in data]
        if not all(isinstance(x, list) for x in lists):
            return None
        data = [m for x in lists for m in x]
    return _said(data, lambda m: _str(m.get("role")), lambda m: plain_text(m.get("content")))


def message_tree(data) -> list[Turn] | None:
    """A mapping of nodes, read from the root along first children."""
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return None
    # Objects are searched in key order, whatever order the file has.
    roots = [
        k for k, n in sorted(nodes.items()) if isinstance(n, dict) and n.get("parent", 0) is None
    ]
    bare = [k for k in roots if "message" not in nodes[k]]
    at = next(iter(bare + roots), None)
    if at is None:
        return None
    path, seen = [], set()
    while isinstance(at, str) and at not in seen:
        if at not in nodes:
            return None
        seen.add(at)
        path.append(nodes[at])
        children = nodes[at].get("children")
        at = children[0] if isinstance(children, list) and children else None

    def message(n, *keys):
        for key in ("message", *keys):
            n = n.get(key) if isinstance(n, dict) else None
        return n

    def parts(n):
        found = message(n, "content", "parts")
        return " ".join(p for p in found if isinstance(p, str)).strip() if isinstance(found, list) else ""

    roles = {"user": "user", "assistant": "assistant"}
    turns = [(roles.get(_str(message(n, "author", "role"))), parts(n)) for n in path]
    return [(r, s) for r, s in turns if r and s]


def channel_messages(data) -> list[Turn] | None:
    """Channel messages; new speakers take the role the last one did not have."""
    if not isinstance(data, list):
        return None
    roles, last, turns = {}, "assistant", []
    for m in data:
        if not isinstance(m, dict) or m.get("type") != "message":
            continue
        speaker = _str(m["user"] if "user" in m else m.get("username"))
        text = _str(m.get("text")).strip()
        if speaker and text:
            last = roles.setdefault(speaker, "user" if last == "assistant" else "assistant")
            turns.append((last, text))
    return turns


def _json_lines(content: str) -> list | None:
    try:
        return [json.loads(s) for s in content.split("\n") if s.strip()]
    except ValueError:
        return None


def normalize(content: str, extension: str) -> str:
    """Transcript of a chat export; any other text comes back unchanged."""
    lines = content.splitlines()
    quoted = sum(1 for s in lines if s.strip().startswith(">"))
    trimmed = content.strip()
    looks_json = extension.lower() in ("json", "jsonl") or trimmed[:1] in ("{", "[")
    if not trimmed or quoted >= 3 or not looks_json:
        return content
    attempts = [(f, _json_lines(content)) for f in (session_lines, event_lines)]
    try:
        whole = json.loads(content)
        attempts += [(f, whole) for f in (message_list, message_tree, channel_messages)]
    except ValueError:
        pass
    for read, data in attempts:
        turns = read(data) if data is not None else None
        if turns and len(turns) >= 2:
            return transcript(turns)
    return content
