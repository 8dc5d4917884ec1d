"""Query clean-up.

A search takes one literal query, so ``rewrite`` and ``sanitize`` exist as plain
Python for that path; ``rewrite_column`` and ``sanitize_column`` do the same for
a whole table of queries inside the JVM.  Tests hold the two together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.columns import (
    any_of,
    col,
    contains_any,
    lines_of,
    squeeze_ws,
    trim_ws,
)
from mnemospark.functions.text import FENCED_BLOCK_PATTERN

_TAIL = "?.! "
_BOUNDARY_CLASS = "[" + re.escape(fv.EXPANSION_BOUNDARY) + "]"


# ------------------------------------------------------------ one query
def tokenize(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text).lower().split()
    return [w for w in words if len(w.encode()) >= 2]


def classify(query: str) -> str:
    q = " ".join(query.lower().split())

    def has(needles):
        return any(n in q for n in needles)

    if has(fv.INTENT_PREFERENCE):
        return "preference"
    if has(fv.INTENT_TEMPORAL):
        return "temporal"
    if has(fv.INTENT_DECISION):
        return "decision"
    if q.startswith(tuple(fv.INTENT_HOW_TO_PREFIXES)) or has(fv.INTENT_HOW_TO):
        return "how_to"
    if q.startswith(tuple(fv.INTENT_DEFINITION_PREFIXES)):
        return "definition"
    return "unknown"


def rewrite(query: str) -> str:
    """Keyword form of a question.

    Only the first occurrence of an abbreviation counts, and only when a blank
    or punctuation follows it, so an abbreviation at the very end stays.
    """
    body = query.strip().lower().rstrip(_TAIL)
    rests = (
        body[len(p):].lstrip(" :") for p in fv.QUESTION_PREFIXES if body.startswith(p)
    )
    body = " ".join(next((r for r in rests if r), body).split())
    for short, full in fv.QUERY_EXPANSIONS:
        head, found, tail = body.partition(short)
        if found and tail[:1] and tail[0] in fv.EXPANSION_BOUNDARY:
            body = head + full + tail
    return body.strip() or query.strip()


def sanitize(raw: str) -> str:
    """The question inside an agent prompt: marked value, else question-like lines."""
    raw = raw.strip()
    lines = raw.splitlines()
    marked = []
    for line in lines:
        flat = " ".join(line.split())
        low = flat.lower()
        for marker in fv.QUERY_MARKERS:
            at = low.find(marker)
            if at >= 0 and flat[at + len(marker):].strip():
                marked.append(flat[at + len(marker):].strip())
    if marked:
        return _cap_words(marked[-1])

    kept, fenced = [], False
    for line in lines:
        line = line.strip()
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and not _is_noise(line):
            kept.append(" ".join(line.split()))
    asking = [s for s in kept if "?" in s or any(t in s.lower() for t in fv.QUERY_INTENT_TERMS)]
    return _cap_words(" ".join(asking or kept))


def _is_noise(line: str) -> bool:
    low = line.lower()
    if not line or low.startswith(tuple(fv.DROPPED_LINE_PREFIXES)):
        return True
    if any(n in low for n in fv.DROPPED_LINE_NEEDLES):
        return True
    size = len(line.encode())
    marks = sum(1 for c in line if not c.isalnum() and not c.isspace())
    return size > 240 and marks > size // 8


def _cap_words(text: str) -> str:
    return " ".join(text.split()[: fv.MAX_QUERY_WORDS])


# --------------------------------------------------------- table of queries
def rewrite_column(query: Column | str) -> Column:
    query = col(query)
    body = F.rtrim(F.lower(trim_ws(query)), F.lit(_TAIL))
    chain = None
    for prefix in fv.QUESTION_PREFIXES:
        rest = F.ltrim(F.substring(body, len(prefix) + 1, 2**31 - 1), F.lit(" :"))
        hit = body.startswith(prefix) & (rest != "")
        chain = F.when(hit, rest) if chain is None else chain.when(hit, rest)
    out = squeeze_ws(chain.otherwise(body))
    for short, full in fv.QUERY_EXPANSIONS:
        first = rf"(?s)^((?:(?!{short}).)*+){short}(?={_BOUNDARY_CLASS})"
        out = F.regexp_replace(out, first, "$1" + full)
    out = trim_ws(out)
    return F.when(out == "", trim_ws(query)).otherwise(out)


def sanitize_column(raw: Column | str) -> Column:
    raw = trim_ws(raw)

    def marked_values(line: Column) -> Column:
        flat = squeeze_ws(line)
        low = F.lower(flat)
        values = []
        for marker in fv.QUERY_MARKERS:
            at = F.instr(low, F.lit(marker))
            value = trim_ws(F.substr(flat, at + len(marker)))
            values.append(F.when((at > 0) & (value != ""), value))
        return F.array(*values)

    marked = F.filter(F.flatten(F.transform(lines_of(raw), marked_values)), F.isnotnull)

    def is_noise(line: Column) -> Column:
        low = F.lower(line)
        marks = F.char_length(F.regexp_replace(line, r"(?U)[\p{IsAlphabetic}\p{N}\s]", ""))
        size = F.octet_length(line)
        return (
            (line == "")
            | any_of(low.startswith(p) for p in fv.DROPPED_LINE_PREFIXES)
            | contains_any(low, fv.DROPPED_LINE_NEEDLES)
            | ((size > 240) & (marks > F.floor(size / 8)))
        )

    def is_asking(line: Column) -> Column:
        return line.contains("?") | contains_any(F.lower(line), fv.QUERY_INTENT_TERMS)

    prose = F.regexp_replace(raw, FENCED_BLOCK_PATTERN, "")
    lines = F.filter(F.transform(lines_of(prose), trim_ws), lambda s: ~is_noise(s))
    kept = F.transform(lines, squeeze_ws)
    asking = F.filter(kept, is_asking)
    chosen = F.when(F.size(asking) > 0, asking).otherwise(kept)
    text = F.when(F.size(marked) > 0, F.element_at(marked, -1)).otherwise(
        F.array_join(chosen, " ")
    )
    return F.array_join(F.slice(F.split(text, " "), 1, fv.MAX_QUERY_WORDS), " ")
