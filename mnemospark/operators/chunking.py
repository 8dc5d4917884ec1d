"""Chunks of files and transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.columns import WHITESPACE, let, lines_of, trim_ws
from mnemospark.operators.memories import line_groups, paragraphs


def _on_boundary(data: bytes, at: int) -> int:
    """The offset itself or the nearest earlier start of a character."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunk_spans(data: bytes) -> Iterator[tuple[int, int]]:
    """Overlapping byte windows that prefer to end at a blank line, else a line.

    A break counts only in the later half of the window.  Where a blank line
    exists in the window but too early, single line breaks are not tried.
    """
    start, total = 0, len(data)
    while start < total:
        end = _on_boundary(data, start + fv.CHUNK_BYTES)
        if end < total:
            at = data.rfind(b"\n\n", start, end)
            if at < 0:
                at = data.rfind(b"\n", start, end)
            if at > start + fv.CHUNK_BYTES // 2:
                end = at
        yield start, end
        if end >= total:
            return
        back = _on_boundary(data, max(end - fv.CHUNK_OVERLAP_BYTES, 0))
        start = back if back > start else end


def chunk_text(text: str) -> list[str]:
    data = text.strip(WHITESPACE).encode()
    pieces = (data[a:b].decode().strip(WHITESPACE) for a, b in chunk_spans(data))
    return [p for p in pieces if len(p.encode()) >= fv.MIN_CHUNK_BYTES]


def chunks_column(text: Column | str) -> Column:
    """Array of chunks.  Each cut depends on the one before, so this is Python,
    fed in Arrow batches."""
    @F.arrow_udf("array<string>")
    def chunks(batch: pa.Array) -> pa.Array:
        return pa.array(
            [None if s is None else chunk_text(s) for s in batch.to_pylist()],
            type=pa.list_(pa.string()),
        )

    return chunks(F.col(text) if isinstance(text, str) else text)


def chunk_rows(texts: DataFrame, text: str) -> DataFrame:
    keep = [c for c in texts.columns if c != text]
    return texts.select(
        *keep, F.posexplode(chunks_column(text)).alias("chunk_index", "content")
    )


# -------------------------------------------------------------- transcripts
def _exchange_chunks(text: Column) -> Column:
    """A quoted user line with up to eight reply lines before the next or a rule."""
    parts = F.split(text, r"\r?\n(?=[^\S\n]*>)")

    def exchange(part: Column) -> Column:
        return let(F.transform(lines_of(part), trim_ws), exchange_of)

    def exchange_of(lines: Column) -> Column:
        rest = F.slice(lines, 2, F.size(lines))
        rule = F.array_position(F.transform(rest, lambda s: s.startswith("---")), True)
        reply = F.when(rule > 0, F.slice(rest, 1, (rule - 1).cast("int"))).otherwise(rest)
        answer = F.array_join(F.slice(F.filter(reply, lambda s: s != ""), 1, fv.MAX_REPLY_LINES), " ")
        head = F.get(lines, 0)
        return F.when(answer == "", head).otherwise(F.concat(head, F.lit("\n"), answer))

    quoted = F.filter(parts, lambda p: F.ltrim(p, F.lit(WHITESPACE)).startswith(">"))
    kept = F.filter(
        F.transform(quoted, exchange),
        lambda c: F.octet_length(trim_ws(c)) > fv.MIN_CONVO_CHUNK_BYTES,
    )
    return F.transform(kept, lambda c, i: F.struct(i.alias("chunk_index"), c.alias("content")))


def _paragraph_chunks(text: Column) -> Column:
    """Paragraphs numbered before short ones are dropped."""
    chosen = let(
        lines_of(text),
        lambda lines: let(
            paragraphs(text),
            lambda ps: F.when(
                (F.size(ps) <= 1) & (F.size(lines) > 20), line_groups(lines)
            ).otherwise(ps),
        ),
    )
    numbered = F.transform(
        chosen, lambda c, i: F.struct(i.alias("chunk_index"), c.alias("content"))
    )
    return F.filter(
        numbered, lambda c: F.octet_length(c["content"]) > fv.MIN_CONVO_CHUNK_BYTES
    )


def quoted_lines(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda s: trim_ws(s).startswith(">")))


def exchange_rows(texts: DataFrame, text: str) -> DataFrame:
    """Exchange chunks where three or more lines are quoted, else paragraphs."""
    keep = [c for c in texts.columns if c != text]
    body = F.col(text)
    chunks = F.when(quoted_lines(body) >= 3, _exchange_chunks(body)).otherwise(
        _paragraph_chunks(body)
    )
    return texts.select(*keep, F.inline(chunks))
