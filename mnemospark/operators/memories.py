"""Segments and typed memories from free text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.columns import (
    WHITESPACE_CLASS,
    any_of,
    computed,
    let,
    lines_of,
    quoted,
    sql_any,
    sql_best,
    trim_ws,
)
from mnemospark.functions.text import FENCED_BLOCK_PATTERN
from mnemospark.operators.ordered import neighbour

# Unicode word boundaries on every Java version.
_UNICODE = "(?U)"


def line_groups(lines: Column) -> Column:
    """Groups of 25 lines."""
    size = fv.LINES_PER_GROUP
    last = F.floor((F.size(lines) - 1) / size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda g: trim_ws(F.array_join(F.slice(lines, g * size + 1, size), "\n")),
    )


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), trim_ws), lambda p: p != "")


def _opens_with(patterns: list[str]) -> str:
    """One pattern that finds where one of the patterns does; all of them begin with ``^``.

    The anchor stands in front once more, so that a line is not walked once for each pattern.
    """
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def _is_turn(line: Column) -> Column:
    return trim_ws(line).rlike(_opens_with(fv.TURN_LINE_PATTERNS))


def segments(text: Column | str) -> Column:
    """Turns where there are three or more, else paragraphs, else line groups."""
    text = F.col(text) if isinstance(text, str) else text
    # Each turn line opens a segment: mark it, then cut at the marks.
    mark = "\x1e"

    def pick(lines: Column) -> Column:
        turns = F.size(F.filter(lines, _is_turn))
        marked = F.transform(
            lines,
            lambda s, i: F.when((i > 0) & _is_turn(s), F.concat(F.lit(mark), s)).otherwise(s),
        )
        by_turn = F.split(F.array_join(marked, "\n"), "\n" + mark)
        grouped = F.filter(line_groups(lines), lambda s: s != "")
        by_blank = let(
            paragraphs(text),
            lambda ps: F.when((F.size(ps) <= 1) & (F.size(lines) > 20), grouped).otherwise(ps),
        )
        return F.when(turns >= 3, by_turn).otherwise(by_blank)

    return let(lines_of(text), pick)


def _is_code(line: Column) -> Column:
    bare = trim_ws(line)
    letters = F.char_length(F.regexp_replace(bare, r"[^\p{IsAlphabetic}]+", ""))
    size = F.octet_length(bare)
    sparse = (letters / size < fv.CODE_ALPHA_RATIO) & (size > fv.CODE_MIN_BYTES)
    return (bare != "") & (bare.rlike(_opens_with(fv.CODE_LINE_PATTERNS)) | sparse)


def prose(text: Column) -> Column:
    """Text without fenced blocks and code lines; the text itself if none is left."""
    fenced = F.regexp_replace(text, FENCED_BLOCK_PATTERN, "")
    open_text = F.when(text.contains("```"), fenced).otherwise(text)
    kept = F.filter(lines_of(open_text), lambda s: ~_is_code(s))
    out = trim_ws(F.array_join(kept, "\n"))
    return F.when(out == "", text).otherwise(out)


def sentiment(text: Column) -> Column:
    """Distinct positive minus distinct negative words, case-sensitive."""
    words = F.array_distinct(
        F.transform(
            F.split(trim_ws(text), WHITESPACE_CLASS + "+"),
            lambda w: F.regexp_replace(
                w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+\z", ""
            ),
        )
    )

    def shared(listed: list[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed])))

    return shared(fv.POSITIVE_WORDS) - shared(fv.NEGATIVE_WORDS)


def required_text(pattern: str) -> str:
    """A literal run that every match of the pattern holds; may be empty.

    Only plain runs between metacharacters count; a character before ``?`` is
    optional, and text in groups or classes is left out.
    """
    flat = re.sub(r"\\.\+?", "\0", pattern)
    flat = re.sub(r"\([^)]*\)\??|\[[^\]]*\]\+?", "\0", flat)
    flat = re.sub(r".\?|\.\*|[+*^$]", "\0", flat)
    return max(flat.split("\0"), key=len)


def required_any(pattern: str) -> list[str]:
    """Literals of which every match of the pattern holds one; may be empty.

    A long plain run does alone; else the plain branches of a group that must match.
    """
    run = required_text(pattern)
    groups = [] if len(run) > 3 else re.findall(r"\(([a-z |]+)\)(?![?*{])", pattern)
    choices = [g.split("|") for g in groups if all(map(len, g.split("|")))]
    best = max(choices, key=lambda c: min(map(len, c)), default=[run])
    return best if min(map(len, best)) > len(run) else [run] * bool(run)


def hurried(pattern: str) -> str:
    """The same pattern, which looks at the next letter before it looks for a word boundary.

    Unicode word boundaries are dear; most places fail by their letter.
    """
    one = re.match(r"\\b([a-z])(?![?*{|])", pattern)
    if one and "|" not in re.sub(r"\([^)]*\)", "", pattern):
        return f"(?={one[1]}){pattern}"
    some = re.match(r"\\b\(([a-z' ]+(?:\|[a-z' ]+)+)\)(?![?*{])", pattern)
    if some and "|" not in re.sub(r"\([^)]*\)", "", pattern):
        return f"(?=[{''.join(sorted({w[0] for w in some[1].split('|')}))}]){pattern}"
    return pattern


def sql_marker_count(low: str, patterns: list[str]) -> str:
    """Total matches.  A pattern is only run on texts that hold its literal part, or one of them."""
    parts = []
    for p in patterns:
        need, regex = required_any(p), quoted(_UNICODE + hurried(p))
        count = f"regexp_count({low}, {regex})"
        parts.append(f"IF({sql_any(low, need)}, {count}, 0)" if need else count)
    return " + ".join(parts)


def extract_memories(
    texts: DataFrame, text: str, min_confidence: float = fv.EXTRACT_MIN_CONFIDENCE
) -> DataFrame:
    """Typed memories: the input's other columns, _pos, memory_type, confidence, content.

    Segments are cut and judged inside the row of their text, without a shuffle.
    """
    keep = [c for c in texts.columns if c != text]
    rows = texts.select(*keep, F.posexplode(segments(text)).alias("_pos", "_seg")).filter(
        F.octet_length(trim_ws("_seg")) >= fv.MIN_SEGMENT_BYTES
    )
    typed = score_segments(rows, "_seg").filter(F.col("confidence") >= min_confidence)
    return typed.select(
        *keep, "_pos", "memory_type", "confidence", trim_ws("_seg").alias("content")
    )


def score_segments(rows: DataFrame, segment: str) -> DataFrame:
    """Adds memory_type and confidence; segments without any marker are dropped.

    Prose, then counts, then the verdict: each step is evaluated once per row.
    """
    with_prose = computed(rows, {"_prose": prose(F.col(segment))})
    lowered = computed(with_prose, {"_low": F.lower("_prose")})
    counts = computed(
        lowered,
        {
            f"_{label}": F.expr(sql_marker_count("_low", pats))
            for label, pats in fv.MEMORY_MARKERS
        },
    )
    scores = [(label, f"_{label}") for label, _ in fv.MEMORY_MARKERS]
    top = F.greatest(*[s for _, s in scores])
    size = F.octet_length(segment)
    bonus = F.when(size > 500, 2).when(size > 200, 1).otherwise(0)
    # Only problems are looked at again for a resolution and the mood.
    is_problem = F.col("_best") == "problem"
    ranked = counts.filter(top > 0).withColumn("_best", F.expr(sql_best(scores, None, last_wins=True)))
    judged = computed(
        ranked,
        {
            "_mood": F.when(is_problem, sentiment(F.col("_prose"))),
            "_solved": F.when(
                is_problem,
                any_of(F.col("_low").rlike(_UNICODE + hurried(p)) for p in fv.RESOLUTION_MARKERS),
            ),
        },
    )
    moved, upbeat = F.col("_emotional") > 0, F.col("_mood") > 0
    kind = (
        F.when(~is_problem, F.col("_best"))
        .when(F.col("_solved") & moved & upbeat, "emotional")
        .when(F.col("_solved"), "milestone")
        .when(upbeat & (F.col("_milestone") > 0), "milestone")
        .when(upbeat & moved, "emotional")
        .otherwise("problem")
    )
    helper = ["_prose", "_low", "_best", "_mood", "_solved"]
    return judged.withColumns(
        {
            "memory_type": kind,
            "confidence": F.least((top + bonus) / 5.0, F.lit(1.0)),
        }
    ).drop(*helper, *[f"_{label}" for label, _ in fv.MEMORY_MARKERS])


def number_memories(memories: DataFrame, key: str) -> DataFrame:
    """``chunk_index`` within each text, by segment order.

    All segments of one text sit in one input row, so a group is one text.
    """
    order = Window.partitionBy(key).orderBy("_pos")
    return memories.withColumn("chunk_index", F.row_number().over(order) - 1).drop("_pos")


def pair_turns(conversations: DataFrame) -> DataFrame:
    """User turns followed by an assistant turn, as one exchange text.

    Turn blocks keep one long conversation from being ordered in one task.
    """
    blocked = conversations.withColumn("_block", F.floor(F.col("turn") / 256))
    near = neighbour(blocked, ["conv_id"], "_block", ["turn"], ["role", "text"], +1)
    pairs = near.filter((F.col("role") == "user") & (F.col("role_near") == "assistant"))
    return pairs.select(
        "conv_id", "turn",
        F.concat(F.lit("User: "), "text", F.lit("\nAssistant: "), "text_near").alias("content"),
    )
