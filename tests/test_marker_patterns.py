"""The quicker patterns of memory extraction against the bare ones."""

import re

from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.operators import memories

MARKED = [p for _, ps in fv.MEMORY_MARKERS for p in ps] + fv.RESOLUTION_MARKERS


def test_markers_are_counted_as_by_the_bare_pattern(spark):
    texts = [
        "the bug was fixed and the crash, xbug bug-error broken", "we chose v1.2 over xv3.4, 12x faster and 30% smaller", "*sighs* i feel proud *",
        "we always use tabs, we never use spaces; my rule is simple", "won't ever work, it turns out it was late", "éproblem problemé problem", "",
        "let's go, we went with rail because it was cheap instead of road", "ſhip it works and i figured it out, figured out", None,
    ] + [re.sub(r"\\[bd]\+?|[()?*+\[\]^\\]|\|.*", " ", p) for p in MARKED]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in MARKED:
        bare = F.expr(f"regexp_count(t, {memories.quoted('(?U)' + p)})")
        quick = F.expr(memories.sql_marker_count("t", [p]))
        assert df.where(~F.coalesce(bare, F.lit(0)).eqNullSafe(F.coalesce(quick, F.lit(0)))).count() == 0, p


def test_needed_words_of_groups():
    assert memories.required_any(r"\b(bug|error)\b") == ["bug", "error"]
    assert memories.required_any(r"\bthe reason (is|was|being)\b") == ["the reason "]
    assert memories.required_any(r"\*[^*]+\*") == []
    assert memories.hurried(r"\b(bug|error)\b") == r"(?=[be])\b(bug|error)\b"
    assert memories.hurried(r"\bx?y") == r"\bx?y"


def test_lines_open_with_any_pattern(spark):
    lines = ["$ ls", "  git push", "x = a.b", "Human: hi", "human : hi", "> q", "NAME=1", "plain words here", "iffy", "if (x)", "---", "a.b(c)", "{", ""]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    for patterns in (fv.CODE_LINE_PATTERNS, fv.TURN_LINE_PATTERNS):
        each = memories.any_of(F.col("t").rlike(p) for p in patterns)
        assert df.where(each != F.col("t").rlike(memories._opens_with(patterns))).count() == 0
