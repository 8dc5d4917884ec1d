"""Small Column builders shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode White_Space, spelled out so that both btrim() and a regex class agree.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0          "
    "      　"
)
WHITESPACE_CLASS = (
    r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def quoted(value: str) -> str:
    """SQL literal of a Python string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The next few return SQL text.  A rule table makes hundreds of small tests; as
# text they become one expression instead of hundreds of calls into the JVM.
def sql_any(text: str, needles: Iterable[str]) -> str:
    """True where the SQL expression ``text`` holds one of the literal needles."""
    return "(" + " OR ".join(f"contains({text}, {quoted(n)})" for n in needles) + ")"


def sql_prefix(text: str, prefixes: Iterable[str]) -> str:
    return "(" + " OR ".join(f"startswith({text}, {quoted(p)})" for p in prefixes) + ")"


def sql_count(text: str, needles: Iterable[str]) -> str:
    """How many of the distinct needles occur at least once."""
    return "(" + " + ".join(f"int(contains({text}, {quoted(n)}))" for n in needles) + ")"


def sql_trim(text: str) -> str:
    return f"btrim({text}, {quoted(WHITESPACE)})"


def sql_squeeze(text: str) -> str:
    return f"regexp_replace({sql_trim(text)}, {quoted(WHITESPACE_CLASS + '+')}, ' ')"


def sql_best(scores: list[tuple[str, str]], default: str | None, last_wins: bool) -> str:
    """Label with the highest positive score; the scores are evaluated once."""
    ordered = list(enumerate(scores))
    best = "array_max(s)"
    whens = " ".join(
        f"WHEN s[{i}] = {best} THEN {quoted(label)}"
        for i, (label, _) in (reversed(ordered) if last_wins else ordered)
    )
    none = "NULL" if default is None else quoted(default)
    listed = ", ".join(score for _, score in scores)
    return (
        f"transform(array(array({listed})), s -> CASE WHEN {best} <= 0 THEN {none} {whens} END)[0]"
    )


def contains_any(haystack: Column, needles: Iterable[str]) -> Column:
    """True where ``haystack`` holds one of the literal needles."""
    return any_of(haystack.contains(n) for n in needles)


def trim_ws(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(WHITESPACE))


def squeeze_ws(text: Column | str) -> Column:
    """Trim and turn every run of whitespace into one space."""
    return F.regexp_replace(trim_ws(text), WHITESPACE_CLASS + "+", " ")


def lines_of(text: Column | str) -> Column:
    """Lines without their terminators; a final terminator opens no extra line."""
    return F.split(F.regexp_replace(col(text), r"\r?\n\z", ""), r"\r?\n")


def sql_byte_prefix(text: str, size: int) -> str:
    """First ``size`` bytes, or the whole text where that would split a character."""
    head = f"string(substring(encode({text}, 'UTF-8'), 1, {size}))"
    return (
        f"CASE WHEN octet_length({text}) <= {size} THEN {text} "
        f"WHEN is_valid_utf8({head}) THEN {head} ELSE {text} END"
    )


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding by scaling, the same arithmetic on every engine."""
    scale = float(10**digits)
    return F.round(value * F.lit(scale)) / F.lit(scale)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated exactly once per row.

    A filter on a plain column is pushed below its projection as a copy of the
    whole expression.  A filter on a generated column stays above, so costly text
    work is not repeated in filters.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(made)))
