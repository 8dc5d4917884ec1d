"""Message lines and long session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t
from mnemospark.functions.columns import contains_any, let, lines_of, squeeze_ws, trim_ws


def message_rows(files: DataFrame) -> DataFrame:
    """One row per JSON line with text: path, line number, ``role: content``.

    Lines that are no JSON and blank messages are left out; numbers stay those of
    the file.
    """
    numbered = files.filter(F.col("path").endswith(".jsonl")).select(
        "path", F.posexplode(lines_of("content")).alias("chunk_index", "_line")
    )

    def first_key(*keys: str) -> Column:
        return F.coalesce(*[F.get_json_object("_line", f"$.{k}") for k in keys])

    role = F.coalesce(first_key("role", "type"), F.lit("message"))
    body = first_key("content", "text")
    rows = numbered.withColumns({"_role": role, "_body": body})
    return rows.filter(trim_ws("_body") != "").select(
        "path", "chunk_index", F.concat("_role", F.lit(": "), "_body").alias("content")
    )


def _boundaries(lines: Column) -> Column:
    def opens(i: Column) -> Column:
        near = F.array_join(F.slice(lines, i + 1, fv.SESSION_LOOKAHEAD_LINES), "")
        return F.get(lines, i).contains(fv.SESSION_BANNER) & ~contains_any(
            near, fv.SESSION_RESTORE_MARKERS
        )

    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), opens)


def session_parts(
    files: DataFrame, stamp_lines: int | None = None, people_lines: int | None = None
) -> DataFrame:
    """Sessions of logs with two or more: path, part number, lines, file name.

    The name's stamp and people come from so many first lines of a session (None: all).  A log is one row, so its sessions are cut inside the row without a shuffle.
    """
    def cut(lines: Column) -> Column:
        return let(
            _boundaries(lines),
            lambda starts: F.transform(
                starts,
                lambda at, i: F.struct(
                    (i + 1).alias("part"),
                    F.size(starts).alias("sessions"),
                    F.slice(
                        lines, at + 1, F.coalesce(F.get(starts, i + 1), F.size(lines)) - at
                    ).alias("lines"),
                ),
            ),
        )

    parts = files.select("path", F.inline(let(lines_of("content"), cut)))
    kept = parts.filter(
        (F.col("sessions") >= 2) & (F.size("lines") >= fv.MIN_SESSION_LINES)
    )
    return kept.withColumn("file_name", file_name(F.col("path"), F.col("part"), F.col("lines"), stamp_lines, people_lines))


def first_lines(lines: Column, first: int | None) -> Column:
    return lines if first is None else F.slice(lines, 1, first)


def session_stamp(lines: Column, first: int | None = None) -> Column:
    """``YYYY-MM-DD_HHMMAM`` of the first dated line among the ``first`` lines (None: all)."""
    head = first_lines(lines, first)
    dated = F.get(F.filter(head, lambda s: s.rlike(fv.SESSION_TIMESTAMP_PATTERN)), 0)

    def group(n: int) -> Column:
        return F.regexp_extract(dated, fv.SESSION_TIMESTAMP_PATTERN, n)

    month = F.array_position(F.array(*[F.lit(m) for m in fv.MONTHS]), group(2))
    return F.when(
        dated.isNotNull(),
        F.concat(
            group(4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
            F.lpad(group(3), 2, "0"), F.lit("_"), F.regexp_replace(group(1), "[: ]", ""),
        ),
    )


def session_people(
    lines: Column, known: list[str] = fv.KNOWN_PEOPLE, first: int | None = None
) -> Column:
    text = F.array_join(first_lines(lines, first), "\n")
    names = F.array(*[F.when(text.rlike(rf"(?iU)\b{n}\b"), F.lit(n)) for n in sorted(known)])
    return F.filter(names, F.isnotnull)


def session_subject(lines: Column) -> Column:
    """First real prompt as a slug of at most 60 characters."""
    prompts = F.transform(
        F.filter(lines, lambda s: s.startswith("> ")), lambda s: trim_ws(F.substring(s, 3, 2**31 - 1))
    )
    real = F.get(
        F.filter(
            prompts,
            lambda p: (F.octet_length(p) > 5) & ~p.rlike(fv.SESSION_SKIP_PROMPT_PATTERN),
        ),
        0,
    )
    slug = F.replace(
        squeeze_ws(F.regexp_replace(real, r"(?U)[^\p{IsAlphabetic}\p{N}\s-]", "")), F.lit(" "), F.lit("-")
    )
    return F.coalesce(F.substring(slug, 1, 60), F.lit("session"))


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}.-]", "_"), "_+", "_")


def file_name(
    path: Column, part: Column, lines: Column,
    stamp_lines: int | None = None, people_lines: int | None = None,
) -> Column:
    stem = F.substring(clean_name(F.regexp_replace(t.base_name(path), r"(?<=.)\.[^.]*$", "")), 1, 40)
    stamp = F.coalesce(
        session_stamp(lines, stamp_lines), F.concat(F.lit("part"), F.lpad(part.cast("string"), 2, "0"))
    )
    people = F.array_join(F.slice(session_people(lines, first=people_lines), 1, 3), "-")
    who = F.when(people == "", "unknown").otherwise(people)
    return clean_name(
        F.concat(stem, F.lit("__"), stamp, F.lit("_"), who, F.lit("_"), session_subject(lines), F.lit(".txt"))
    )
