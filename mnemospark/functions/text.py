"""Text analysis as Column expressions: tokens, intent, preference, halls,
entities, dialect, names and ids.  Everything here runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.columns import WHITESPACE as WS_CHARS
from mnemospark.functions.columns import (
    WHITESPACE_CLASS,
    col,
    contains_any,
    let,
    lines_of,
    quoted,
    sql_any,
    sql_best,
    sql_byte_prefix,
    sql_count,
    sql_prefix,
    sql_squeeze,
    sql_trim,
    squeeze_ws,
    trim_ws,
)

# A token is a maximal run of letters and digits holding at least two bytes, so
# one ASCII character is no token but one accented letter is.
WS_SPLIT = WHITESPACE_CLASS + "+"
_ALNUM = r"\p{IsAlphabetic}\p{N}"
# The ASCII range comes first and the run is possessive: both only save time.
TOKEN_PATTERN = rf"[a-z0-9{_ALNUM}]{{2,}}+|[{_ALNUM}&&[^\x00-\x7F]]"
RUN = rf"[a-z0-9{_ALNUM}]+"
#: Runs of letters and digits and what lies between them; put together they are the text.
PIECE_PATTERN = rf"{RUN}|[^a-z0-9{_ALNUM}]+"
SENTENCE_PATTERN = r"[^.!?\n]*[.!?\n]|[^.!?\n]+\z"
# Non-greedy pairs of fence lines; an unclosed fence runs to the end.
FENCED_BLOCK_PATTERN = r"(?msd)^[^\S\n]*```.*?(?:^[^\S\n]*```[^\n]*$|\z)"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


# ------------------------------------------------------------------- intent
def query_intent(query: str) -> Column:
    """Intent of the query in a column."""
    tests = [
        ("preference", sql_any("q", fv.INTENT_PREFERENCE)),
        ("temporal", sql_any("q", fv.INTENT_TEMPORAL)),
        ("decision", sql_any("q", fv.INTENT_DECISION)),
        ("how_to", sql_prefix("q", fv.INTENT_HOW_TO_PREFIXES) + " OR " + sql_any("q", fv.INTENT_HOW_TO)),
        ("definition", sql_prefix("q", fv.INTENT_DEFINITION_PREFIXES)),
    ]
    whens = " ".join(f"WHEN {test} THEN '{name}'" for name, test in tests)
    flat = sql_squeeze(f"lower({query})")
    return F.expr(f"transform(array({flat}), q -> CASE {whens} ELSE 'unknown' END)[0]")


# --------------------------------------------------------------- preference
def sql_is_preference(text: str) -> str:
    # Lower-cased once, not once per needle: filters share no subexpressions.
    return f"transform(array(lower({text})), p -> {sql_any('p', fv.PREFERENCE_NEEDLES)})[0]"


def is_preference(text: str) -> Column:
    return F.expr(sql_is_preference(text))


def sql_preference_span(text: str) -> str:
    """First sentence that states a preference, else the whole text if it does."""
    whole = sql_trim(text)
    sentences = (
        f"transform(regexp_extract_all({text}, {quoted(SENTENCE_PATTERN)}, 0), s -> {sql_trim('s')})"
    )
    first = f"get(filter({sentences}, s -> s <> '' AND {sql_is_preference('s')}), 0)"
    return f"CASE WHEN {sql_is_preference(whole)} THEN coalesce({first}, {whole}) END"


def states_preference(text: str) -> Column:
    """True exactly where ``preference_span`` finds one, without looking for it."""
    return F.expr(sql_is_preference(sql_trim(text)))


def preference_span(text: str) -> Column:
    return F.expr(sql_preference_span(text))


# ----------------------------------------------------------- halls and rooms
def detect_hall(text: str) -> Column:
    """Hall with most distinct keywords; the later hall wins a tie."""
    return F.expr(_by_keywords(text, fv.HALL_KEYWORDS, fv.DEFAULT_HALL, last_wins=True))


def detect_convo_room(text: str, prefix_bytes: int | None = None) -> Column:
    """Topic of a transcript; ties go to the first listed topic.

    The whole text counts, or its first ``prefix_bytes`` if they are given.
    """
    head = text if prefix_bytes is None else sql_byte_prefix(text, prefix_bytes)
    return F.expr(_by_keywords(head, fv.CONVO_ROOM_KEYWORDS, fv.DEFAULT_ROOM, last_wins=False))


def _by_keywords(text: str, table: list, default: str, last_wins: bool) -> str:
    scores = [(label, sql_count("lc", words)) for label, words in table]
    return f"transform(array(lower({text})), lc -> {sql_best(scores, default, last_wins)})[0]"


def detect_file_room(relative_path: str, content: str, rooms: list[dict], prefix_bytes: int | None = None) -> Column:
    """Room of a file: by folder, then by file name, then by keyword count.

    Keywords are counted in the whole content, or in its first ``prefix_bytes``.

    ``rooms`` holds dicts with ``name`` and ``keywords``.
    """
    if not rooms:
        return F.lit(fv.DEFAULT_ROOM)
    words = {r["name"]: [r["name"], *[k for k in r.get("keywords", []) if k]] for r in rooms}
    whens = []
    for name, ws in words.items():
        hit = " OR ".join(
            f"contains({quoted(w.lower())}, part) OR contains(part, {quoted(w.lower())})" for w in ws
        )
        whens.append(f"WHEN {hit} THEN {quoted(name)}")
    parts = f"split(lower({relative_path}), '/')"
    folders = f"slice({parts}, 1, size({parts}) - 1)"
    by_folder = f"get(filter(transform({folders}, part -> CASE {' '.join(whens)} END), r -> r IS NOT NULL), 0)"
    stem = f"regexp_replace(element_at({parts}, -1), {quoted(r'(?<=.)[.][^.]*$')}, '')"
    names = " ".join(
        f"WHEN contains({quoted(n.lower())}, stem) OR contains(stem, {quoted(n.lower())}) THEN {quoted(n)}"
        for n in words
    )
    by_name = f"transform(array({stem}), stem -> CASE {names} END)[0]"
    counts = [
        (
            name,
            " + ".join(
                f"(octet_length(lc) - octet_length(replace(lc, {quoted(w.lower())}, ''))) "
                f"div {len(w.lower().encode())}"
                for w in ws
            ),
        )
        for name, ws in words.items()
    ]
    head = f"lower({content if prefix_bytes is None else sql_byte_prefix(content, prefix_bytes)})"
    by_words = f"transform(array({head}), lc -> {sql_best(counts, fv.DEFAULT_ROOM, False)})[0]"
    return F.expr(f"coalesce({by_folder}, {by_name}, {by_words})")


# ----------------------------------------------------------------- entities
def _entity_kind(name: Column) -> Column:
    agents = [a.lower() for a in fv.AGENT_NAMES]
    return (
        F.when(F.lower(name).isin(agents), "agent_persona")
        .when(contains_any(name, fv.PROJECT_HINTS) | name.contains("-"), "project")
        .when(name.rlike(r"(?U)\S\s+\S"), "person")
        .otherwise("topic")
    )


def detect_entities(text: Column | str) -> Column:
    """Sorted array of (name, kind); a dialogue speaker is always a person."""
    text = col(text)

    def matches(pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.filter(
            F.transform(found, trim_ws),
            lambda n: (F.octet_length(n) >= 2) & ~n.isin(fv.ENTITY_STOP_WORDS),
        )

    speakers = matches(fv.DIALOGUE_NAME_PATTERN.replace("(?m)", "(?Umd)"), 1)
    camel = matches("(?U)" + fv.CAMEL_CASE_PATTERN, 0)
    titles = matches("(?U)" + fv.TITLE_NAME_PATTERN, 0)

    def with_kind(spoken: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.concat(spoken, camel, titles)))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("name"),
                F.when(F.array_contains(spoken, n), "person")
                .otherwise(_entity_kind(n))
                .alias("kind"),
            ),
        )

    return let(speakers, with_kind)


def entity_metadata(text: Column | str) -> Column:
    return F.to_json(F.struct(detect_entities(text).alias("entities")))


def agent_personas(text: str) -> Column:
    hits = ", ".join(
        f"IF(contains(lower({text}), {quoted(a.lower())}), {quoted(a)}, NULL)"
        for a in sorted(fv.AGENT_NAMES)
    )
    return F.expr(f"filter(array({hits}), a -> a IS NOT NULL)")


def corpus_platform(text: str) -> Column:
    signs = fv.TURN_MARKERS + [a.lower() for a in fv.AGENT_NAMES]
    dialogue = F.expr(sql_any(f"lower({text})", signs))
    return F.when(dialogue, "ai_dialogue").otherwise("project_files")


def capitalised_words(text: Column | str) -> Column:
    """Words that may be names: capital first letter, letters or '-' after it."""
    words = F.split(trim_ws(text), WS_SPLIT)
    clean = F.transform(
        words, lambda w: F.regexp_replace(w, rf"^[^{_ALNUM}]+|[^{_ALNUM}]+$", "")
    )
    return F.filter(
        clean,
        lambda w: (F.octet_length(w) > 2)
        & w.rlike(r"^\p{IsUppercase}[\p{IsAlphabetic}-]*$")
        & ~w.isin(fv.CAPITALISED_SKIP_WORDS),
    )


# ------------------------------------------------------------------- dialect
def dialect_compress(text: Column | str) -> Column:
    """Drop rules and extra blank lines, then abbreviate whole phrases in order."""
    lines = F.transform(lines_of(text), lambda s: F.rtrim(s, F.lit(WS_CHARS)))
    kept = F.filter(lines, lambda s: ~s.rlike(r"^(?:-{3,}|_{3,}|\*{3,})$"))
    body = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    out = F.btrim(body, F.lit("\n"))
    for phrase, short in fv.DIALECT_ABBREVIATIONS:
        bounded = rf"(?i)(?<!\p{{IsAlphabetic}}){phrase}(?!\p{{IsAlphabetic}})"
        out = F.regexp_replace(out, bounded, short)
    return F.concat(F.lit(fv.DIALECT_PREFIX), out)


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.octet_length(col(text)) / 4).cast("long")


def compression_ratio(original: Column | str, compressed: Column | str) -> Column:
    before, after = token_estimate(original), token_estimate(compressed)
    ratio = F.when(before > 0, after / before).otherwise(1.0)
    return F.round(ratio * 1000) / 1000


# --------------------------------------------------------------- short texts
def snippet(text: Column | str, size: int) -> Column:
    """One-line snippet of at most ``size`` characters, dots included."""
    flat = F.replace(trim_ws(text), F.lit("\n"), F.lit(" "))
    return F.when(
        F.char_length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))
    ).otherwise(flat)


def compact(text: Column | str, size: int) -> Column:
    flat = squeeze_ws(text)
    return F.when(
        F.char_length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))
    ).otherwise(flat)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


# ------------------------------------------------------------ names and ids
def wing_name(name: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(trim_ws(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def wing_slug(directory: Column | str) -> Column:
    return F.translate(F.lower(base_name(directory)), " -", "__")


def diary_wing(agent: Column | str) -> Column:
    return F.concat(F.lit(fv.DIARY_WING_PREFIX), F.replace(F.lower(col(agent)), F.lit(" "), F.lit("_")))


def topic_room(topic: Column | str) -> Column:
    return F.concat(F.lit("topic:"), wing_name(topic))


def entity_id(name: Column | str) -> Column:
    spaced = F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))
    return F.replace(spaced, F.lit("'"), F.lit(""))


def predicate_id(name: Column | str) -> Column:
    return F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))


def _digest(parts: list, size: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, size)


def drawer_id(wing, room, source_file, chunk_index) -> Column:
    parts = [col(wing), col(room), col(source_file), col(chunk_index).cast("string")]
    return F.concat_ws("_", F.lit("drawer"), parts[0], parts[1], _digest(parts, 16))


def diary_id(wing, timestamp, content) -> Column:
    parts = [col(wing), col(timestamp).cast("string"), F.substring(col(content), 1, 50)]
    return F.concat_ws("_", F.lit("diary"), parts[0], _digest(parts, 16))


def closet_id(wing, room, topic) -> Column:
    parts = [col(wing), col(room), col(topic)]
    return F.concat_ws("_", F.lit("closet"), parts[0], parts[1], _digest(parts, 16))


def tunnel_id(wing_a, room_a, wing_b, room_b, kind) -> Column:
    parts = [col(c) for c in (wing_a, room_a, wing_b, room_b, kind)]
    return F.concat(F.lit("tunnel_"), _digest(parts, 16))


def triple_id(subject, predicate, object_, stamp) -> Column:
    parts = [col(subject), col(predicate), col(object_), col(stamp).cast("string")]
    return F.concat_ws("_", F.lit("t"), *parts[:3], _digest(parts, 8))


def query_hash(query: Column | str) -> Column:
    flat = squeeze_ws(query)
    return F.when(flat != "", F.sha2(F.lower(flat), 256))


def drawer_references(text: Column | str) -> Column:
    """Ids of drawers and diary entries cited in a text."""
    words = F.split(col(text), "[^A-Za-z0-9_]+")
    return F.filter(words, lambda w: w.startswith("drawer_") | w.startswith("diary_"))


def canonical_language(code: Column | str) -> Column:
    clean = F.replace(F.lower(trim_ws(code)), F.lit("_"), F.lit("-"))
    return F.when(clean.isin([c for c, _, _ in fv.LOCALES]), clean)


def supported_languages() -> list[str]:
    return [code for code, _, _ in fv.LOCALES]


def locale(code: str) -> dict | None:
    """Letter class and boundary rule of a language code, in any spelling."""
    clean = code.strip().lower().replace("_", "-")
    for known, pattern, boundary in fv.LOCALES:
        if known == clean:
            return {"code": known, "candidate_pattern": pattern, "boundary_chars": boundary}
    return None
