"""Usage analytics over ``usage_events`` and stored feedback.

``events`` needs: id, ts, session_id, project, tool, wing, room, query_hash,
result_count, est_tokens_saved, duration_ms, outcome, meta (JSON text).
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import text as t
from mnemospark.operators.ordered import neighbour


# ------------------------------------------------------------------ windows
def parse_window(text: str) -> timedelta | None:
    """``7d``, ``24h`` or ``all`` (None)."""
    clean = text.strip()
    if clean.lower() == "all":
        return None
    match = re.fullmatch(r"([+-]?\d+)([dh])", clean)
    if not match:
        raise ValueError("window must be like 7d, 24h, or all")
    amount = int(match.group(1))
    if amount <= 0:
        raise ValueError("window must be greater than zero")
    return timedelta(days=amount) if match.group(2) == "d" else timedelta(hours=amount)


def window_label(text: str) -> str:
    return "all time" if text.strip().lower() == "all" else f"last {text.strip()}"


def in_scope(
    events: DataFrame, project: str | None, since: str, as_of: Column
) -> DataFrame:
    """Events of one project and window; both filters reach the scan."""
    if project is not None:
        events = events.filter(F.col("project") == project)
    length = parse_window(since)
    if length is not None:
        events = events.filter(F.col("ts") >= as_of - F.lit(length))
    return events


def _is_repeat_meta() -> Column:
    flag = F.get_json_object("meta", "$.is_repeat")
    return F.coalesce(flag == "true", F.lit(False))


# --------------------------------------------------------------------- KPIs
def _sums() -> list[Column]:
    def when_sum(outcome: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == outcome, value)), F.lit(0))

    return [
        F.count(F.lit(1)).alias("tool_calls"),
        F.count_if(F.col("outcome") == "hit").alias("search_hits"),
        F.coalesce(F.sum("est_tokens_saved"), F.lit(0)).alias("tokens_saved_est"),
        F.count_if(F.col("outcome") == "duplicate_skip").alias("duplicate_skips"),
        when_sum("kg_fact", F.col("result_count")).alias("kg_facts_recalled"),
        when_sum("diary_recall", F.col("result_count")).alias("diary_recalls"),
    ]


def repeat_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Repeats per ``by``: same question seen earlier, or flagged at write time.

    Only the first event of a question needs a look at its flag, so a grouped
    ``min_by`` replaces a window over every event of a hot question.
    """
    flagged = events.withColumn("_flag", _is_repeat_meta())
    hashed = (
        flagged.filter(F.col("query_hash").isNotNull())
        .groupBy(*by, "query_hash")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by("_flag", F.struct("ts", "id")).cast("long").alias("_first"),
        )
        .select(*by, (F.col("_n") - 1 + F.col("_first")).alias("_r"))
    )
    unhashed = (
        flagged.filter(F.col("query_hash").isNull() & F.col("_flag"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_r"))
    )
    both = hashed.unionByName(unhashed)
    return both.groupBy(*by).agg(F.sum("_r").alias("repeat_questions_avoided"))


def kpis(events: DataFrame) -> DataFrame:
    """One row of totals."""
    searches = F.count_if(F.col("tool") == "search")
    base = events.agg(
        *_sums(),
        F.count_distinct("session_id").alias("sessions"),
        searches.alias("search_calls"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )
    repeats = repeat_counts(events, []).select("repeat_questions_avoided").scalar()
    rate = F.when(F.col("search_calls") > 0, F.col("search_hits") / F.col("search_calls"))
    return base.withColumns(
        {
            "hit_rate": F.coalesce(rate, F.lit(0.0)),
            "repeat_questions_avoided": F.coalesce(repeats, F.lit(0)),
        }
    )


def by_project(events: DataFrame) -> DataFrame:
    base = events.groupBy("project").agg(*_sums())
    full = base.join(repeat_counts(events, ["project"]), "project", "left").withColumn(
        "repeat_questions_avoided", F.coalesce("repeat_questions_avoided", F.lit(0))
    )
    # Integer division truncates toward zero.
    score = (
        F.expr(f"tokens_saved_est div {fv.TOKENS_PER_VALUE_POINT}")
        + F.col("duplicate_skips") * fv.VALUE_PER_DUPLICATE
        + F.col("kg_facts_recalled") * fv.VALUE_PER_KG_FACT
        + F.col("diary_recalls") * fv.VALUE_PER_DIARY
        + F.col("repeat_questions_avoided") * fv.VALUE_PER_REPEAT
    )
    return full.withColumn("value_score", score).orderBy(
        F.desc("value_score"), F.desc("tokens_saved_est"), "project"
    )


# ---------------------------------------------------------------- latencies
def percentiles(
    values: DataFrame, by: list[str], value: str, points: dict[str, int]
) -> DataFrame:
    """Element at rank ceil((n-1)p/100) of the sorted values of each group.

    Equal values are counted first, so what is ordered per group is its distinct
    values, never its rows.
    """
    histogram = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy(value)
    ranked = histogram.withColumns(
        {
            "_upto": F.sum("_n").over(order),
            "_all": F.sum("_n").over(Window.partitionBy(*by)),
        }
    )
    found = {
        name: F.min(
            F.when(
                F.col("_upto") > F.ceil((F.col("_all") - 1) * F.lit(p) / F.lit(100)),
                F.col(value),
            )
        )
        for name, p in points.items()
    }
    return ranked.groupBy(*by).agg(
        F.sum("_n").alias("calls"), *[c.alias(n) for n, c in found.items()]
    )


_POINTS = {"p50_latency_ms": 50, "p95_latency_ms": 95}


def tool_latency(events: DataFrame) -> DataFrame:
    rows = percentiles(events.select("tool", "duration_ms"), ["tool"], "duration_ms", _POINTS)
    return rows.orderBy(F.desc("calls"), "tool")


def exact_points(values: DataFrame, value: str, points: dict[str, int], ranges: int = 1024) -> dict[str, int]:
    """As ``percentiles`` for whole numbers of one group of any size: {"calls": rows, name: value, ...}; {} without rows.

    Each round counts values by range and goes on with the one range that holds the rank, so nothing
    is sorted or brought together but at most ``ranges`` counts a point: 64-bit values take seven rounds at most.
    """
    v = F.col(value).cast("long")
    calls, known, low, high = values.agg(F.count(F.lit(1)), F.count(v), F.min(v), F.max(v)).first()
    if not calls:
        return {}
    # Missing values come first in the order, and are never the answer.
    rank = {name: max(-(-(calls - 1) * p // 100) - (calls - known), 0) for name, p in points.items()}
    span = {name: (low, high) for name in points} if known else {}
    while todo := [name for name, (lo, hi) in span.items() if lo < hi]:
        wide = {name: -(-(span[name][1] - span[name][0] + 1) // ranges) for name in todo}
        marks = [
            F.when(v.between(*span[name]), F.struct(F.lit(name).alias("name"), F.expr(f"CAST(({v_sql(value)} - {span[name][0]}) DIV {wide[name]} AS INT)").alias("at")))
            for name in todo
        ]
        counted = values.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.name", "m.at").agg(F.count(F.lit(1)).alias("n"))
        found: dict[str, list] = {name: [] for name in todo}
        for row in counted.collect():
            found[row["name"]].append((row["at"], row["n"]))
        for name, counts in found.items():
            for at, n in sorted(counts):
                if rank[name] < n:
                    break
                rank[name] -= n
            lo = span[name][0] + at * wide[name]
            span[name] = (lo, min(span[name][1], lo + wide[name] - 1))
    return {"calls": calls} | {name: span[name][0] if known else None for name in points}


def v_sql(value: str) -> str:
    """A whole number as a decimal, whose differences do not overflow."""
    return f"CAST(CAST({value} AS BIGINT) AS DECIMAL(38, 0))"


def overall_latency(events: DataFrame) -> DataFrame:
    """(calls, p50_latency_ms, p95_latency_ms) of all events; no row without events."""
    found = exact_points(events.select("duration_ms"), "duration_ms", _POINTS)
    schema = ", ".join(f"{name} long" for name in ("calls", *_POINTS))
    return events.sparkSession.createDataFrame([tuple(found.values())] if found else [], schema)


# ------------------------------------------------------------ top and recent
def _top(rows: DataFrame, name: Column) -> DataFrame:
    counted = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "name").limit(fv.TOP_COUNT_LIMIT)


def top_places(events: DataFrame, place: str) -> DataFrame:
    """Wings or rooms with most useful events."""
    useful = F.col("outcome").isin(fv.VALUE_OUTCOMES) & F.col(place).isNotNull()
    return _top(events.filter(useful), F.col(place))


def top_queries(events: DataFrame) -> DataFrame:
    """Most asked questions; single ones are dropped after the limit."""
    asked = events.filter(F.col("query_hash").isNotNull())
    top = _top(asked, F.substring("query_hash", 1, fv.QUERY_KEY_CHARS))
    return top.filter(F.col("count") > 1)


def history(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(n).select(
        "id", "ts", "project", "tool", "outcome", "result_count",
        F.col("est_tokens_saved").alias("tokens_saved_est"), "duration_ms",
    )


def save_status(events: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Whether memory was read and whether it was saved within the window."""
    recent = events.filter(F.col("ts") >= as_of - F.lit(timedelta(minutes=max(minutes, 0))))
    return recent.agg(
        F.coalesce(F.bool_or(F.col("tool").isin(fv.RECALL_TOOLS)), F.lit(False)).alias("engaged"),
        F.coalesce(F.bool_or(F.col("tool").isin(fv.SAVE_TOOLS)), F.lit(False)).alias("saved"),
    )


# ------------------------------------------------------------------ repeats
def repeat_flags(events: DataFrame) -> DataFrame:
    """(id, query_hash, is_repeat) for every event with a question.

    The first event per question is found by partial aggregation and joined
    back; the join side has one row per question.
    """
    asked = events.filter(F.col("query_hash").isNotNull())
    first = asked.groupBy("query_hash").agg(F.min(F.struct("ts", "id")).alias("_first"))
    flagged = asked.select("id", "ts", "query_hash", _is_repeat_meta().alias("_flag")).join(
        first, "query_hash"
    )
    return flagged.select(
        "id", "query_hash",
        (F.col("_flag") | (F.col("id") != F.col("_first.id"))).alias("is_repeat"),
    )


def repeats_within_day(events: DataFrame) -> DataFrame:
    """(id, is_repeat): the same question within the 24 hours before.

    Hour buckets keep a hot question from being ordered in one task.
    """
    asked = events.filter(F.col("query_hash").isNotNull()).select(
        "id", "ts", "query_hash", F.date_trunc("hour", "ts").alias("_hour")
    )
    near = neighbour(asked, ["query_hash"], "_hour", ["ts", "id"], ["ts"], -1)
    window = F.lit(timedelta(hours=fv.REPEAT_WINDOW_HOURS))
    seen = F.coalesce(F.col("ts_near") >= F.col("ts") - window, F.lit(False))
    return near.select("id", "query_hash", seen.alias("is_repeat"))


# ----------------------------------------------------------------- feedback
def search_samples(events: DataFrame) -> DataFrame:
    """Searches that carry a query id and at least one returned drawer."""
    ids = F.from_json(F.get_json_object("meta", "$.top_drawer_ids"), "array<string>")
    rows = events.filter(F.col("tool") == "search").select(
        "id", "ts", "session_id",
        F.get_json_object("meta", "$.query_id").alias("query_id"),
        F.coalesce(F.get_json_object("meta", "$.intent"), F.lit("unknown")).alias("intent"),
        F.filter(ids, F.isnotnull).alias("ids"),
        _is_repeat_meta().alias("flag"),
    )
    return rows.filter(F.col("query_id").isNotNull() & (F.size("ids") > 0))


def implicit_feedback(events: DataFrame) -> DataFrame:
    """Verdict on the top drawer of a search, from later events of its session.

    "A later event mentions one of my drawers" is the same as "the last mention
    of one of my drawers is later than I am": mentions shrink to one row per
    (session, drawer), and a hot session never meets itself.
    """
    at = F.struct("ts", "id")
    cited = (
        events.filter(F.col("tool") == "diary_write")
        .select(
            "session_id", at.alias("at"),
            F.explode(
                F.from_json(F.get_json_object("meta", "$.referenced_drawer_ids"), "array<string>")
            ).alias("drawer"),
        )
        .groupBy("session_id", "drawer")
        .agg(F.max("at").alias("cited_at"))
    )
    deleted = (
        events.filter(F.col("tool") == "delete_drawer")
        .select("session_id", at.alias("at"), F.get_json_object("meta", "$.drawer_id").alias("drawer"))
        .filter(F.col("drawer").isNotNull())
        .groupBy("session_id", "drawer")
        .agg(F.max("at").alias("deleted_at"))
    )
    mentions = cited.join(deleted, ["session_id", "drawer"], "full_outer")
    shown = search_samples(events).select(
        "id", "ts", "session_id", "query_id", F.get("ids", 0).alias("drawer_id"), "flag",
        F.explode("ids").alias("drawer"),
    )
    here = F.struct("ts", "id")
    seen = (
        shown.join(mentions, ["session_id", "drawer"], "left")
        .groupBy("id", "ts", "query_id", "drawer_id", "flag")
        .agg(
            F.bool_or(F.coalesce(F.col("cited_at") > here, F.lit(False))).alias("cited"),
            F.bool_or(F.coalesce(F.col("deleted_at") > here, F.lit(False))).alias("gone"),
        )
    )
    verdict = (
        F.when(F.col("cited"), "useful")
        .when(F.col("gone"), "wrong_answer")
        .when(F.col("flag"), "not_useful")
    )
    return seen.select(
        "id", "ts", "query_id", "drawer_id", verdict.alias("verdict")
    ).filter(F.col("verdict").isNotNull())


def all_feedback(events: DataFrame, explicit: DataFrame) -> DataFrame:
    """One verdict per (query, drawer): explicit wins, else the first inferred."""
    inferred = implicit_feedback(events).select(
        "query_id", "drawer_id", "verdict", F.lit(1).alias("_p"), "ts", "id"
    )
    given = explicit.select(
        "query_id", "drawer_id", "verdict", F.lit(0).alias("_p"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("id"),
    )
    both = inferred.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(given)
    return both.groupBy("query_id", "drawer_id").agg(
        F.min_by("verdict", F.struct("_p", "ts", "id")).alias("verdict")
    )


def _precision(judged: DataFrame, by: list[str]) -> DataFrame:
    useful = F.col("verdict") == "useful"
    return judged.groupBy(*by).agg(
        F.count("verdict").alias("samples"),
        F.avg(F.when((F.col("at") == 0) & F.col("verdict").isNotNull(), useful.cast("double"))).alias(
            "precision_at_1"
        ),
        F.avg(F.when(F.col("verdict").isNotNull(), useful.cast("double"))).alias("precision_at_5"),
    )


def _judged(events: DataFrame, explicit: DataFrame) -> DataFrame:
    shown = search_samples(events).select(
        "query_id", "intent", F.posexplode(F.slice("ids", 1, 5)).alias("at", "drawer_id")
    )
    return shown.join(all_feedback(events, explicit), ["query_id", "drawer_id"], "left")


def precision(events: DataFrame, explicit: DataFrame) -> DataFrame:
    return _precision(_judged(events, explicit), [])


def precision_by_intent(events: DataFrame, explicit: DataFrame) -> DataFrame:
    return _precision(_judged(events, explicit), ["intent"]).orderBy("intent")


def upsert_feedback(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Feedback after an upsert on (query_id, drawer_id, source)."""
    checked = incoming.withColumn(
        "verdict",
        F.when(F.col("verdict").isin(fv.VERDICTS), F.col("verdict")).otherwise(
            F.raise_error(F.lit("verdict must be " + ", ".join(fv.VERDICTS)))
        ),
    )
    key = ["query_id", "drawer_id", "source"]
    rest = [c for c in existing.columns if c not in key]
    both = existing.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    return (
        both.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct("_new", "created_at")).alias("r"))
        .select(*key, "r.*")
        .select(*existing.columns)
    )


# ------------------------------------------------------------ classification
def classify_calls(calls: DataFrame, average_tokens: Column) -> DataFrame:
    """Usage events from raw tool calls (tool, args JSON, result JSON, ...).

    Adds outcome, counts, savings and the meta keys that analytics read back.
    """
    def arg(path: str) -> Column:
        return F.nullif(F.trim(F.get_json_object("args", path)), F.lit(""))

    def res(path: str) -> Column:
        return F.get_json_object("result", path)

    def items(*paths: str) -> Column:
        return F.coalesce(*[F.json_array_length(res(p)) for p in paths], F.lit(0))

    tool = F.col("tool")
    size = F.octet_length("result")
    hits = items("$.results")
    matches = items("$.matches")
    facts = F.coalesce(
        res("$.count").try_cast("long"), items("$.facts", "$.relationships", "$.triples")
    )
    recalled = items("$.entries", "$.results", "$.last_session")
    is_search = tool == "search"
    is_check = tool == "check_duplicate"
    is_add = tool == "add_drawer"
    is_kg = tool == "kg_query"
    is_diary = tool.isin("diary_read", "diary_search", "session_context")
    failed = res("$.error").isNotNull()
    duplicate = (is_check & F.coalesce(res("$.is_duplicate") == "true", F.lit(False))) | (
        is_add & F.coalesce(res("$.reason") == "duplicate", F.lit(False))
    )
    outcome = (
        F.when(failed, "error")
        .when(is_search, F.when(hits > 0, "hit").otherwise("miss"))
        .when(duplicate, "duplicate_skip")
        .when(is_check, "miss")
        .when(is_kg, F.when(facts > 0, "kg_fact").otherwise("miss"))
        .when(is_diary, F.when(recalled > 0, "diary_recall").otherwise("miss"))
        .when(tool == "diary_write", "diary_write")
        .when(tool == "delete_drawer", "delete_drawer")
        .otherwise("noop")
    )
    count = (
        F.when(failed, 0)
        .when(is_search, hits)
        .when(is_check | duplicate, matches)
        .when(is_kg, facts)
        .when(is_diary, recalled)
        .otherwise(0)
    )
    earns = (
        (is_search & (hits > 0)) | (is_kg & (facts > 0)) | (is_diary & (recalled > 0))
    )
    saved = (
        F.when(failed, 0)
        .when(duplicate, average_tokens)
        .when(earns, F.floor(size / 4))
        .otherwise(0)
    )
    shown = F.from_json(res("$.results"), "array<struct<id:string>>")
    top_ids = F.slice(F.filter(F.transform(shown, lambda r: r["id"]), F.isnotnull), 1, 5)
    cited = t.drawer_references(F.coalesce(arg("$.entry"), F.lit("")))
    meta = (
        F.when(failed, F.lit("{}"))
        .when(
            is_search & (hits > 0),
            F.to_json(
                F.struct(
                    res("$.query_id").alias("query_id"), res("$.intent").alias("intent"),
                    F.coalesce(res("$.rerank_enabled") == "true", F.lit(False)).alias("rerank_enabled"),
                    top_ids.alias("top_drawer_ids"), F.get(top_ids, 0).alias("top_drawer_id"),
                )
            ),
        )
        .when(is_kg & (facts > 0), F.to_json(F.struct(facts.alias("facts"))))
        .when(
            (tool == "diary_write") & (F.size(cited) > 0),
            F.to_json(F.struct(cited.alias("referenced_drawer_ids"))),
        )
        .when(
            (tool == "delete_drawer") & arg("$.drawer_id").isNotNull(),
            F.to_json(F.struct(arg("$.drawer_id").alias("drawer_id"))),
        )
        .otherwise(F.lit("{}"))
    )

    def place(name: str) -> Column:
        from_first = F.when(is_search & ~failed, res(f"$.results[0].{name}")).when(
            is_add & ~failed, res(f"$.{name}")
        )
        return F.coalesce(arg(f"$.{name}"), F.nullif(F.trim(from_first), F.lit("")))

    similarity = F.when(~failed & is_search, res("$.results[0].similarity")).when(
        ~failed & (is_check | duplicate), res("$.matches[0].similarity")
    )
    asked = F.coalesce(arg("$.query"), arg("$.entity"), arg("$.content"))
    return calls.withColumns(
        {
            "wing": place("wing"),
            "room": place("room"),
            "query_hash": t.query_hash(asked),
            "result_count": count.cast("long"),
            "top_similarity": similarity.try_cast("double"),
            "bytes_returned": size.cast("long"),
            "est_tokens_saved": saved.cast("long"),
            "outcome": outcome,
            "meta": meta,
        }
    ).drop("args", "result")


def mark_repeats(events: DataFrame, earlier: DataFrame) -> DataFrame:
    """Sets meta.is_repeat on events whose question occurred in the last day."""
    both = earlier.select("id", "ts", "query_hash").unionByName(
        events.select("id", "ts", "query_hash")
    )
    flags = repeats_within_day(both).filter("is_repeat").select("id", "is_repeat")
    joined = events.join(flags, "id", "left")
    with_flag = F.when(
        F.col("meta") == "{}", F.lit('{"is_repeat":true}')
    ).otherwise(F.concat(F.expr("substring(meta, 1, length(meta) - 1)"), F.lit(',"is_repeat":true}')))
    return joined.withColumn(
        "meta", F.when(F.col("is_repeat"), with_flag).otherwise(F.col("meta"))
    ).drop("is_repeat")
