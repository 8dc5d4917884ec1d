"""Score columns for one literal query.

Whatever depends on the query alone is decided here in Python while the plan is
built, so the plan holds only the checks on text and room that can still differ
from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import text as t
from mnemospark.functions.columns import quoted, sql_any


def recency(filed_at: Column, as_of: Column) -> Column:
    """Bonus that decays with the whole days since filing; 0 without a time."""
    seconds = F.unix_micros(as_of) - F.unix_micros(filed_at)
    days = F.greatest(F.floor(seconds / F.lit(86_400_000_000)), F.lit(0))
    bonus = F.lit(fv.RECENCY_WEIGHT) * F.exp(F.lit(-fv.RECENCY_DECAY_PER_DAY) * days)
    return F.coalesce(bonus, F.lit(0.0))


def coding_boost(query: str, text_lc: str, room_lc: str) -> str:
    """SQL text of the boost; ``text_lc`` and ``room_lc`` name lower-cased columns."""
    low = query.lower()
    terms = ["0.0D"]

    def rule(r: dict) -> str:
        in_text = sql_any(text_lc, r["text"])
        in_room = f"{room_lc} IN ({', '.join(quoted(x) for x in r['rooms'])})"
        amount = r["amount"]
        return (
            f"CASE WHEN {in_text} THEN IF({in_room}, {amount}D, {amount * fv.BOOST_TEXT_ONLY}D) "
            f"WHEN {in_room} THEN {amount * fv.BOOST_ROOM_ONLY}D ELSE 0.0D END"
        )

    def flat(test: str, amount: float) -> str:
        return f"IF({test}, {amount}D, 0.0D)"

    terms += [rule(r) for r in fv.BOOST_RULES if any(n in low for n in r["query"])]
    if q.classify(query) == "preference":
        terms.append(flat(sql_any(text_lc, fv.STATED_PREFERENCE_NEEDLES), fv.STATED_PREFERENCE_BOOST))
    terms += [
        flat(sql_any(text_lc, [in_text]), amount)
        for needles, in_text, amount in fv.PAIR_BOOSTS
        if any(n in low for n in needles)
    ]
    terms.append(flat(sql_any(text_lc, [low]), fv.PHRASE_BOOST))
    return f"least({' + '.join(terms)}, {fv.MAX_CODING_BOOST}D)"


def preference_match(query: str, text: str, room_lc: str) -> str:
    """SQL text of the preference bonus."""
    if q.classify(query) != "preference":
        return "0.0D"
    words = sorted({w for w in q.tokenize(query.lower()) if len(w.encode()) > 3})
    rooms = ", ".join(quoted(x) for x in fv.PREFERENCE_ROOMS)
    span_hit = "false"
    if words:
        span = f"lower({t.sql_preference_span(text)})"
        span_hit = f"transform(array({span}), s -> {sql_any('s', words)})[0]"
    score = (
        f"{fv.PREFERENCE_BASE}D + IF({room_lc} IN ({rooms}), {fv.PREFERENCE_ROOM_BONUS}D, 0.0D) "
        f"+ IF({span_hit}, {fv.PREFERENCE_SPAN_BONUS}D, 0.0D)"
    )
    capped = f"least({score}, {fv.MAX_PREFERENCE_MATCH}D)"
    return f"IF({t.sql_is_preference(text)}, {capped}, 0.0D)"


def highest_bonus(query: str) -> float:
    """No drawer can get more than this on top of its cosine and BM25 share."""
    low = query.lower()
    total = fv.PHRASE_BOOST
    total += sum(r["amount"] for r in fv.BOOST_RULES if any(n in low for n in r["query"]))
    total += sum(a for needles, _, a in fv.PAIR_BOOSTS if any(n in low for n in needles))
    asks_preference = q.classify(query) == "preference"
    if asks_preference:
        total += fv.STATED_PREFERENCE_BOOST
    match = fv.MAX_PREFERENCE_MATCH if asks_preference else 0.0
    return min(total, fv.MAX_CODING_BOOST) + match + fv.RECENCY_WEIGHT


# ------------------------------------------------------ a table of questions
def asked(questions: DataFrame) -> DataFrame:
    """(qid, query, _low, _rules, _pairs, _prefers, _words, bonus) of questions (qid, query).

    What depends on a question alone, once per question: which rules and pairs its text calls, and the
    most that boost and preference bonus can come to.
    """
    low = F.lower("query")
    rules = [sql_any("_low", r["query"]) for r in fv.BOOST_RULES]
    pairs = [sql_any("_low", needles) for needles, _, _ in fv.PAIR_BOOSTS]
    rows = questions.select("qid", "query", low.alias("_low"), (t.query_intent("query") == "preference").alias("_prefers")).withColumns(
        {
            "_rules": F.expr(f"array({', '.join(rules)})"),
            "_pairs": F.expr(f"array({', '.join(pairs)})"),
            "_words": F.filter(F.array_distinct(t.tokens("query")), lambda w: F.octet_length(w) > 3),
        }
    )
    amounts = [f"IF(_rules[{i}], {r['amount']}D, 0.0D)" for i, r in enumerate(fv.BOOST_RULES)]
    amounts += [f"IF(_pairs[{i}], {amount}D, 0.0D)" for i, (_, _, amount) in enumerate(fv.PAIR_BOOSTS)]
    amounts += [f"IF(_prefers, {fv.STATED_PREFERENCE_BOOST}D, 0.0D)", f"{fv.PHRASE_BOOST}D"]
    bonus = f"least({' + '.join(amounts)}, {fv.MAX_CODING_BOOST}D) + IF(_prefers, {fv.MAX_PREFERENCE_MATCH}D, 0.0D)"
    return rows.withColumn("bonus", F.expr(bonus))


def asked_boost(text_lc: str, room_lc: str) -> str:
    """The boost of a row that carries its question's columns."""
    terms = []
    for i, r in enumerate(fv.BOOST_RULES):
        rooms = f"{room_lc} IN ({', '.join(quoted(x) for x in r['rooms'])})"
        amount = r["amount"]
        terms.append(
            f"CASE WHEN NOT _rules[{i}] THEN 0.0D WHEN {sql_any(text_lc, r['text'])} "
            f"THEN IF({rooms}, {amount}D, {amount * fv.BOOST_TEXT_ONLY}D) "
            f"WHEN {rooms} THEN {amount * fv.BOOST_ROOM_ONLY}D ELSE 0.0D END"
        )
    stated = sql_any(text_lc, fv.STATED_PREFERENCE_NEEDLES)
    terms.append(f"IF(_prefers AND {stated}, {fv.STATED_PREFERENCE_BOOST}D, 0.0D)")
    terms += [
        f"IF(_pairs[{i}] AND {sql_any(text_lc, [in_text])}, {amount}D, 0.0D)"
        for i, (_, in_text, amount) in enumerate(fv.PAIR_BOOSTS)
    ]
    terms.append(f"IF(contains({text_lc}, _low), {fv.PHRASE_BOOST}D, 0.0D)")
    return f"least({' + '.join(terms)}, {fv.MAX_CODING_BOOST}D)"


def asked_preference(text: str, room_lc: str) -> str:
    """The preference bonus of a row that carries its question's columns."""
    rooms = ", ".join(quoted(x) for x in fv.PREFERENCE_ROOMS)
    span = f"transform(array(lower({t.sql_preference_span(text)})), s -> exists(_words, w -> contains(s, w)))[0]"
    score = (
        f"{fv.PREFERENCE_BASE}D + IF({room_lc} IN ({rooms}), {fv.PREFERENCE_ROOM_BONUS}D, 0.0D) "
        f"+ IF({span}, {fv.PREFERENCE_SPAN_BONUS}D, 0.0D)"
    )
    return f"IF(_prefers AND {t.sql_is_preference(text)}, least({score}, {fv.MAX_PREFERENCE_MATCH}D), 0.0D)"


def interaction_score(query: str, text: str) -> Column:
    """Share of query words in the text, plus phrase and preference bonuses."""
    low = query.lower()
    words = sorted(
        {w for w in q.tokenize(low) if len(w.encode()) > 2 and w not in fv.RERANK_STOP_WORDS}
    )
    if not words:
        return F.lit(0.0)
    wanted = F.array(*[F.lit(w) for w in words])
    shared = F.size(F.array_intersect(t.tokens(text), wanted)) / F.lit(len(words))
    score = shared * 0.75 + F.when(F.lower(text).contains(low), 0.25).otherwise(0.0)
    if q.classify(query) == "preference":
        score = score + F.when(t.is_preference(text), 0.20).otherwise(0.0)
    return F.least(score, F.lit(1.0))
