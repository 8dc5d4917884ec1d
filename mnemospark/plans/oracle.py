"""The same results in plain SQL for DuckDB, written against the raw tables.

Rule tables (word lists, boosts) are shared values; how they are evaluated is
written here on its own.
"""

from __future__ import annotations

from mnemospark.functions import fixed_values as fv
from mnemospark.plans import fixtures as fx
from mnemospark.plans.queries import DOC_QUERY, NOTE_QUERY, PREF_QUERY, PROBES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_text(s: str) -> str:
    """Spark reads \\n in a plain literal as a newline; DuckDB needs an E-string."""
    parts = s.split("'")
    for i in range(1, len(parts), 2):
        if "\\n" in parts[i]:
            parts[i - 1] += "E"
    return "'".join(parts)


def any_in(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def count_in(text: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({text}, {lit(n)}) THEN 1 ELSE 0 END)" for n in needles) + ")"


WS = "E' \\t\\n\\r'"
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2)"
TEXT = sql_text(fx.NOTE_TEXT)
QUESTION = sql_text(fx.QUESTION_TEXT)
META = sql_text(fx.META)

DRAWERS = """drawers AS (
 SELECT 'drawer_' || d.doc_id AS id, 'wing_' || ((d.doc_id // 5) % 20) AS wing, d.lang AS room,
  d.text AS content, 'file_' || (d.doc_id // 5) AS source_file, d.doc_id % 5 AS chunk_index,
  1704067200 + d.doc_id * 3600 AS filed, 3.0e0 + coalesce(l.quality, 0) - coalesce(l.toxic, 0) AS importance,
  e.embedding AS embedding
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
NOTES = f"""notes AS (
 SELECT o_orderkey, 'note_' || o_orderkey AS id, 'wing_' || (o_custkey % 25) AS wing, {fx.NOTE_ROOM} AS room,
  {TEXT} AS content, 'desk_' || (o_orderkey // 4) AS source_file, o_orderkey % 4 AS chunk_index,
  epoch(o_orderdate)::BIGINT AS filed, 1.0e0 + o_orderkey % 5 AS importance, e.embedding AS embedding
 FROM orders LEFT JOIN embeddings e
  ON e.vec_id = CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 7 % (SELECT count(*) FROM embeddings) END)"""


def terms_of(query: str) -> str:
    return f"terms AS (SELECT DISTINCT unnest({TOKENS.format(lit(query))}) AS term)"


def bm25_ctes(source: str, query: str, where: str = "TRUE") -> str:
    """tok, corpus, df, bm(id, bm25) over a source with id and content."""
    return f"""{terms_of(query)},
 tok AS (SELECT id, {TOKENS.format('content')} AS t FROM {source}),
 corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS al FROM tok),
 hit AS (SELECT id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM tok),
 tf AS (SELECT id, term, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM hit WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
 bm AS (SELECT tf.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS bm25
  FROM tf JOIN df USING (term) CROSS JOIN corpus JOIN {source} s ON s.id = tf.id WHERE {where} GROUP BY 1)"""


def cosine(vec_id: int, column: str = "embedding") -> str:
    return (
        f"round(list_cosine_similarity({column}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings "
        f"WHERE vec_id = {vec_id})) * 1000) / 1000"
    )


INTENT_TESTS = {
    "preference": lambda q: any_in(q, fv.INTENT_PREFERENCE),
    "temporal": lambda q: any_in(q, fv.INTENT_TEMPORAL),
    "decision": lambda q: any_in(q, fv.INTENT_DECISION),
    "how_to": lambda q: "("
    + " OR ".join(f"starts_with({q}, {lit(p)})" for p in fv.INTENT_HOW_TO_PREFIXES)
    + " OR "
    + any_in(q, fv.INTENT_HOW_TO)
    + ")",
    "definition": lambda q: "("
    + " OR ".join(f"starts_with({q}, {lit(p)})" for p in fv.INTENT_DEFINITION_PREFIXES)
    + ")",
}


def intent(query: str) -> str:
    flat = f"trim(regexp_replace(lower({query}), '\\s+', ' ', 'g'))"
    whens = " ".join(f"WHEN {test(flat)} THEN '{name}'" for name, test in INTENT_TESTS.items())
    return f"(CASE {whens} ELSE 'unknown' END)"


def is_pref(text: str) -> str:
    return any_in(f"lower({text})", fv.PREFERENCE_NEEDLES)


def pref_span(text: str) -> str:
    sentences = (
        f"list_filter(list_transform(regexp_extract_all({text}, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$'), "
        f"lambda s: trim(s, {WS})), lambda s: s <> '' AND {is_pref('s')})"
    )
    whole = f"trim({text}, {WS})"
    return f"(CASE WHEN {is_pref(whole)} THEN coalesce({sentences}[1], {whole}) END)"


def boost(query: str, text: str, room: str) -> str:
    q, t, r = f"lower({query})", f"lower({text})", f"lower({room})"
    parts = []
    for rule in fv.BOOST_RULES:
        rooms = ", ".join(lit(x) for x in rule["rooms"])
        a = rule["amount"]
        parts.append(
            f"(CASE WHEN NOT {any_in(q, rule['query'])} THEN 0 "
            f"WHEN {any_in(t, rule['text'])} AND {r} IN ({rooms}) THEN {a}e0 "
            f"WHEN {any_in(t, rule['text'])} THEN {a}e0 * 0.7e0 WHEN {r} IN ({rooms}) THEN {a}e0 * 0.45e0 ELSE 0 END)"
        )
    parts.append(
        f"(CASE WHEN {intent(query)} = 'preference' AND {any_in(t, fv.STATED_PREFERENCE_NEEDLES)} THEN 0.10e0 ELSE 0 END)"
    )
    for needles, in_text, amount in fv.PAIR_BOOSTS:
        parts.append(f"(CASE WHEN {any_in(q, needles)} AND contains({t}, {lit(in_text)}) THEN {amount}e0 ELSE 0 END)")
    parts.append(f"(CASE WHEN contains({t}, {q}) THEN 0.04e0 ELSE 0 END)")
    return "least(" + " + ".join(parts) + ", 0.65e0)"


def pref_match(query: str, text: str, room: str) -> str:
    words = f"list_filter({TOKENS.format(query)}, lambda w: strlen(w) > 3)"
    span_hit = f"len(list_filter({words}, lambda w: contains(lower({pref_span(text)}), w))) > 0"
    return (
        f"(CASE WHEN {intent(query)} = 'preference' AND {is_pref(text)} THEN least(0.22e0, 0.12e0 "
        f"+ (CASE WHEN lower({room}) IN ('preference', 'preferences') THEN 0.04e0 ELSE 0 END) "
        f"+ (CASE WHEN {span_hit} THEN 0.06e0 ELSE 0 END)) ELSE 0e0 END)"
    )


def recency(filed: str, as_of: int) -> str:
    return f"0.05e0 * exp(-0.02e0 * greatest(0, floor(({as_of} - {filed}) / 86400.0)))"


def hybrid_ctes(
    source: str, query: str, vec_id: int, n: int, as_of: int, where: str = "TRUE", vec_where: str = "TRUE"
) -> str:
    """Adds found(id, cosine, bm25, coding_boost, preference_match, combined), n rows."""
    pool = max(4 * n, 20)
    return f"""{bm25_ctes(source, query, where)},
 near AS (SELECT id, sim FROM (SELECT id, filed, {cosine(vec_id)} AS sim FROM {source}
   WHERE embedding IS NOT NULL AND {vec_where}) ORDER BY sim DESC, filed DESC, id LIMIT {pool}),
 cand AS (SELECT coalesce(near.id, bm.id) AS id, greatest(coalesce(sim, 0), 0) AS cosine, coalesce(bm25, 0) AS bm25
   FROM near FULL OUTER JOIN bm ON bm.id = near.id),
 scored AS (SELECT c.id, c.cosine, c.bm25, s.filed, s.content, s.wing, s.room, s.source_file, s.chunk_index,
   {boost(lit(query), 's.content', 's.room')} AS coding_boost,
   {pref_match(lit(query), 's.content', 's.room')} AS preference_match,
   (SELECT max(bm25) FROM cand) AS mx FROM cand c JOIN {source} s ON s.id = c.id),
 found AS (SELECT id, filed, content, source_file, chunk_index, cosine, bm25, coding_boost, preference_match,
   0.65e0 * cosine + 0.35e0 * (CASE WHEN mx > 0 THEN bm25 / mx ELSE 0 END) + coding_boost + preference_match
   + {recency('filed', as_of)} AS combined FROM scored
   ORDER BY combined DESC, filed DESC, id LIMIT {n})"""


FOUND = """SELECT id, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25, round(coding_boost, 6) AS coding_boost,
 round(preference_match, 6) AS preference_match, round(combined, 6) AS combined FROM """

SQL: dict[str, str] = {}

# ------------------------------------------------------- counts and listings
SQL["count_drawers"] = "SELECT count(*) AS drawers FROM documents"
SQL["wing_counts"] = f"WITH {DRAWERS} SELECT wing, count(*) AS drawers FROM drawers GROUP BY 1"
SQL["room_counts"] = f"WITH {DRAWERS} SELECT room, count(*) AS drawers FROM drawers WHERE wing = 'wing_3' GROUP BY 1"
SQL["taxonomy"] = f"WITH {DRAWERS} SELECT wing, room, count(*) AS drawers FROM drawers GROUP BY 1, 2"
SQL["taxonomy_rollup"] = (
    f"WITH {DRAWERS} SELECT wing, room, count(*) AS drawers FROM drawers GROUP BY ROLLUP (wing, room)"
)
SQL["average_drawer_tokens"] = "SELECT CAST(round(avg(length(text))) AS BIGINT) // 4 AS avg_tokens FROM documents"
SQL["list_drawers_recent"] = f"""WITH {DRAWERS} SELECT id, wing, room, filed AS filed_at, importance FROM drawers
 WHERE wing = 'wing_3' AND room = 'en' ORDER BY filed DESC, id LIMIT 50"""
SQL["list_by_importance"] = f"""WITH {DRAWERS} SELECT id, importance, filed AS filed_at FROM drawers
 ORDER BY importance DESC, filed DESC, id LIMIT 40"""
SQL["get_drawer"] = f"""WITH {DRAWERS} SELECT id, wing, room, content, source_file, chunk_index, importance
 FROM drawers WHERE id = 'drawer_17'"""
SQL["source_context"] = f"""WITH {DRAWERS} SELECT id, chunk_index, content FROM drawers
 WHERE source_file = 'file_7' AND chunk_index BETWEEN 1 AND 3"""


def story(wing: str) -> str:
    flat = f"replace(trim(content, {WS}), chr(10), ' ')"
    header = len("## L1 — ESSENTIAL STORY".encode())
    return f"""WITH {NOTES},
 pick AS (SELECT *, row_number() OVER (ORDER BY importance DESC, filed DESC, id) AS rank FROM notes
   WHERE {wing} QUALIFY rank <= 15),
 lines AS (SELECT rank, room, id, '  - ' || (CASE WHEN length({flat}) > 200 THEN substr({flat}, 1, 197) || '...' ELSE {flat} END)
   || '  (' || source_file || ')' AS line FROM pick),
 sized AS (SELECT *, strlen(line) + (CASE WHEN row_number() OVER (PARTITION BY room ORDER BY rank) = 1
   THEN strlen(room) + 3 ELSE 0 END) AS b FROM lines)
 SELECT rank, room, id, line, {header} + sum(b) OVER (ORDER BY room, rank) <= 3200 AS fits FROM sized"""


SQL["wake_up_story_rows"] = story("TRUE")
SQL["wake_up_story_wing"] = story("wing = 'wing_3'")
SQL["unembedded_count"] = f"WITH {DRAWERS} SELECT count(*) AS unembedded FROM drawers WHERE embedding IS NULL"
SQL["corrupted_vectors"] = f"""WITH {DRAWERS}, cut AS (SELECT id, len(CASE WHEN chunk_index = 3
 THEN embedding[1:60] ELSE embedding END) AS dim FROM drawers WHERE embedding IS NOT NULL)
 SELECT id, dim FROM cut WHERE dim <> 64"""

KNOWN = """known AS (SELECT 'wing_' || (c_custkey % 10) AS name, 'topic' AS kind,
 'customers ' || count(*) AS description, CAST(NULL AS VARCHAR) AS project_path FROM customer GROUP BY 1)"""
INCOMING = """incoming AS (SELECT 'wing_' || s_nationkey AS name,
 CASE WHEN s_nationkey % 2 = 0 THEN 'project' ELSE 'topic' END AS kind,
 CASE WHEN s_nationkey % 3 = 0 THEN 'suppliers ' || count(*) ELSE '' END AS description,
 CASE WHEN s_nationkey % 2 = 0 THEN '/work/wing_' || s_nationkey ELSE '' END AS project_path
 FROM supplier GROUP BY s_nationkey)"""
MERGED = """merged AS (SELECT coalesce(i.name, k.name) AS name,
 CASE WHEN i.kind = 'project' OR k.kind = 'project' THEN 'project' ELSE coalesce(i.kind, k.kind) END AS kind,
 coalesce(nullif(i.description, ''), k.description, '') AS description,
 coalesce(nullif(i.project_path, ''), k.project_path) AS project_path
 FROM known k FULL OUTER JOIN incoming i ON i.name = k.name)"""
SQL["wings_registry"] = f"""WITH {DRAWERS}, {KNOWN} SELECT name, kind, description,
 (SELECT count(*) FROM drawers d WHERE d.wing = k.name) AS drawer_count FROM known k"""
SQL["backfill_wings"] = f"""WITH {DRAWERS}, {KNOWN} SELECT DISTINCT wing AS name, CASE WHEN wing LIKE 'wing_diary__%'
 OR wing IN ('general', 'conversations') THEN 'topic' ELSE 'project' END AS kind
 FROM drawers WHERE wing NOT IN (SELECT name FROM known)"""
SQL["upsert_wings"] = f"WITH {KNOWN}, {INCOMING}, {MERGED} SELECT * FROM merged"
SQL["project_status"] = f"""WITH {DRAWERS}, {KNOWN}, {INCOMING}, {MERGED}, c AS (SELECT name,
 (SELECT count(*) FROM drawers d WHERE d.wing = m.name) AS drawer_count FROM merged m)
 SELECT name, CASE WHEN drawer_count > 0 THEN 'mined' ELSE 'registered_not_mined' END AS state, drawer_count FROM c"""
SQL["files_not_mined"] = f"""WITH {DRAWERS} SELECT DISTINCT 'file_' || (o_orderkey // 50) AS source_file FROM orders
 WHERE 'file_' || (o_orderkey // 50) NOT IN (SELECT source_file FROM drawers)"""
SQL["memory_report"] = f"""WITH {DRAWERS} SELECT wing, room, count(*) AS drawers,
 CAST(sum(count(*)) OVER (PARTITION BY wing) AS BIGINT) AS wing_drawers FROM drawers GROUP BY 1, 2"""
_SKIP = ", ".join(lit(w) for w in fv.CAPITALISED_SKIP_WORDS)
SQL["name_candidates"] = f"""WITH {NOTES}, w AS (SELECT regexp_replace(regexp_replace(unnest(regexp_split_to_array(content, '\\s+')),
 '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '') AS name FROM notes)
 SELECT name, count(*) AS seen, CASE WHEN strlen(name) <= 12 AND NOT contains(name, '-') THEN 'person' ELSE 'project' END AS kind
 FROM w WHERE strlen(name) > 2 AND regexp_full_match(name, '\\p{{Lu}}[\\p{{L}}-]*') AND name NOT IN ({_SKIP})
 GROUP BY 1 HAVING count(*) >= 2"""
_PAIRS = ", ".join(
    f"({lit(word)}, {lit(room)})" for room, words in fv.FOLDER_ROOMS["coding"].items() for word in words
)
SQL["file_name_rooms"] = f"""WITH pairs(word, room) AS (VALUES {_PAIRS}),
 f AS (SELECT replace(replace(p_name, ' ', '_'), '-', '_') || '_test_' || lower(p_type) || '.ui' AS name FROM part)
 SELECT room, count(*) AS files FROM f JOIN pairs ON contains(lower(f.name), word) GROUP BY 1
 HAVING count(*) >= 2 ORDER BY files DESC, room LIMIT 6"""

# ---------------------------------------------------------------- index, BM25
SQL["token_stats"] = f"""WITH t AS (SELECT len({TOKENS.format('text')}) AS n FROM documents)
 SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_len FROM t"""
SQL["term_df_top"] = f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents)
 SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1 ORDER BY df DESC, term LIMIT 100"""
SQL["bm25_postings"] = f"""WITH t AS (SELECT 'drawer_' || doc_id AS drawer_id, {TOKENS.format('text')} AS w FROM documents),
 x AS (SELECT drawer_id, len(w) AS doc_len, unnest(w) AS term FROM t)
 SELECT drawer_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM x GROUP BY 1, 2"""
SQL["bm25_topk"] = f"""WITH {DRAWERS}, {bm25_ctes('drawers', DOC_QUERY)}
 SELECT id, round(bm25, 6) AS bm25 FROM bm JOIN drawers USING (id) ORDER BY bm.bm25 DESC, filed DESC, id LIMIT 10"""
SQL["bm25_indexed"] = SQL["bm25_topk"].replace("ORDER BY bm.bm25 DESC", "ORDER BY round(bm.bm25, 9) DESC")
SQL["bm25_filtered"] = f"""WITH {DRAWERS}, {bm25_ctes('drawers', DOC_QUERY, "s.wing = 'wing_3' AND s.room = 'en'")}
 SELECT id, round(bm25, 6) AS bm25 FROM bm JOIN drawers USING (id) ORDER BY bm.bm25 DESC, filed DESC, id LIMIT 10"""

SQL["bm25_indexed_filtered"] = SQL["bm25_filtered"]
SQL["index_terms"] = f"""WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents)
 SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) > 1"""


# ------------------------------------------------------- vectors and hybrid
def nearest(ctes: str, source: str, vec_id: int, k: int, where: str = "TRUE") -> str:
    return f"""WITH {ctes} SELECT id, wing, {cosine(vec_id)} AS similarity, filed FROM {source}
 WHERE embedding IS NOT NULL AND {where} ORDER BY similarity DESC, filed DESC, id LIMIT {k}"""


SQL["vector_topk"] = f"SELECT id, similarity FROM ({nearest(DRAWERS, 'drawers', 0, 20)})"
SQL["vector_topk_filtered"] = (
    f"""SELECT id, similarity FROM ({nearest(DRAWERS, 'drawers', 3, 10, "wing = 'wing_2' AND room = 'en'")})"""
)
SQL["check_duplicate"] = (
    f"SELECT id, similarity FROM ({nearest(NOTES, 'notes', 7, 5)}) WHERE similarity >= 0.9"
)
SQL["check_duplicate_all"] = SQL["check_duplicate"].replace(" LIMIT 5", "")
SQL["preference_search"] = (
    f"SELECT id, wing, similarity FROM ({nearest(NOTES, 'notes', 11, 10, is_pref('content'))})"
)
_OWN = "(CASE WHEN o_orderkey % 2 = 0 THEN list_reverse(embedding) ELSE embedding END)"
SQL["preference_vectors"] = f"""WITH {NOTES}, s AS (SELECT id, wing, filed, {cosine(11, _OWN)} AS similarity FROM notes
  WHERE embedding IS NOT NULL AND {is_pref('content')})
 SELECT id, wing, similarity FROM s ORDER BY similarity DESC, filed DESC, id LIMIT 10"""
SQL["hybrid_topk"] = f"WITH {NOTES}, {hybrid_ctes('notes', NOTE_QUERY, 5, 10, fx.AS_OF_NOTES)} {FOUND} found"
SQL["hybrid_indexed"] = SQL["hybrid_topk"]
SQL["hybrid_documents"] = (
    f"WITH {DRAWERS}, {hybrid_ctes('drawers', DOC_QUERY, 0, 10, fx.AS_OF_DRAWERS)} {FOUND} found"
)
SQL["hybrid_filtered"] = f"""WITH {NOTES}, {hybrid_ctes('notes', NOTE_QUERY, 5, 10, fx.AS_OF_NOTES,
 "s.wing = 'wing_3' AND s.room = 'decisions'", "wing = 'wing_3' AND room = 'decisions'")} {FOUND} found"""
SQL["hybrid_preference_query"] = (
    f"WITH {NOTES}, {hybrid_ctes('notes', PREF_QUERY, 9, 10, fx.AS_OF_NOTES)} {FOUND} found"
)
SQL["hybrid_with_preferences"] = f"""WITH {NOTES}, {hybrid_ctes('notes', 'rail cost', 11, 8, fx.AS_OF_NOTES)},
 pref AS (SELECT id, filed, {cosine(11)} AS sim FROM notes WHERE embedding IS NOT NULL AND {is_pref('content')}
  ORDER BY sim DESC, filed DESC, id LIMIT 10),
 both_ AS (SELECT id, filed, cosine, bm25, coding_boost, preference_match, combined FROM found UNION ALL
  SELECT id, filed, sim, 0, 0, sim, sim * 0.4e0 FROM pref WHERE sim >= 0.25 AND id NOT IN (SELECT id FROM found)),
 top8 AS (SELECT * FROM both_ ORDER BY combined DESC, filed DESC, id LIMIT 8) {FOUND} top8"""
_STOP = ", ".join(lit(w) for w in fv.RERANK_STOP_WORDS)
_Q3 = f"list_distinct(list_filter({TOKENS.format(lit(PREF_QUERY))}, lambda w: strlen(w) > 2 AND w NOT IN ({_STOP})))"
SQL["hybrid_reranked"] = f"""WITH {NOTES}, {hybrid_ctes('notes', PREF_QUERY, 9, 10, fx.AS_OF_NOTES)},
 s AS (SELECT id, combined, least(1.0e0, 0.75e0 * len(list_intersect({_Q3}, {TOKENS.format('content')})) / len({_Q3})
  + (CASE WHEN contains(lower(content), {lit(PREF_QUERY)}) THEN 0.25e0 ELSE 0 END)
  + (CASE WHEN {is_pref('content')} AND {intent(lit(PREF_QUERY))} = 'preference' THEN 0.2e0 ELSE 0 END)) AS r FROM found)
 SELECT id, round(r, 6) AS rerank_score, round(least(1.5e0, greatest(0, combined * 0.65e0 + r * 0.35e0)), 6) AS combined FROM s"""
SQL["search_with_context"] = f"""WITH {NOTES}, {hybrid_ctes('notes', NOTE_QUERY, 5, 5, fx.AS_OF_NOTES)}
 SELECT f.id AS hit_id, n.id, n.source_file, n.chunk_index FROM found f JOIN notes n ON n.source_file = f.source_file
 AND n.chunk_index BETWEEN f.chunk_index - 1 AND f.chunk_index + 1"""


def recall_sql() -> str:
    probes = ", ".join(
        f"({i}, {lit(p['query'])}, {lit(p['expected_source'])}, "
        f"{lit(p['wing']) if 'wing' in p else 'NULL'}, {lit(p['room']) if 'room' in p else 'NULL'})"
        for i, p in enumerate(PROBES)
    )
    return f"""WITH {NOTES}, probes(probe, query, expected_source, pw, pr) AS (VALUES {probes}),
 tok AS (SELECT id, {TOKENS.format('content')} AS t FROM notes),
 corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS al FROM tok),
 pt AS (SELECT DISTINCT probe, unnest({TOKENS.format('query')}) AS term FROM probes),
 hit AS (SELECT id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM tok),
 tf AS (SELECT id, term, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM hit WHERE term IN (SELECT term FROM pt) GROUP BY 1, 2),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
 bm AS (SELECT p.probe, tf.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS bm25
  FROM tf JOIN df USING (term) JOIN pt USING (term) JOIN probes p ON p.probe = pt.probe JOIN notes s ON s.id = tf.id
  CROSS JOIN corpus WHERE (pw IS NULL OR s.wing = pw) AND (pr IS NULL OR s.room = pr) GROUP BY 1, 2),
 sc AS (SELECT p.probe, s.id, s.source_file, s.filed, 0.35e0 * bm25 / max(bm25) OVER (PARTITION BY p.probe)
  + {boost('p.query', 's.content', 's.room')} + {pref_match('p.query', 's.content', 's.room')}
  + {recency('s.filed', fx.AS_OF_NOTES)} AS combined FROM bm JOIN probes p USING (probe) JOIN notes s ON s.id = bm.id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY combined DESC, filed DESC, id) AS rank FROM sc QUALIFY rank <= 5)
 SELECT query, expected_source, min(rank) FILTER (source_file = expected_source) IS NOT NULL AS passed,
  min(rank) FILTER (source_file = expected_source) AS rank, min_by(source_file, rank) AS top_source,
  round(min_by(combined, rank) * 1000) / 1000 AS top_similarity
 FROM probes LEFT JOIN rk USING (probe) GROUP BY probe, query, expected_source"""


SQL["recall_check"] = recall_sql()


def batch_ctes(source: str, asked: str) -> str:
    """bm(qid, id, bm25) of all questions and drawers that share a term."""
    return f"""asked AS ({asked}),
 tok AS (SELECT id, {TOKENS.format('content')} AS t FROM {source}),
 corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS al FROM tok),
 qt AS (SELECT DISTINCT qid, unnest({TOKENS.format('query')}) AS term FROM asked),
 hit AS (SELECT id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM tok),
 tf AS (SELECT id, term, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM hit WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
 bm AS (SELECT qid, tf.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))), 9) AS bm25
  FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN corpus GROUP BY 1, 2)"""


def batch_found(source: str, as_of: int, n: int) -> str:
    return f"""sc AS (SELECT bm.qid, s.id, s.filed, s.content, bm25, query, {boost('query', 's.content', 's.room')} AS coding_boost,
   {pref_match('query', 's.content', 's.room')} AS preference_match,
   0.35e0 * bm25 / max(bm25) OVER (PARTITION BY bm.qid) + {recency('s.filed', as_of)} AS base
  FROM bm JOIN asked USING (qid) JOIN {source} s ON s.id = bm.id),
 rk AS (SELECT *, base + coding_boost + preference_match AS combined,
   row_number() OVER (PARTITION BY qid ORDER BY base + coding_boost + preference_match DESC, filed DESC, id) AS rank
  FROM sc QUALIFY rank <= {n})"""


BENCHMARK = "SELECT item_id AS qid, text AS query FROM benchmark"
SQL["bm25_batch"] = f"""WITH {DRAWERS}, {batch_ctes('drawers', BENCHMARK)}
 SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, filed DESC, id) AS rank, id, round(bm25, 6) AS bm25
 FROM bm JOIN drawers USING (id) QUALIFY rank <= 5"""
SQL["recall_batch"] = f"""WITH {DRAWERS}, {batch_ctes('drawers', BENCHMARK)}, {batch_found('drawers', fx.AS_OF_DRAWERS, 5)}
 SELECT qid, min(rank) FILTER (contains(content, rk.query)) IS NOT NULL AS passed, min(rank) FILTER (contains(content, rk.query)) AS rank,
  min_by(id, rank) AS top_id, round(min_by(combined, rank) * 1000) / 1000 AS top_similarity
 FROM asked LEFT JOIN rk USING (qid) GROUP BY qid"""
SQL["question_batch"] = f"""WITH {NOTES}, {batch_ctes('notes', 'SELECT s_suppkey AS qid, ' + fx.SUPPLIER_QUESTION + ' AS query FROM supplier')},
 {batch_found('notes', fx.AS_OF_NOTES, 3)}
 SELECT qid, rank, id, round(bm25, 6) AS bm25, round(coding_boost, 6) AS coding_boost, round(preference_match, 6) AS preference_match,
  round(combined, 6) AS combined FROM rk"""

# --------------------------------------------------------------- classifiers
SQL["intent_classify"] = f"WITH q AS (SELECT o_orderkey, {QUESTION} AS query FROM orders) SELECT o_orderkey, {intent('query')} AS intent FROM q"


def rewrite_sql() -> str:
    body = f"rtrim(lower(trim(query, {WS})), '?.! ')"
    whens = " ".join(
        f"WHEN starts_with(body, {lit(p)}) AND ltrim(substr(body, {len(p) + 1}), ' :') <> '' "
        f"THEN ltrim(substr(body, {len(p) + 1}), ' :')"
        for p in fv.QUESTION_PREFIXES
    )
    ctes = [
        f"q AS (SELECT o_orderkey, {QUESTION} AS query FROM orders)",
        f"b AS (SELECT o_orderkey, query, {body} AS body FROM q)",
        f"s0 AS (SELECT o_orderkey, query, trim(regexp_replace(CASE {whens} ELSE body END, '\\s+', ' ', 'g')) AS x FROM b)",
    ]
    for i, (short, full) in enumerate(fv.QUERY_EXPANSIONS):
        pos = f"instr(x, {lit(short)})"
        after = f"substr(x, {pos} + {len(short)})"
        ctes.append(
            f"s{i + 1} AS (SELECT o_orderkey, query, CASE WHEN {pos} > 0 AND {after} <> '' "
            f"AND contains(E' ,.;:\\t\\n', substr({after}, 1, 1)) THEN substr(x, 1, {pos} - 1) || {lit(full)} || {after} "
            f"ELSE x END AS x FROM s{i})"
        )
    return "WITH " + ", ".join(ctes) + f" SELECT o_orderkey, trim(x) AS rewritten FROM s{len(fv.QUERY_EXPANSIONS)}"


SQL["query_rewrite"] = rewrite_sql()


def sanitize_sql() -> str:
    markers = "[" + ", ".join(lit(m) for m in fv.QUERY_MARKERS) + "]"
    prefixes = " OR ".join(f"starts_with(lower(line), {lit(p)})" for p in fv.DROPPED_LINE_PREFIXES)
    return f"""WITH q AS (SELECT o_orderkey, {QUESTION} AS query FROM orders),
 ln AS (SELECT o_orderkey, unnest(string_split(query, chr(10))) AS line, generate_subscripts(string_split(query, chr(10)), 1) AS pos FROM q),
 fl AS (SELECT o_orderkey, pos, trim(line) AS line, count(*) FILTER (starts_with(trim(line), '```')) OVER (PARTITION BY o_orderkey ORDER BY pos) AS fences FROM ln),
 mk AS (SELECT o_orderkey, pos, unnest({markers}) AS m, generate_subscripts({markers}, 1) AS k, line FROM fl),
 hit AS (SELECT o_orderkey, pos * 100 + k AS ord, trim(substr(line, instr(lower(line), m) + length(m))) AS v FROM mk
   WHERE instr(lower(line), m) > 0 AND trim(substr(line, instr(lower(line), m) + length(m))) <> ''),
 marked AS (SELECT o_orderkey, max_by(v, ord) AS v FROM hit GROUP BY 1),
 kept AS (SELECT o_orderkey, pos, line, contains(line, '?') OR {any_in('lower(line)', fv.QUERY_INTENT_TERMS)} AS asks FROM fl
   WHERE NOT starts_with(line, '```') AND fences % 2 = 0 AND line <> '' AND NOT ({prefixes} OR {any_in('lower(line)', fv.DROPPED_LINE_NEEDLES)})),
 agg AS (SELECT o_orderkey, string_agg(line, ' ' ORDER BY pos) FILTER (asks) AS a, string_agg(line, ' ' ORDER BY pos) AS b FROM kept GROUP BY 1)
 SELECT o_orderkey, coalesce(marked.v, agg.a, agg.b, '') AS sanitized FROM q LEFT JOIN marked USING (o_orderkey) LEFT JOIN agg USING (o_orderkey)"""


SQL["query_sanitize"] = sanitize_sql()
BOTH_TEXTS = f"""texts AS (SELECT 'note' AS origin, o_orderkey AS row_no, {TEXT} AS content FROM orders
 UNION ALL SELECT 'doc', doc_id, text FROM documents)"""


def label_sql(table, text: str, default: str, last: bool, name: str) -> str:
    scores = [f"{count_in(text, words)}" for _, words in table]
    cols = ", ".join(f"{s} AS s{i}" for i, s in enumerate(scores))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(table))) + ")"
    order = reversed(range(len(table))) if last else range(len(table))
    whens = " ".join(f"WHEN s{i} = {best} THEN {lit(table[i][0])}" for i in order)
    return f"""WITH {BOTH_TEXTS}, s AS (SELECT origin, row_no, {cols} FROM texts)
 SELECT origin, row_no, CASE WHEN {best} = 0 THEN {lit(default)} {whens} END AS {name} FROM s"""


SQL["hall_route"] = label_sql(fv.HALL_KEYWORDS, "lower(content)", "memory", True, "hall")
_HEAD = "lower(content)"
SQL["convo_room"] = label_sql(fv.CONVO_ROOM_KEYWORDS, _HEAD, "general", False, "room")
SQL["preference_tag"] = f"WITH {NOTES} SELECT o_orderkey FROM notes WHERE {is_pref('content')}"
SQL["preference_span"] = f"""WITH {NOTES}, s AS (SELECT o_orderkey, {pref_span('content')} AS span FROM notes)
 SELECT o_orderkey, span FROM s WHERE span IS NOT NULL"""


def entities_sql(source: str, key: str, text: str) -> str:
    """Every non-word character is doubled first, so that each name can be asked
    for a non-word neighbour on both sides without one match eating the next."""
    nonword = "[^\\p{L}\\p{N}_]"
    doubled = f"regexp_replace({text}, '({nonword})', '\\1\\1', 'g')"
    undouble = "regexp_replace(trim(m, E' \\t\\n\\r'), '(\\s)\\s', '\\1', 'g')"
    title = "[A-Z]\\p{L}{2,}(?:\\s+[A-Z]\\p{L}{2,})?"
    camel = "[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+"
    stop = ", ".join(lit(w) for w in fv.ENTITY_STOP_WORDS)
    agents = ", ".join(lit(a.lower()) for a in fv.AGENT_NAMES)
    return f"""src AS (SELECT {key} AS k, {text} AS txt, {doubled} AS dbl FROM {source}),
 ms AS (SELECT k, unnest(regexp_extract_all(dbl, '(?:^|{nonword})({title})(?:{nonword}|$)', 1)) AS m FROM src
  UNION ALL SELECT k, unnest(regexp_extract_all(dbl, '(?:^|{nonword})({camel})(?:{nonword}|$)', 1)) FROM src),
 named AS (SELECT DISTINCT k, {undouble} AS name FROM ms),
 speak AS (SELECT DISTINCT k, unnest(regexp_extract_all(txt, '(?m)^([A-Z]\\p{{L}}[\\p{{L}}0-9_-]{{1,40}}):\\s', 1)) AS name FROM src),
 alln AS (SELECT k, name, CASE WHEN lower(name) IN ({agents}) THEN 'agent_persona'
   WHEN {any_in('name', fv.PROJECT_HINTS)} OR contains(name, '-') THEN 'project'
   WHEN regexp_matches(name, '\\S\\s+\\S') THEN 'person' ELSE 'topic' END AS kind
   FROM named WHERE (k, name) NOT IN (SELECT (k, name) FROM speak)
  UNION ALL SELECT k, name, 'person' FROM speak),
 ents AS (SELECT k, name, kind FROM alln WHERE strlen(name) >= 2 AND name NOT IN ({stop}))"""


SQL["entity_extract"] = f"WITH {NOTES}, {entities_sql('notes', 'o_orderkey', 'content')} SELECT k AS o_orderkey, name, kind FROM ents"
SQL["entity_extract_documents"] = (
    f"WITH {entities_sql('documents', 'doc_id', 'text')} SELECT name, kind, count(*) AS texts FROM ents GROUP BY 1, 2"
)
_AG = " , ".join(f"CASE WHEN contains(lower(line), {lit(a.lower())}) THEN {lit(a)} END" for a in sorted(fv.AGENT_NAMES))
SQL["corpus_origin"] = f"""WITH l AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations),
 a AS (SELECT *, list_filter([{_AG}], lambda x: x IS NOT NULL) AS ag FROM l)
 SELECT conv_id, turn, CASE WHEN {any_in('lower(line)', fv.TURN_MARKERS)} OR len(ag) > 0 THEN 'ai_dialogue' ELSE 'project_files' END AS platform,
 array_to_string(ag, ',') AS agents FROM a"""


def dialect_sql() -> str:
    """Letters around a phrase are checked by asking for a non-letter on both
    sides of a text whose non-letters are doubled (see entities_sql)."""
    ctes = [f"{NOTES}", "s0 AS (SELECT o_orderkey, content, regexp_replace(trim(content), '([^\\p{L}])', '\\1\\1', 'g') AS x FROM notes)"]
    for i, (phrase, short) in enumerate(fv.DIALECT_ABBREVIATIONS):
        doubled = phrase.replace(" ", "  ")
        import re as _re

        replacement = _re.sub(r"([^A-Za-z])", r"\1\1", short)
        ctes.append(
            f"s{i + 1} AS (SELECT o_orderkey, content, regexp_replace(x, {lit('(?i)(^|[^\\p{L}])' + doubled + '([^\\p{L}]|$)')}, "
            f"{lit('\\1' + replacement + '\\2')}, 'g') AS x FROM s{i})"
        )
    last = len(fv.DIALECT_ABBREVIATIONS)
    return (
        "WITH " + ", ".join(ctes)
        + f", d AS (SELECT o_orderkey, content, '[AAAK] ' || regexp_replace(x, '([^\\p{{L}}])[^\\p{{L}}]', '\\1', 'g') AS short FROM s{last})"
        + " SELECT o_orderkey, short, CASE WHEN strlen(content) // 4 > 0 THEN round((strlen(short) // 4)::DOUBLE / (strlen(content) // 4) * 1000) / 1000 ELSE 1.0 END AS ratio FROM d"
    )


SQL["dialect_compress"] = dialect_sql()
_FLAT = f"replace(trim(text, {WS}), chr(10), ' ')"
SQL["snippets"] = f"""SELECT 'drawer_' || doc_id AS id, CASE WHEN length({_FLAT}) > 300 THEN substr({_FLAT}, 1, 297) || '...' ELSE {_FLAT} END AS snippet FROM documents"""

# ----------------------------------------------------------- knowledge graph
EID = "replace(replace(lower({0}), ' ', '_'), '''', '')"
KG = f"""facts AS (
 SELECT 'Customer ' || o_custkey AS s, 'has_priority' AS predicate, o_orderpriority AS o, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
  lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders
 UNION ALL SELECT 'Customer ' || c_custkey, 'lives_in', n_name, NULL, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT n_name, 'in_region', r_name, NULL, NULL FROM nation JOIN region ON r_regionkey = n_regionkey),
 names AS (SELECT s AS name FROM facts UNION ALL SELECT o FROM facts),
 entities AS (SELECT {EID.format('name')} AS id, min(name) AS name FROM names GROUP BY 1),
 triples AS (SELECT {EID.format('s')} AS subject, predicate, {EID.format('o')} AS object, valid_from, valid_to FROM facts),
 named AS (SELECT t.*, a.name AS sn, b.name AS o_n FROM triples t JOIN entities a ON a.id = t.subject JOIN entities b ON b.id = t.object)"""


def valid(day: str | None) -> str:
    if day is None:
        return "TRUE"
    return f"(valid_from IS NULL OR valid_from <= '{day}') AND (valid_to IS NULL OR valid_to >= '{day}')"


def outgoing(name: str, day: str | None = None) -> str:
    return (
        f"SELECT 'outgoing' AS direction, {name} AS subject, predicate, o_n AS object, valid_from, valid_to, "
        f"valid_to IS NULL AS current FROM named WHERE subject = {EID.format(name)} AND {valid(day)}"
    )


def incoming(name: str, day: str | None = None) -> str:
    return (
        f"SELECT 'incoming' AS direction, sn AS subject, predicate, {name} AS object, valid_from, valid_to, "
        f"valid_to IS NULL AS current FROM named WHERE object = {EID.format(name)} AND {valid(day)}"
    )


_NATION3 = "(SELECT n_name FROM nation WHERE n_nationkey = 3)"
SQL["kg_query_out"] = f"WITH {KG} {outgoing(lit('Customer 7'))}"
SQL["kg_query_in"] = f"WITH {KG} {incoming(lit('5-LOW'))}"
SQL["kg_query_both"] = f"WITH {KG} {outgoing(_NATION3)} UNION ALL {incoming(_NATION3)}"
SQL["kg_as_of"] = f"WITH {KG} {outgoing(lit('Customer 7'), '1998-06-01')}"
SQL["kg_relationship"] = f"""WITH {KG} SELECT 'outgoing' AS direction, sn AS subject, predicate, o_n AS object, valid_from, valid_to,
 valid_to IS NULL AS current FROM named WHERE predicate = 'has_priority' AND {valid('1998-06-01')}"""


def timeline(where: str) -> str:
    return f"""WITH {KG}, f AS (SELECT * FROM named WHERE {where}
 ORDER BY valid_from ASC NULLS LAST, subject, predicate, object, valid_to ASC NULLS FIRST LIMIT 100)
 SELECT 'outgoing' AS direction, sn AS subject, predicate, o_n AS object, valid_from, valid_to, valid_to IS NULL AS current FROM f"""


SQL["kg_timeline"] = timeline("TRUE")
SQL["kg_timeline_all"] = timeline("TRUE").replace(" LIMIT 100", "")
SQL["kg_timeline_entity"] = timeline("subject = 'customer_11' OR object = 'customer_11'")
SQL["kg_stats"] = f"""WITH {KG} SELECT (SELECT count(*) FROM entities) AS entities, count(*) AS triples,
 count(*) FILTER (valid_to IS NULL) AS current_facts, count(*) FILTER (valid_to IS NOT NULL) AS expired_facts,
 (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT predicate AS p FROM triples)) AS relationship_types FROM triples"""
SQL["kg_conflicts"] = f"""WITH {KG} SELECT sn AS subject, predicate, count(*) AS facts, min(o_n) AS first_object, max(o_n) AS last_object
 FROM named GROUP BY 1, 2 HAVING count(DISTINCT o_n) > 1"""
SQL["kg_conflict_facts"] = f"""WITH {KG} SELECT sn AS subject, predicate, o_n AS object, valid_from, valid_to, valid_to IS NULL AS current
 FROM named WHERE (sn, predicate) IN (SELECT (sn, predicate) FROM named GROUP BY sn, predicate HAVING count(DISTINCT o_n) > 1)"""
SQL["kg_invalidate"] = f"""WITH {KG} SELECT subject, predicate, object, valid_from,
 CASE WHEN predicate = 'lives_in' AND valid_to IS NULL THEN '2002-01-01' ELSE valid_to END AS valid_to
 FROM triples WHERE subject = 'customer_7'"""
SQL["kg_add_triples"] = f"""WITH {KG} SELECT DISTINCT 'customer_' || o_custkey AS subject, 'has_priority' AS predicate,
 {EID.format('o_orderpriority')} AS object, '2001-01-01' AS valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM orders
 WHERE ('customer_' || o_custkey, {EID.format('o_orderpriority')}) NOT IN
  (SELECT (subject, object) FROM triples WHERE predicate = 'has_priority' AND valid_to IS NULL)"""

# ----------------------------------------------------------------- room graph
SIGHT = """sight AS (SELECT lower(p_type) || '-' || lower(p_brand) AS room, n_name AS wing, strftime(l_shipdate, '%Y-%m-%d') AS day
 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
PRICE = """sight AS (SELECT 'price-' || CAST(floor(o_totalprice / 200) AS BIGINT) AS room, 'customer_' || o_custkey AS wing,
 strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""
RW = "rw AS (SELECT room, wing, count(*) AS c FROM sight GROUP BY 1, 2)"
NODES = "nodes AS (SELECT room, count(*) AS wings, CAST(sum(c) AS BIGINT) AS drawers FROM rw GROUP BY 1)"
DATES = """days AS (SELECT room, day, row_number() OVER (PARTITION BY room ORDER BY day) AS k FROM (SELECT DISTINCT room, day FROM sight)),
 dates AS (SELECT room, string_agg(day, ',' ORDER BY day) AS dates, max(day) AS recent FROM days WHERE k <= 5 GROUP BY 1)"""
SQL["room_nodes"] = f"""WITH {SIGHT}, {RW}, {NODES}, {DATES} SELECT room, wings, drawers, dates, recent,
 (SELECT max(day) FROM sight s WHERE s.room = nodes.room) AS max_date FROM nodes JOIN dates USING (room)"""
SQL["room_edge_counts"] = f"WITH {SIGHT}, {RW}, {NODES} SELECT room, wings, drawers, wings * (wings - 1) // 2 AS edges FROM nodes WHERE wings >= 2"
SQL["room_edges_of_wing"] = f"""WITH {PRICE}, {RW} SELECT a.room, least(a.wing, b.wing) AS wing_a, greatest(a.wing, b.wing) AS wing_b
 FROM rw a JOIN rw b ON a.room = b.room AND a.wing = 'customer_7' AND b.wing <> 'customer_7'"""
SQL["find_tunnels"] = f"""WITH {PRICE}, {RW}, {NODES}, {DATES}, top AS (SELECT * FROM nodes WHERE wings >= 2 ORDER BY drawers DESC, room LIMIT 50)
 SELECT room, wing, wings, drawers, recent FROM rw JOIN top USING (room) JOIN dates USING (room)"""
SQL["find_tunnels_all"] = SQL["find_tunnels"].replace(" LIMIT 50", "")
SQL["find_tunnels_between"] = f"""WITH {SIGHT}, {RW}, {NODES}, {DATES}, top AS (SELECT * FROM nodes n WHERE wings >= 2
 AND EXISTS (SELECT 1 FROM rw WHERE rw.room = n.room AND wing = (SELECT n_name FROM nation WHERE n_nationkey = 2))
 AND EXISTS (SELECT 1 FROM rw WHERE rw.room = n.room AND wing = {_NATION3}) ORDER BY drawers DESC, room LIMIT 50)
 SELECT room, wing, wings, drawers, recent FROM rw JOIN top USING (room) JOIN dates USING (room)"""
SQL["graph_stats"] = f"""WITH {PRICE}, {RW}, {NODES} SELECT count(*) AS total_rooms, count(*) FILTER (wings >= 2) AS tunnel_rooms,
 CAST(sum(wings * (wings - 1) // 2) AS BIGINT) AS total_edges FROM nodes"""
SQL["rooms_per_wing"] = f"WITH {PRICE}, {RW} SELECT wing, count(*) AS rooms FROM rw GROUP BY 1"
SQL["top_tunnels"] = f"""WITH {PRICE}, {RW}, {NODES} SELECT room, wings, drawers FROM nodes WHERE wings >= 2
 ORDER BY wings DESC, drawers DESC, room LIMIT 10"""


def walk(hops: int) -> str:
    ctes = ["h0 AS (SELECT DISTINCT room, 0 AS hop, CAST(NULL AS VARCHAR) AS via_room FROM rw WHERE room = 'price-1000')"]
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT room FROM h{i}" for i in range(h))
        ctes.append(
            f"h{h} AS (SELECT b.room, {h} AS hop, min(f.room) AS via_room FROM h{h - 1} f JOIN rw a ON a.room = f.room "
            f"JOIN rw b ON b.wing = a.wing WHERE b.room NOT IN ({seen}) GROUP BY 1)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(hops + 1))
    ctes.append(
        f"walk AS (SELECT room, drawers, hop, via_room FROM ({every}) JOIN nodes USING (room) ORDER BY hop, drawers DESC, room LIMIT 50)"
    )
    return ", ".join(ctes)


SQL["traverse"] = f"WITH {PRICE}, {RW}, {NODES}, {walk(2)} SELECT * FROM walk"
SQL["traverse_all"] = f"WITH {PRICE}, {RW}, {NODES}, {walk(4)} SELECT * FROM walk".replace(" LIMIT 50", "")
SQL["traverse_links"] = f"""WITH {PRICE}, {RW}, {NODES}, {walk(1)} SELECT w.room, w.via_room, a.wing FROM walk w
 JOIN rw a ON a.room = w.room JOIN rw b ON b.room = w.via_room AND b.wing = a.wing WHERE hop > 0"""
SQL["room_suggestions"] = f"""WITH {PRICE}, r AS (SELECT DISTINCT room FROM sight), s AS (SELECT room,
 CASE WHEN contains(room, 'price-10-x') THEN 2 WHEN contains(room, 'price') OR contains(room, '10') OR contains(room, 'x') THEN 1 ELSE 0 END AS score FROM r)
 SELECT room, score FROM s WHERE score > 0 ORDER BY score DESC, room LIMIT 5"""
TUNNELS = """tun AS (SELECT DISTINCT 'wing_' || lower(c_mktsegment) AS wing_a, 'room_' || (c_custkey % 6) AS room_a,
 'nation_' || c_nationkey AS wing_b, 'room_' || (c_custkey % 4) AS room_b, 'explicit' AS kind FROM customer)"""
SQL["list_tunnels"] = f"WITH {TUNNELS} SELECT * FROM tun WHERE wing_a = 'wing_building' OR wing_b = 'wing_building'"
SQL["follow_tunnels"] = f"""WITH {TUNNELS} SELECT * FROM tun WHERE (wing_a = 'nation_3' AND room_a = 'room_2')
 OR (wing_b = 'nation_3' AND room_b = 'room_2')"""
SQL["list_closets"] = f"""WITH {DRAWERS} SELECT wing, room, source_file AS topic, count(*) AS pointers FROM drawers
 WHERE room = 'en' GROUP BY 1, 2, 3"""
SQL["resolve_closets"] = f"""WITH {DRAWERS} SELECT source_file AS topic,
 row_number() OVER (PARTITION BY wing, room, source_file ORDER BY id) - 1 AS pos, id FROM drawers"""

# ---------------------------------------------------------------------- usage
USAGE = f"""ev AS (SELECT event_id AS id, ts, 'session_' || user_id AS session_id, 'project_' || (user_id % 5) AS project,
 {fx.TOOL} AS tool, 'wing_' || (user_id % 9) AS wing, 'room_' || (event_id % 11) AS room,
 CASE WHEN event_id % 13 <> 0 THEN props END AS query_hash, 1 + user_id % 4 AS result_count,
 CAST(floor(value * 10) AS BIGINT) AS est_tokens_saved, CAST(floor(value) AS BIGINT) AS duration_ms, {fx.OUTCOME} AS outcome,
 event_type = 'click' AND {fx.FLAGGED} AS flag, {fx.INTENT} AS intent, event_id, event_type FROM events)"""
SINCE7 = f"ts >= make_timestamp({fx.AS_OF_USAGE - 7 * 86400}::BIGINT * 1000000)"


def sums() -> str:
    def s(outcome, value):
        return f"CAST(coalesce(sum({value}) FILTER (outcome = '{outcome}'), 0) AS BIGINT)"

    return f"""count(*) AS tool_calls, count(*) FILTER (outcome = 'hit') AS search_hits,
 CAST(coalesce(sum(est_tokens_saved), 0) AS BIGINT) AS tokens_saved_est, count(*) FILTER (outcome = 'duplicate_skip') AS duplicate_skips,
 {s('kg_fact', 'result_count')} AS kg_facts_recalled, {s('diary_recall', 'result_count')} AS diary_recalls"""


def kpi_sql(where: str) -> str:
    return f"""WITH {USAGE}, r AS (SELECT *, flag OR (query_hash IS NOT NULL AND
 row_number() OVER (PARTITION BY query_hash ORDER BY ts, id) > 1) AS rep FROM ev WHERE {where})
 SELECT {sums()}, count(DISTINCT session_id) AS sessions, count(*) FILTER (tool = 'search') AS search_calls,
 count(*) FILTER (outcome = 'error') AS errors, round(count(*) FILTER (outcome = 'hit') / count(*) FILTER (tool = 'search'), 6) AS hit_rate,
 count(*) FILTER (rep) AS repeat_questions_avoided FROM r"""


SQL["usage_kpis"] = kpi_sql("TRUE")
SQL["usage_kpis_window"] = kpi_sql(f"project = 'project_2' AND {SINCE7}")
SQL["usage_by_project"] = f"""WITH {USAGE}, r AS (SELECT *, flag OR (query_hash IS NOT NULL AND
 row_number() OVER (PARTITION BY project, query_hash ORDER BY ts, id) > 1) AS rep FROM ev),
 p AS (SELECT project, {sums()}, count(*) FILTER (rep) AS repeat_questions_avoided FROM r GROUP BY 1)
 SELECT *, tokens_saved_est // 100 + 25 * duplicate_skips + 5 * kg_facts_recalled + 5 * diary_recalls + 10 * repeat_questions_avoided AS value_score FROM p"""


def latency(by: str) -> str:
    def pick(p):
        return f"v[CAST(ceil((calls - 1) * {p} / 100.0) AS BIGINT) + 1]"

    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""WITH {USAGE}, g AS (SELECT {group}count(*) AS calls, list(duration_ms ORDER BY duration_ms) AS v FROM ev {tail})
 SELECT {group}calls, {pick(50)} AS p50_latency_ms, {pick(95)} AS p95_latency_ms FROM g"""


SQL["tool_latency"] = latency("tool")
SQL["overall_latency"] = latency("")
_VALUE = ", ".join(lit(o) for o in fv.VALUE_OUTCOMES)
for _place in ("wing", "room"):
    SQL[f"top_{_place}s"] = f"""WITH {USAGE} SELECT {_place} AS name, count(*) AS count FROM ev WHERE outcome IN ({_VALUE})
 GROUP BY 1 ORDER BY count DESC, name LIMIT 5"""
SQL["top_queries"] = f"""WITH {USAGE}, t AS (SELECT substr(query_hash, 1, 12) AS name, count(*) AS count FROM ev
 WHERE query_hash IS NOT NULL GROUP BY 1 ORDER BY count DESC, name LIMIT 5) SELECT * FROM t WHERE count > 1"""
SQL["repeat_questions"] = f"""WITH {USAGE} SELECT id, flag OR row_number() OVER (PARTITION BY query_hash ORDER BY ts, id) > 1 AS is_repeat
 FROM ev WHERE query_hash IS NOT NULL"""
SQL["repeat_24h"] = f"""WITH {USAGE} SELECT id, coalesce(lag(ts) OVER (PARTITION BY query_hash ORDER BY ts, id) >= ts - INTERVAL 24 HOUR, FALSE) AS is_repeat
 FROM ev WHERE query_hash IS NOT NULL"""
_RT, _ST = (", ".join(lit(x) for x in xs) for xs in (fv.RECALL_TOOLS, fv.SAVE_TOOLS))
SQL["save_status"] = f"""WITH {USAGE} SELECT count(*) FILTER (tool IN ({_RT})) > 0 AS engaged, count(*) FILTER (tool IN ({_ST})) > 0 AS saved
 FROM ev WHERE ts >= make_timestamp({fx.AS_OF_USAGE - 360 * 60}::BIGINT * 1000000)"""
SQL["usage_history"] = f"""WITH {USAGE} SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, project, tool, outcome, result_count,
 est_tokens_saved AS tokens_saved_est, duration_ms FROM ev WHERE project = 'project_1' AND {SINCE7} ORDER BY ev.ts DESC, id DESC LIMIT 40"""
FEEDBACK = f"""{USAGE}, s AS (SELECT id, ts, session_id, 'query_' || id AS query_id, intent, flag,
  ['drawer_' || ((id * 3) % 50), 'drawer_' || ((id * 3 + 11) % 50), 'drawer_' || ((id * 3 + 22) % 50)] AS ids
  FROM ev WHERE event_type = 'click'),
 later AS (SELECT id, ts, session_id, event_type, 'drawer_' || (id % 50) AS d FROM ev WHERE event_type IN ('purchase', 'signup')),
 j AS (SELECT s.id, count(*) FILTER (event_type = 'purchase') AS cited, count(*) FILTER (event_type = 'signup') AS gone
  FROM s JOIN later l ON l.session_id = s.session_id AND (l.ts, l.id) > (s.ts, s.id) AND list_contains(s.ids, l.d) GROUP BY 1),
 inferred AS (SELECT s.id, s.ts, query_id, ids[1] AS drawer_id, CASE WHEN cited > 0 THEN 'useful' WHEN gone > 0 THEN 'wrong_answer'
  WHEN flag THEN 'not_useful' END AS verdict FROM s LEFT JOIN j USING (id)),
 explicit AS (SELECT 'query_' || doc_id AS query_id, 'drawer_' || ((doc_id * 3) % 50) AS drawer_id,
  CASE WHEN toxic = 1 THEN 'wrong_answer' WHEN quality = 1 THEN 'useful' ELSE 'not_useful' END AS verdict FROM labels),
 fb AS (SELECT query_id, drawer_id, verdict FROM explicit UNION ALL SELECT query_id, drawer_id, verdict FROM inferred
  WHERE verdict IS NOT NULL AND (query_id, drawer_id) NOT IN (SELECT (query_id, drawer_id) FROM explicit)),
 shown AS (SELECT query_id, intent, unnest(ids) AS drawer_id, generate_subscripts(ids, 1) - 1 AS pos FROM s),
 judged AS (SELECT query_id, intent, pos, verdict FROM shown LEFT JOIN fb USING (query_id, drawer_id))"""
SQL["implicit_feedback"] = f"WITH {FEEDBACK} SELECT query_id, drawer_id, verdict FROM inferred WHERE verdict IS NOT NULL"
_PREC = """count(verdict) AS samples, round(avg(CASE WHEN verdict = 'useful' THEN 1.0e0 ELSE 0 END) FILTER (verdict IS NOT NULL AND pos = 0), 6) AS precision_at_1,
 round(avg(CASE WHEN verdict = 'useful' THEN 1.0e0 ELSE 0 END) FILTER (verdict IS NOT NULL), 6) AS precision_at_5 FROM judged"""
SQL["precision_at_k"] = f"WITH {FEEDBACK} SELECT {_PREC}"
SQL["precision_by_intent"] = f"WITH {FEEDBACK} SELECT intent, {_PREC} GROUP BY 1"
SQL["classify_calls"] = """WITH avg_t AS (SELECT CAST(round(avg(length(text))) AS BIGINT) // 4 AS a FROM documents),
 c AS (SELECT event_id AS id, event_type AS e, event_id % 17 = 0 AS bad, event_id % 3 = 0 AS third, event_id % 2 = 0 AS even FROM events)
 SELECT id, CASE e WHEN 'click' THEN 'search' WHEN 'view' THEN 'kg_query' WHEN 'purchase' THEN 'diary_write' WHEN 'signup' THEN 'delete_drawer' ELSE 'check_duplicate' END AS tool,
 CASE WHEN e = 'view' THEN 'w' WHEN e = 'click' AND NOT bad AND NOT third THEN 'wing_r' END AS wing,
 CASE WHEN e = 'click' AND NOT bad AND NOT third THEN 'room_r' END AS room,
 CASE WHEN bad THEN 0 WHEN e = 'click' AND NOT third THEN 2 WHEN e = 'view' AND even THEN 2 WHEN e = 'error' THEN 1 ELSE 0 END AS result_count,
 CASE WHEN bad THEN NULL WHEN e = 'click' AND NOT third THEN 0.5e0 WHEN e = 'error' THEN 0.91e0 END AS top_similarity,
 CASE WHEN bad THEN 0 WHEN e = 'error' AND even THEN (SELECT a FROM avg_t)
  WHEN e = 'click' AND NOT third THEN strlen('{"query_id":"query_' || id || '","intent":"decision","results":[{"id":"drawer_' || id || '","wing":"wing_r","room":" room_r ","similarity":0.5},{"id":"drawer_x"}]}') // 4
  WHEN e = 'view' AND even THEN strlen('{"facts":[1,2]}') // 4 ELSE 0 END AS est_tokens_saved,
 CASE WHEN bad THEN 'error' WHEN e = 'click' THEN (CASE WHEN third THEN 'miss' ELSE 'hit' END)
  WHEN e = 'view' THEN (CASE WHEN even THEN 'kg_fact' ELSE 'miss' END) WHEN e = 'purchase' THEN 'diary_write'
  WHEN e = 'signup' THEN 'delete_drawer' WHEN even THEN 'duplicate_skip' ELSE 'miss' END AS outcome FROM c"""

# ---------------------------------------------------------------------- diary
DIARY = """diary AS (SELECT 'entry_' || conv_id || '_' || turn AS id, 'wing_diary__agent_' || (conv_id % 3) AS wing, text AS content,
 1704067200 + conv_id * 3600 + turn AS filed, '/work/p' || (conv_id % 4) AS project_path FROM conversations WHERE role = 'assistant')"""
SQL["diary_recent"] = f"""WITH {DIARY} SELECT wing, row_number() OVER (PARTITION BY wing ORDER BY filed DESC, id) AS rank, id FROM diary QUALIFY rank <= 10"""
SQL["list_agents"] = f"WITH {DIARY} SELECT DISTINCT substr(wing, 13) AS agent FROM diary"


def context(wing: str, project: str) -> str:
    now = fx.AS_OF_DIARY
    return f"""WITH {DIARY}, own AS (SELECT * FROM diary WHERE wing = {lit(wing)} AND {project} AND filed >= {now - 86400} ORDER BY filed DESC, id LIMIT 3),
 anyone AS (SELECT * FROM diary WHERE {project} AND filed >= {now - 7 * 86400} ORDER BY filed DESC, id LIMIT 3)
 SELECT id, wing, filed AS filed_at, FALSE AS cross_agent FROM own UNION ALL
 SELECT id, wing, filed, TRUE FROM anyone WHERE (SELECT count(*) FROM own) = 0"""


SQL["session_context"] = context("wing_diary__agent_1", "project_path = '/work/p1'")
SQL["session_context_other_agent"] = context("wing_diary__nobody", "TRUE")
SQL["last_session"] = f"WITH {DIARY} SELECT id, filed AS filed_at FROM diary WHERE filed >= {fx.AS_OF_DIARY - 86400} ORDER BY filed DESC, id LIMIT 3"

# ------------------------------------------------------ chunks and memories
SQL["pair_turns"] = """WITH n AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, 'User: ' || text || chr(10) || 'Assistant: ' || t2 AS content FROM n WHERE role = 'user' AND r2 = 'assistant'"""
_CHUNKS = f"""ln AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
 pa AS (SELECT doc_id, l, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {WS})), lambda p: p <> '') AS p FROM ln)"""
SQL["text_segments"] = f"""WITH {_CHUNKS}, g AS (SELECT doc_id, CASE WHEN len(p) <= 1 AND len(l) > 20 THEN
 list_filter(list_transform(range(0, len(l), 25), lambda i: trim(array_to_string(l[i + 1:i + 25], chr(10)), {WS})), lambda s: s <> '') ELSE p END AS s,
 len(list_filter(l, lambda x: regexp_matches(trim(x, {WS}), '^>\\s') OR regexp_matches(trim(x, {WS}), '(?i)^(Human|User|Q|Assistant|AI|A|Claude|ChatGPT)\\s*:'))) AS turns FROM pa)
 SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS segment FROM g WHERE turns < 3"""
SQL["chunk_exchanges"] = f"""WITH {_CHUNKS}, g AS (SELECT doc_id, CASE WHEN len(p) <= 1 AND len(l) > 20 THEN
 list_transform(range(0, len(l), 25), lambda i: trim(array_to_string(l[i + 1:i + 25], chr(10)), {WS})) ELSE p END AS s FROM pa),
 e AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS chunk_index, unnest(s) AS content FROM g)
 SELECT * FROM e WHERE strlen(content) > 30"""


def memories_sql(source: str, key: str, text: str, segments: str) -> str:
    """Marker counts per segment; segments come as seg(k, pos, s)."""
    def count(pats):
        return " + ".join(f"len(regexp_extract_all(low, {lit(p)}))" for p in pats)

    cols = ", ".join(f"{count(p)} AS {n}" for n, p in fv.MEMORY_MARKERS)
    names = [n for n, _ in fv.MEMORY_MARKERS]
    top = "greatest(" + ", ".join(names) + ")"
    best = " ".join(f"WHEN {n} = {top} THEN '{n}'" for n in reversed(names))
    words = "list_distinct(list_transform(regexp_split_to_array(prose, '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')))"

    def shared(ws):
        return f"len(list_intersect({words}, [{', '.join(lit(w) for w in ws)}]))"

    solved = " OR ".join(f"regexp_matches(low, {lit(p)})" for p in fv.RESOLUTION_MARKERS)
    code = " OR ".join(f"regexp_matches(trim(x, {WS}), {lit(p)})" for p in fv.CODE_LINE_PATTERNS)
    sparse = f"(strlen(trim(x, {WS})) > 10 AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) < 0.4 * strlen(trim(x, {WS})))"
    return f"""WITH {segments},
 pr AS (SELECT k, pos, s, trim(array_to_string(list_filter(string_split(s, chr(10)), lambda x: trim(x, {WS}) = '' OR NOT ({code} OR {sparse})), chr(10)), {WS}) AS kept FROM seg WHERE strlen(trim(s, {WS})) >= 20),
 lo AS (SELECT k, pos, s, CASE WHEN kept = '' THEN s ELSE kept END AS prose, lower(CASE WHEN kept = '' THEN s ELSE kept END) AS low FROM pr),
 ct AS (SELECT k, pos, s, prose, low, {cols} FROM lo),
 bt AS (SELECT *, {top} AS top, CASE {best} END AS best, {shared(fv.POSITIVE_WORDS)} - {shared(fv.NEGATIVE_WORDS)} AS mood, ({solved}) AS solved FROM ct WHERE {top} > 0),
 ty AS (SELECT k, pos, trim(s, {WS}) AS content, least(1.0e0, (top + CASE WHEN strlen(s) > 500 THEN 2 WHEN strlen(s) > 200 THEN 1 ELSE 0 END) / 5.0e0) AS confidence,
  CASE WHEN best <> 'problem' THEN best WHEN solved THEN (CASE WHEN emotional > 0 AND mood > 0 THEN 'emotional' ELSE 'milestone' END)
  WHEN mood > 0 AND milestone > 0 THEN 'milestone' WHEN mood > 0 AND emotional > 0 THEN 'emotional' ELSE 'problem' END AS memory_type FROM bt)
 SELECT k AS {key}, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS chunk_index, memory_type"""


SQL["extract_memories"] = (
    memories_sql("orders", "o_orderkey", "content", f"{NOTES}, seg AS (SELECT o_orderkey AS k, 1 AS pos, content AS s FROM notes)")
    + ", round(confidence, 6) AS confidence, content FROM ty WHERE confidence >= 0.3"
)
SQL["extract_memories_documents"] = (
    memories_sql(
        "documents", "doc_id", "text",
        f"segs AS ({SQL['text_segments']}), seg AS (SELECT doc_id AS k, pos, segment AS s FROM segs)",
    )
    + ", content FROM ty WHERE confidence >= 0.3"
)

# --------------------------------------------------------------------- writes
SQL["prune"] = f"WITH {DRAWERS} SELECT id FROM drawers WHERE filed > {fx.AS_OF_DRAWERS - 350 * 86400}"
SQL["dedupe_append"] = f"""WITH {DRAWERS}, i AS (SELECT 'drawer_' || page_id AS id, url AS content FROM pages
 UNION ALL SELECT 'page_' || (page_id % 40), url FROM pages)
 SELECT id, min(content) AS content FROM i WHERE id NOT IN (SELECT id FROM drawers) GROUP BY 1"""
SQL["export_rows"] = f"""WITH {DRAWERS} SELECT id, wing, room, content, source_file, chunk_index, filed AS filed_at, importance FROM drawers"""
SQL["import_rows"] = f"""WITH {DRAWERS} SELECT id, wing, room, content, source_file, chunk_index, importance,
 '{{"session":"007","n":' || (chunk_index % 7) || ',"list":["[a]",1]}}' AS metadata FROM drawers"""
SQL["metadata_merge"] = f"""WITH {NOTES}, s AS (SELECT o_orderkey, {pref_span('content')} AS span FROM notes)
 SELECT o_orderkey, '[draft] ' || o_orderkey AS topic, CASE WHEN span IS NOT NULL THEN 'true' END AS preference, span,
  '"007"' AS code, '{{"a":[1,"2"],"b":null}}' AS nested FROM s"""
_STORED = """SELECT 'drawer_' || d.doc_id AS id, 'wing_' || ((d.doc_id // 5) % 20) AS wing, {room} AS room, length(d.text) AS chars
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)"""
SQL["delete_rows"] = _STORED.format(room="CASE WHEN toxic = 1 THEN 'again' ELSE d.lang END") + " WHERE toxic IS DISTINCT FROM 1 OR doc_id % 5 = 0"
SQL["update_rows"] = _STORED.format(room="CASE WHEN quality = 1 THEN 'good' ELSE d.lang END || CASE WHEN toxic = 1 THEN '/toxic' ELSE '' END")
# Five formats by number; roles of a channel follow its first speaker, and only user and assistant speak.
_CHAT_WS = "E' \\t\\n\\r\\x0b\\x0c'"
SQL["normalize_chats"] = f"""WITH t AS (SELECT conv_id, turn, conv_id % 5 AS k, role, trim(text, {_CHAT_WS}) AS said FROM conversations),
 s AS (SELECT *, CASE WHEN k <> 3 THEN role WHEN role = first(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'user' ELSE 'assistant' END AS r
  FROM t WHERE role IN ('user', 'assistant') AND said <> ''),
 n AS (SELECT *, lead(r) OVER w AS after, count(*) OVER (PARTITION BY conv_id) AS turns FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 l AS (SELECT conv_id, turn, CASE WHEN r = 'user' THEN '> ' ELSE '' END || said
   || CASE WHEN r = 'user' AND after = 'assistant' THEN '' ELSE chr(10) END AS block FROM n WHERE turns >= 2),
 g AS (SELECT conv_id, string_agg(block, chr(10) ORDER BY turn) AS transcript FROM l GROUP BY 1)
 SELECT conv_id, ['session', 'events', 'list', 'channel', 'tree'][conv_id % 5 + 1] AS format, transcript
 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id)"""
