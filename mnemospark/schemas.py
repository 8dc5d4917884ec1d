"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS, _B = (
    T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType(),
)
_VEC = T.ArrayType(T.FloatType())


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


META = _schema(key=_S, value=_S)
DRAWERS = _schema(
    id=_S, room=_S, content=_S, embedding=_VEC, source_file=_S, chunk_index=_L, added_by=_S,
    filed_at=_TS, created_at=_TS, importance=_D, entity_metadata=_S, hall=_S,
    normalize_version=_L, metadata=_S, is_preference=_B, pref_embedding=_VEC, wing=_S,
)
CLOSETS = _schema(
    id=_S, wing=_S, room=_S, topic=_S, pointer_drawer_ids=T.ArrayType(_S), embedding=_VEC,
    created_at=_TS,
)
TUNNELS = _schema(id=_S, wing_a=_S, room_a=_S, wing_b=_S, room_b=_S, kind=_S, created_at=_TS)
WINGS = _schema(
    name=_S, kind=_S, description=_S, project_path=_S, last_mined_at=_TS, created_at=_TS
)
POSTINGS = _schema(
    drawer_id=_S, wing=_S, room=_S, term=_S, tf=_L, doc_len=_L, term_bucket=T.IntegerType()
)
DOC_STATS = _schema(drawer_id=_S, doc_len=_L)
ENTITIES = _schema(id=_S, name=_S, type=_S, properties=_S, created_at=_TS)
TRIPLES = _schema(
    id=_S, subject=_S, predicate=_S, object=_S, valid_from=_S, valid_to=_S, confidence=_D,
    source_closet=_S, source_file=_S, extracted_at=_TS,
)
USAGE_EVENTS = _schema(
    id=_L, ts=_TS, session_id=_S, project=_S, tool=_S, wing=_S, room=_S, query_hash=_S,
    result_count=_L, top_similarity=_D, bytes_returned=_L, est_tokens_saved=_L, duration_ms=_L,
    outcome=_S, meta=_S,
)
FEEDBACK = _schema(query_id=_S, drawer_id=_S, verdict=_S, source=_S, note=_S, created_at=_TS)

TABLES: dict[str, T.StructType] = {
    "meta": META,
    "drawers": DRAWERS,
    "closets": CLOSETS,
    "tunnels": TUNNELS,
    "wings": WINGS,
    "postings": POSTINGS,
    "doc_stats": DOC_STATS,
    "entities": ENTITIES,
    "triples": TRIPLES,
    "usage_events": USAGE_EVENTS,
    "feedback": FEEDBACK,
}
PARTITIONED = {"drawers": ["wing"], "postings": ["term_bucket"]}
#: The column by which rows of a table are changed or taken out.
KEYS = {
    "meta": "key", "drawers": "id", "closets": "id", "tunnels": "id", "wings": "name", "postings": "drawer_id",
    "doc_stats": "drawer_id", "entities": "id", "triples": "id", "usage_events": "id",
}
