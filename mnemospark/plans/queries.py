"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import text as t
from mnemospark.functions.columns import round_to
from mnemospark.operators import (
    batch_search,
    block_index,
    bm25,
    catalog,
    chunking,
    closets,
    diary,
    hybrid,
    kg,
    memories,
    rooms,
    usage,
    vectors,
)
from mnemospark.plans import fixtures as fx
from mnemospark.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DOC_QUERY = "the order and that reading of de la und in thand"
NOTE_QUERY = "why did we decide the rail shipping tradeoff before order"
PREF_QUERY = "what do i prefer for shipping order convention"
PROBES = [
    {"query": "why did we ship by rail for cost", "expected_source": "desk_2500"},
    {"query": "run cargo test setup steps", "expected_source": "desk_3"},
    {"query": "what do i prefer for urgent handling", "expected_source": "desk_5"},
    {"query": "database design archive game", "expected_source": "desk_2", "room": "memory"},
    {"query": "bug failed root cause", "expected_source": "desk_3", "wing": "wing_3"},
    {"query": "alice walker pricingapi", "expected_source": "nowhere"},
]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = _settled(fn)
    return fn


def _settled(fn: Query) -> Query:
    """Fixes the session time zone, widens integers and rounds doubles to 6 digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = fn(spark, sf_dir)
        narrow = (T.IntegerType, T.ShortType, T.ByteType)
        cols = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, narrow):
                c = c.cast("long")
            elif isinstance(f.dataType, T.DoubleType):
                c = F.round(c, 6)
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                c = F.unix_seconds(c.cast("timestamp"))
            cols.append(c.alias(f.name))
        return df.select(*cols)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _enriched(df: DataFrame) -> DataFrame:
    """The columns that a write would add and that searches read."""
    return df.withColumns(
        {
            "is_preference": t.states_preference("content"),
            "pref_embedding": F.lit(None).cast("array<float>"),
        }
    )


# ------------------------------------------------------- counts and listings
@query
def count_drawers(spark, sf):
    return catalog.count_drawers(fx.drawer_text(spark, sf))


@query
def wing_counts(spark, sf):
    return catalog.wing_counts(fx.drawer_text(spark, sf))


@query
def room_counts(spark, sf):
    return catalog.room_counts(fx.drawer_text(spark, sf), "wing_3")


@query
def taxonomy(spark, sf):
    return catalog.taxonomy(fx.drawer_text(spark, sf))


@query
def taxonomy_rollup(spark, sf):
    return catalog.taxonomy_rollup(fx.drawer_text(spark, sf))


@query
def average_drawer_tokens(spark, sf):
    return catalog.average_drawer_tokens(fx.drawer_text(spark, sf))


@query
def list_drawers_recent(spark, sf):
    rows = catalog.list_recent(fx.drawers(spark, sf), 50, "wing_3", "en")
    return rows.select("id", "wing", "room", "filed_at", "importance")


@query
def list_by_importance(spark, sf):
    rows = catalog.list_by_importance(fx.drawers(spark, sf), 40)
    return rows.select("id", "importance", "filed_at")


@query
def get_drawer(spark, sf):
    rows = catalog.get_drawer(fx.drawers(spark, sf), "drawer_17")
    return rows.select("id", "wing", "room", "content", "source_file", "chunk_index", "importance")


@query
def source_context(spark, sf):
    return catalog.source_context(fx.drawer_text(spark, sf), "file_7", 2, 1).select(
        "id", "chunk_index", "content"
    )


@query
def wake_up_story_rows(spark, sf):
    return catalog.story_rows(fx.notes(spark, sf))


@query
def wake_up_story_wing(spark, sf):
    return catalog.story_rows(fx.notes(spark, sf), "wing_3")


@query
def unembedded_count(spark, sf):
    return vectors.unembedded(fx.drawers(spark, sf)).agg(F.count(F.lit(1)).alias("unembedded"))


@query
def corrupted_vectors(spark, sf):
    """Vectors of drawers at chunk 3 lose four values here, so there is damage to find."""
    cut = F.when(F.col("chunk_index") == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return vectors.corrupted(fx.drawers(spark, sf).withColumn("embedding", cut), 64)


# ----------------------------------------------------------------- registry
def _known_wings(spark, sf):
    """Every other customer segment already registered as a wing."""
    customer = fx.table(spark, sf, "customer")
    name = F.concat(F.lit("wing_"), (F.col("c_custkey") % 10).cast("string"))
    return customer.groupBy(name.alias("name")).agg(
        F.lit("topic").alias("kind"),
        F.concat(F.lit("customers "), F.count(F.lit(1)).cast("string")).alias("description"),
        F.lit(None).cast("string").alias("project_path"),
        F.lit(None).cast("timestamp").alias("last_mined_at"),
        F.timestamp_seconds(F.lit(fx.EPOCH_2024)).alias("created_at"),
    )


def _incoming_wings(spark, sf):
    supplier = fx.table(spark, sf, "supplier")
    number = F.col("s_nationkey")
    return supplier.groupBy(
        F.concat(F.lit("wing_"), number.cast("string")).alias("name"), number.alias("n")
    ).agg(
        F.count(F.lit(1)).alias("c")
    ).select(
        "name",
        F.when(F.col("n") % 2 == 0, "project").otherwise("topic").alias("kind"),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("suppliers "), F.col("c").cast("string")))
        .otherwise("").alias("description"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("/work/"), "name")).otherwise("").alias("project_path"),
        F.lit(None).cast("timestamp").alias("last_mined_at"),
        F.timestamp_seconds(F.lit(fx.EPOCH_2024)).alias("created_at"),
    )


@query
def wings_registry(spark, sf):
    rows = catalog.registry(_known_wings(spark, sf), fx.drawer_text(spark, sf))
    return rows.select("name", "kind", "description", "drawer_count")


@query
def backfill_wings(spark, sf):
    return catalog.backfill_wings(_known_wings(spark, sf), fx.drawer_text(spark, sf))


@query
def upsert_wings(spark, sf):
    rows = catalog.upsert_wings(_known_wings(spark, sf), _incoming_wings(spark, sf))
    return rows.select("name", "kind", "description", "project_path")


@query
def project_status(spark, sf):
    merged = catalog.upsert_wings(_known_wings(spark, sf), _incoming_wings(spark, sf))
    rows = catalog.wing_state(catalog.registry(merged, fx.drawer_text(spark, sf)))
    return rows.select("name", "state", "drawer_count")


@query
def files_not_mined(spark, sf):
    """Source files of remarks that have no document drawer."""
    files = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("file_"), F.floor(F.col("o_orderkey") / 50).cast("string")).alias("source_file")
    ).distinct()
    return catalog.not_yet_mined(files, fx.drawer_text(spark, sf))


@query
def memory_report(spark, sf):
    """Rooms with the size of their wing, fullest wing first."""
    per_room = catalog.taxonomy(fx.drawer_text(spark, sf))
    per_wing = per_room.groupBy("wing").agg(F.sum("drawers").alias("wing_drawers"))
    return per_room.join(per_wing, "wing").orderBy(F.desc("wing_drawers"), "wing", F.desc("drawers"), "room")


@query
def name_candidates(spark, sf):
    return catalog.name_candidates(fx.note_text(spark, sf))


@query
def file_name_rooms(spark, sf):
    """Rooms suggested by page addresses taken as file paths."""
    paths = fx.table(spark, sf, "part").select(
        F.concat(F.lit("src/"), F.translate("p_name", " ", "-"), F.lit("_test_"), F.lower("p_type"), F.lit(".ui")).alias("path")
    )
    return catalog.rooms_from_file_names(paths)


# ---------------------------------------------------------------- index, BM25
@query
def token_stats(spark, sf):
    docs = bm25.doc_stats(fx.drawer_text(spark, sf))
    return docs.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("doc_len").alias("tokens"), F.avg("doc_len").alias("avg_len")
    )


@query
def term_df_top(spark, sf):
    df = bm25.document_frequency(bm25.postings(fx.drawer_text(spark, sf)))
    return df.orderBy(F.desc("df"), "term").limit(100)


@query
def bm25_postings(spark, sf):
    return bm25.postings(fx.drawer_text(spark, sf)).select("drawer_id", "term", "tf", "doc_len")


@query
def bm25_topk(spark, sf):
    return bm25.bm25_search(fx.drawer_text(spark, sf), DOC_QUERY, 10).select("id", "bm25")


@query
def bm25_filtered(spark, sf):
    """Statistics stay those of the whole corpus."""
    return bm25.bm25_search(fx.drawer_text(spark, sf), DOC_QUERY, 10, "wing_3", "en").select("id", "bm25")


@query
def bm25_indexed(spark, sf):
    """The same ranking from the stored index; slots that cannot reach the tenth score stay unread."""
    return block_index.search(fx.block_index(spark, sf, "drawers"), DOC_QUERY, 10).select("id", "bm25")


@query
def bm25_indexed_filtered(spark, sf):
    found = block_index.search(fx.block_index(spark, sf, "drawers"), DOC_QUERY, 10, "wing_3", "en")
    return found.select("id", "bm25")


@query
def index_terms(spark, sf):
    """Document frequencies as the stored index has them."""
    return fx.block_index(spark, sf, "drawers").terms.where("df > 1").select("term", "df")


# ------------------------------------------------------------------- vectors
@query
def vector_topk(spark, sf):
    vec = fx.query_vector(spark, sf, 0)
    return vectors.vector_top_k(fx.drawers(spark, sf), vec, 20).select("id", "similarity")


@query
def vector_topk_filtered(spark, sf):
    vec = fx.query_vector(spark, sf, 3)
    return vectors.vector_top_k(fx.drawers(spark, sf), vec, 10, "wing_2", "en").select("id", "similarity")


@query
def check_duplicate(spark, sf):
    vec = fx.query_vector(spark, sf, 7)
    return vectors.check_duplicate(fx.notes(spark, sf), vec, 0.9).select("id", "similarity")


@query
def check_duplicate_all(spark, sf):
    """Every note at or over the threshold."""
    vec = fx.query_vector(spark, sf, 7)
    return vectors.check_duplicate(fx.notes(spark, sf), vec, 0.9, limit=None).select("id", "similarity")


@query
def preference_search(spark, sf):
    vec = fx.query_vector(spark, sf, 11)
    rows = vectors.preference_top_k(_enriched(fx.notes(spark, sf)), vec, 10)
    return rows.select("id", "wing", "similarity")


@query
def preference_vectors(spark, sf):
    """The same where every second note has a preference vector of its own, which then counts."""
    vec = fx.query_vector(spark, sf, 11)
    own = F.when(F.col("o_orderkey") % 2 == 0, F.reverse("embedding"))
    rows = vectors.preference_top_k(_enriched(fx.notes(spark, sf)).withColumn("pref_embedding", own), vec, 10)
    return rows.select("id", "wing", "similarity")


# -------------------------------------------------------------------- hybrid
def _hybrid(spark, sf, text, vec_id=5, n=10, **kw):
    vec = fx.query_vector(spark, sf, vec_id)
    rows = _enriched(fx.notes(spark, sf))
    return rows, vec, hybrid.hybrid_search(rows, text, vec, n, fx.instant(fx.AS_OF_NOTES), **kw)


_SCORES = ["id", "cosine", "bm25", "coding_boost", "preference_match", "combined"]


@query
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf, NOTE_QUERY)[2].select(*_SCORES)


@query
def hybrid_documents(spark, sf):
    vec = fx.query_vector(spark, sf, 0)
    rows = hybrid.hybrid_search(
        fx.drawers(spark, sf), DOC_QUERY, vec, 10, fx.instant(fx.AS_OF_DRAWERS)
    )
    return rows.select(*_SCORES)


@query
def hybrid_filtered(spark, sf):
    return _hybrid(spark, sf, NOTE_QUERY, wing="wing_3", room="decisions")[2].select(*_SCORES)


@query
def hybrid_indexed(spark, sf):
    vec = fx.query_vector(spark, sf, 5)
    rows = _enriched(fx.notes(spark, sf))
    index = fx.block_index(spark, sf, "notes")
    found = hybrid.hybrid_search(rows, NOTE_QUERY, vec, 10, fx.instant(fx.AS_OF_NOTES), index=index)
    return found.select(*_SCORES)


@query
def hybrid_preference_query(spark, sf):
    return _hybrid(spark, sf, PREF_QUERY, 9)[2].select(*_SCORES)


@query
def hybrid_with_preferences(spark, sf):
    rows, vec, found = _hybrid(spark, sf, "rail cost", 11, n=8)
    return hybrid.merge_preferences(found, rows, vec, 8).select(*_SCORES)


@query
def hybrid_reranked(spark, sf):
    found = _hybrid(spark, sf, PREF_QUERY, 9)[2]
    return hybrid.rerank(found, PREF_QUERY).select("id", "rerank_score", "combined")


@query
def search_with_context(spark, sf):
    rows, _, found = _hybrid(spark, sf, NOTE_QUERY, n=5)
    return hybrid.with_source_context(found, rows).select("hit_id", "id", "source_file", "chunk_index")


@query
def recall_check(spark, sf):
    return hybrid.recall_check(fx.notes(spark, sf), PROBES, 5, fx.instant(fx.AS_OF_NOTES))


def _benchmark(spark, sf):
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query
def bm25_batch(spark, sf):
    """The five best drawers of every benchmark text."""
    found = batch_search.best_by_terms(fx.block_index(spark, sf, "drawers"), _benchmark(spark, sf), 5)
    return found.select("qid", "rank", "id", "bm25")


@query
def recall_batch(spark, sf):
    """For every benchmark text: whether one of its five best drawers holds it, and at which rank."""
    asked = _benchmark(spark, sf)
    found = batch_search.search_all(
        fx.block_index(spark, sf, "drawers"), fx.drawer_text(spark, sf), asked, 5, fx.instant(fx.AS_OF_DRAWERS)
    )
    return batch_search.recall(found, asked, F.contains("content", "query"))


@query
def question_batch(spark, sf):
    """The three best notes for what every supplier asks, boosts and preferences included."""
    asked = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), F.expr(fx.SUPPLIER_QUESTION).alias("query"))
    notes = fx.notes(spark, sf, vectors=False)
    found = batch_search.search_all(fx.block_index(spark, sf, "notes"), notes, asked, 3, fx.instant(fx.AS_OF_NOTES))
    return found.select("qid", "rank", "id", "bm25", "coding_boost", "preference_match", "combined")


# --------------------------------------------------------------- classifiers
@query
def intent_classify(spark, sf):
    return fx.questions(spark, sf).select("o_orderkey", t.query_intent("query").alias("intent"))


@query
def query_rewrite(spark, sf):
    return fx.questions(spark, sf).select("o_orderkey", q.rewrite_column("query").alias("rewritten"))


@query
def query_sanitize(spark, sf):
    return fx.questions(spark, sf).select("o_orderkey", q.sanitize_column("query").alias("sanitized"))


@query
def hall_route(spark, sf):
    notes = fx.note_text(spark, sf).select(F.col("o_orderkey").alias("row_no"), "content", F.lit("note").alias("origin"))
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("row_no"), F.col("text").alias("content"), F.lit("doc").alias("origin"))
    return notes.unionByName(docs).select("origin", "row_no", t.detect_hall("content").alias("hall"))


@query
def convo_room(spark, sf):
    notes = fx.note_text(spark, sf).select(F.col("o_orderkey").alias("row_no"), "content", F.lit("note").alias("origin"))
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("row_no"), F.col("text").alias("content"), F.lit("doc").alias("origin"))
    return notes.unionByName(docs).select("origin", "row_no", t.detect_convo_room("content").alias("room"))


@query
def preference_tag(spark, sf):
    tagged = fx.note_text(spark, sf).filter(t.is_preference("content"))
    return tagged.select("o_orderkey")


@query
def preference_span(spark, sf):
    spans = fx.note_text(spark, sf).select("o_orderkey", t.preference_span("content").alias("span"))
    return spans.filter(F.col("span").isNotNull())


@query
def entity_extract(spark, sf):
    found = fx.note_text(spark, sf).select("o_orderkey", F.inline(t.detect_entities("content")))
    return found.select("o_orderkey", "name", "kind")


@query
def entity_extract_documents(spark, sf):
    docs = fx.documents(spark, sf)
    found = docs.select(F.inline(t.detect_entities("text")))
    return found.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("texts"))


@query
def corpus_origin(spark, sf):
    talk = fx.table(spark, sf, "conversations").withColumn("line", F.concat_ws(": ", "role", "text"))
    return talk.select(
        "conv_id", "turn", t.corpus_platform("line").alias("platform"),
        F.array_join(t.agent_personas("line"), ",").alias("agents"),
    )


@query
def dialect_compress(spark, sf):
    notes = fx.note_text(spark, sf).withColumn("short", t.dialect_compress("content"))
    return notes.select("o_orderkey", "short", t.compression_ratio("content", "short").alias("ratio"))


@query
def snippets(spark, sf):
    return fx.drawer_text(spark, sf).select("id", t.snippet("content", fv.RECALL_SNIPPET).alias("snippet"))


# ----------------------------------------------------------- knowledge graph
_FACT = ["direction", "subject", "predicate", "object", "valid_from", "valid_to", "current"]


@query
def kg_query_out(spark, sf):
    return kg.query_entity(*fx.kg(spark, sf), "Customer 7", None, "outgoing").select(*_FACT)


@query
def kg_query_in(spark, sf):
    triples, entities = fx.kg(spark, sf)
    return kg.query_entity(triples, entities, "5-LOW", None, "incoming").select(*_FACT)


@query
def kg_query_both(spark, sf):
    nation = fx.table(spark, sf, "nation").filter("n_nationkey = 3").first()["n_name"]
    return kg.query_entity(*fx.kg(spark, sf), nation).select(*_FACT)


@query
def kg_as_of(spark, sf):
    return kg.query_entity(*fx.kg(spark, sf), "Customer 7", "1998-06-01", "outgoing").select(*_FACT)


@query
def kg_relationship(spark, sf):
    return kg.query_relationship(*fx.kg(spark, sf), "Has Priority", "1998-06-01").select(*_FACT)


@query
def kg_timeline(spark, sf):
    return kg.timeline(*fx.kg(spark, sf)).select(*_FACT)


@query
def kg_timeline_all(spark, sf):
    return kg.timeline(*fx.kg(spark, sf), limit=None).select(*_FACT)


@query
def kg_timeline_entity(spark, sf):
    return kg.timeline(*fx.kg(spark, sf), "Customer 11").select(*_FACT)


@query
def kg_stats(spark, sf):
    return kg.stats(*fx.kg(spark, sf))


@query
def kg_conflicts(spark, sf):
    return kg.conflict_groups(*fx.kg(spark, sf))


@query
def kg_conflict_facts(spark, sf):
    return kg.conflict_facts(*fx.kg(spark, sf)).select(
        "subject", "predicate", "object", "valid_from", "valid_to", "current"
    )


@query
def kg_invalidate(spark, sf):
    triples, _ = fx.kg(spark, sf)
    ended = kg.invalidate(triples, "Customer 7", "lives in", _home_of(spark, sf, 7), "2002-01-01")
    rows = ended.filter(F.col("subject") == "customer_7")
    return rows.select("subject", "predicate", "object", "valid_from", "valid_to")


def _home_of(spark, sf, customer: int) -> str:
    c = fx.table(spark, sf, "customer").filter(F.col("c_custkey") == customer)
    n = fx.table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).first()["n_name"]


@query
def kg_add_triples(spark, sf):
    """Facts that a second load of each customer's priorities would add."""
    triples, _ = fx.kg(spark, sf)
    again = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("has priority").alias("predicate"), F.col("o_orderpriority").alias("object"),
        F.lit("2001-01-01").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
    )
    incoming = kg.with_ids(again, F.col("valid_from")).withColumn("confidence", F.lit(1.0))
    fresh = kg.new_triples(triples, incoming)
    return fresh.select("subject", "predicate", "object", "valid_from", "valid_to")


# ----------------------------------------------------------------- room graph
@query
def room_nodes(spark, sf):
    return rooms.room_nodes(fx.room_drawers(spark, sf))


@query
def room_edge_counts(spark, sf):
    return rooms.edge_counts(fx.room_drawers(spark, sf))


@query
def room_edges_of_wing(spark, sf):
    return rooms.edges_of_wing(fx.price_rooms(spark, sf), "customer_7")


@query
def find_tunnels(spark, sf):
    return rooms.find_tunnels(fx.price_rooms(spark, sf))


@query
def find_tunnels_all(spark, sf):
    return rooms.find_tunnels(fx.price_rooms(spark, sf), limit=None)


@query
def find_tunnels_between(spark, sf):
    return rooms.find_tunnels(fx.room_drawers(spark, sf), *_two_nations(spark, sf))


def _two_nations(spark, sf) -> list[str]:
    rows = fx.table(spark, sf, "nation").filter("n_nationkey IN (2, 3)").orderBy("n_nationkey")
    return [r["n_name"] for r in rows.collect()]


@query
def graph_stats(spark, sf):
    return rooms.graph_stats(fx.price_rooms(spark, sf))


@query
def rooms_per_wing(spark, sf):
    return rooms.rooms_per_wing(fx.price_rooms(spark, sf))


@query
def top_tunnels(spark, sf):
    return rooms.top_tunnels(fx.price_rooms(spark, sf))


@query
def traverse(spark, sf):
    return rooms.traverse(fx.price_rooms(spark, sf), "price-1000", 2)


@query
def traverse_all(spark, sf):
    """Every room within four hops."""
    return rooms.traverse(fx.price_rooms(spark, sf), "price-1000", 4, limit=None)


@query
def traverse_links(spark, sf):
    sightings = fx.price_rooms(spark, sf)
    return rooms.connecting_wings(sightings, rooms.traverse(sightings, "price-1000", 1))


@query
def room_suggestions(spark, sf):
    return rooms.suggest_rooms(fx.price_rooms(spark, sf), "PRICE-10-x")


def _tunnels(spark, sf):
    """A stored tunnel per customer, from its segment to its nation."""
    customer = fx.table(spark, sf, "customer")
    wanted = customer.select(
        F.concat(F.lit("Wing "), F.col("c_mktsegment")).alias("wing_a"),
        F.concat(F.lit("room_"), (F.col("c_custkey") % 6).cast("string")).alias("room_a"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("wing_b"),
        F.concat(F.lit("room_"), (F.col("c_custkey") % 4).cast("string")).alias("room_b"),
        F.when(F.col("c_custkey") % 2 == 0, " explicit ").otherwise(" ").alias("kind"),
    )
    return rooms.tunnel_rows(wanted).withColumn("created_at", F.lit(fx.EPOCH_2024))


@query
def list_tunnels(spark, sf):
    rows = rooms.list_tunnels(_tunnels(spark, sf), "Wing BUILDING", "explicit")
    return rows.select("wing_a", "room_a", "wing_b", "room_b", "kind")


@query
def follow_tunnels(spark, sf):
    rows = rooms.follow_tunnels(_tunnels(spark, sf), "nation 3", "room_2")
    return rows.select("wing_a", "room_a", "wing_b", "room_b", "kind")


def _closets(spark, sf):
    """A closet per wing and language, pointing to the drawers filed there."""
    filed = fx.drawer_text(spark, sf).groupBy("wing", "room", "source_file").agg(
        F.array_sort(F.collect_list("id")).alias("pointer_drawer_ids")
    )
    return closets.closet_rows(filed.withColumnRenamed("source_file", "topic"))


@query
def list_closets(spark, sf):
    rows = closets.list_closets(_closets(spark, sf), None, "en")
    return rows.select("wing", "room", "topic", F.size("pointer_drawer_ids").alias("pointers"))


@query
def resolve_closets(spark, sf):
    pointed = closets.resolve(_closets(spark, sf), fx.drawer_text(spark, sf))
    return pointed.select("topic", "pos", "id")


# ---------------------------------------------------------------------- usage
@query
def usage_kpis(spark, sf):
    return usage.kpis(fx.usage_events(spark, sf))


@query
def usage_kpis_window(spark, sf):
    events = usage.in_scope(fx.usage_events(spark, sf), "project_2", "7d", fx.instant(fx.AS_OF_USAGE))
    return usage.kpis(events)


@query
def usage_by_project(spark, sf):
    return usage.by_project(fx.usage_events(spark, sf))


@query
def tool_latency(spark, sf):
    return usage.tool_latency(fx.usage_events(spark, sf))


@query
def overall_latency(spark, sf):
    return usage.overall_latency(fx.usage_events(spark, sf))


@query
def top_wings(spark, sf):
    return usage.top_places(fx.usage_events(spark, sf), "wing")


@query
def top_rooms(spark, sf):
    return usage.top_places(fx.usage_events(spark, sf), "room")


@query
def top_queries(spark, sf):
    return usage.top_queries(fx.usage_events(spark, sf))


@query
def repeat_questions(spark, sf):
    return usage.repeat_flags(fx.usage_events(spark, sf)).select("id", "is_repeat")


@query
def repeat_24h(spark, sf):
    return usage.repeats_within_day(fx.usage_events(spark, sf)).select("id", "is_repeat")


@query
def save_status(spark, sf):
    return usage.save_status(fx.usage_events(spark, sf), fx.instant(fx.AS_OF_USAGE), fv.SAVE_WINDOW_MINUTES)


@query
def usage_history(spark, sf):
    scoped = usage.in_scope(fx.usage_events(spark, sf), "project_1", "7d", fx.instant(fx.AS_OF_USAGE))
    return usage.history(scoped, 40)


@query
def implicit_feedback(spark, sf):
    rows = usage.implicit_feedback(fx.usage_events(spark, sf))
    return rows.select("query_id", "drawer_id", "verdict")


@query
def precision_at_k(spark, sf):
    return usage.precision(fx.usage_events(spark, sf), fx.explicit_feedback(spark, sf))


@query
def precision_by_intent(spark, sf):
    return usage.precision_by_intent(fx.usage_events(spark, sf), fx.explicit_feedback(spark, sf))


def _calls(spark, sf):
    """Raw tool calls rebuilt from events, arguments and results as JSON."""
    n = F.col("event_id").cast("string")
    hits = F.concat(
        F.lit('[{"id":"drawer_'), n, F.lit('","wing":"wing_r","room":" room_r ","similarity":0.5},{"id":"drawer_x"}]')
    )
    args = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"query":"  Order   '), (F.col("event_id") % 40).cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"entity":"Customer '), n, F.lit('","wing":"w"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"entry":"see drawer_'), n, F.lit(', and diary_7."}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"drawer_id":"drawer_'), n, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"content":"copy '), n, F.lit('"}')))
    )
    result = (
        F.when(F.col("event_id") % 17 == 0, F.lit('{"error":"broken"}'))
        .when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), F.lit('{"results":[]}'))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"query_id":"query_'), n, F.lit('","intent":"decision","results":'), hits, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"facts":['), F.when(F.col("event_id") % 2 == 0, "1,2").otherwise(""), F.lit("]}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"is_duplicate":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"matches":[{"similarity":0.91}]}')))
        .otherwise(F.lit('{"success":true}'))
    )
    tool = F.expr("CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'kg_query' WHEN 'purchase' THEN 'diary_write' WHEN 'signup' THEN 'delete_drawer' ELSE 'check_duplicate' END")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", tool.alias("tool"), args.alias("args"), result.alias("result")
    )


@query
def classify_calls(spark, sf):
    average = catalog.average_drawer_tokens(fx.drawer_text(spark, sf)).scalar()
    rows = usage.classify_calls(_calls(spark, sf), average)
    return rows.select(
        "id", "tool", "wing", "room", "result_count", "top_similarity", "est_tokens_saved", "outcome"
    )


# ---------------------------------------------------------------------- diary
@query
def diary_recent(spark, sf):
    return diary.latest(fx.diary(spark, sf), 10).select("wing", "rank", "id")


@query
def list_agents(spark, sf):
    return diary.agents(fx.diary(spark, sf))


@query
def session_context(spark, sf):
    rows = diary.session_context(fx.diary(spark, sf), "Agent 1", fx.instant(fx.AS_OF_DIARY), "/work/p1")
    return rows.select("id", "wing", "filed_at", "cross_agent")


@query
def session_context_other_agent(spark, sf):
    rows = diary.session_context(fx.diary(spark, sf), "nobody", fx.instant(fx.AS_OF_DIARY))
    return rows.select("id", "wing", "filed_at", "cross_agent")


@query
def last_session(spark, sf):
    return diary.last_session(fx.diary(spark, sf), fx.instant(fx.AS_OF_DIARY)).select("id", "filed_at")


# ------------------------------------------------------ chunks and memories
@query
def pair_turns(spark, sf):
    return memories.pair_turns(fx.table(spark, sf, "conversations"))


@query
def extract_memories(spark, sf):
    found = memories.extract_memories(fx.note_text(spark, sf), "content")
    return memories.number_memories(found, "o_orderkey").select(
        "o_orderkey", "chunk_index", "memory_type", "confidence", "content"
    )


@query
def extract_memories_documents(spark, sf):
    docs = fx.documents(spark, sf)
    found = memories.number_memories(memories.extract_memories(docs, "text"), "doc_id")
    return found.select("doc_id", "chunk_index", "memory_type", "content")


@query
def text_segments(spark, sf):
    docs = fx.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(memories.segments("text")).alias("pos", "segment"))


@query
def chunk_documents(spark, sf):
    docs = fx.documents(spark, sf)
    return chunking.chunk_rows(docs, "text")


@query
def chunk_exchanges(spark, sf):
    docs = fx.documents(spark, sf)
    return chunking.exchange_rows(docs, "text")


# --------------------------------------------------------------------- writes
@query
def prune(spark, sf):
    from mnemospark.plans import store

    kept = store.pruned(fx.drawer_text(spark, sf), 350, fx.instant(fx.AS_OF_DRAWERS))
    return kept.select("id")


@query
def dedupe_append(spark, sf):
    """New drawers when every page is filed under its address and remarks follow."""
    from mnemospark.plans import store

    pages = fx.table(spark, sf, "pages")
    incoming = pages.select(
        F.concat(F.lit("drawer_"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("content")
    ).unionByName(
        pages.select(F.concat(F.lit("page_"), (F.col("page_id") % 40).cast("string")).alias("id"), F.col("url").alias("content"))
    )
    fresh = store.new_rows(fx.drawer_text(spark, sf).select("id"), incoming, ["content"])
    return fresh.select("id", "content")


def _drawer_store(spark, sf):
    """A new store that holds the drawers of all documents, in two appends."""
    from mnemospark.plans.store import Store

    store = Store(spark, new_path(spark, "store"))
    rows = fx.drawer_text(spark, sf)
    for half in (0, 1):
        store.append("drawers", rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half))
    return store


@query
def delete_rows(spark, sf):
    """Drawers left when those of toxic documents go, and when some of these are filed anew."""
    store = _drawer_store(spark, sf)
    toxic = fx.table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("drawer_"), F.col("doc_id").cast("string")).alias("id"))
    before = store.read("drawers").join(toxic, "id", "left_semi")
    store.delete("drawers", toxic)
    back = before.where("chunk_index = 0").withColumn("room", F.lit("again"))
    store.append("drawers", back)
    return store.read("drawers").select("id", "wing", "room", F.length("content").alias("chars"))


@query
def update_rows(spark, sf):
    """Drawers after those of labelled documents moved to other rooms, twice, and the table was compacted between."""
    store = _drawer_store(spark, sf)
    labels = fx.table(spark, sf, "labels").select(F.concat(F.lit("drawer_"), F.col("doc_id").cast("string")).alias("id"), "quality", "toxic")
    good = store.read("drawers").join(labels.where("quality = 1"), "id").withColumn("room", F.lit("good"))
    store.update("drawers", good)
    store.compact(("drawers",))
    toxic = store.read("drawers").join(labels.where("toxic = 1"), "id").withColumn("room", F.concat("room", F.lit("/toxic")))
    store.update("drawers", toxic)
    return store.read("drawers").select("id", "wing", "room", F.length("content").alias("chars"))


@query
def normalize_chats(spark, sf):
    """Transcripts of all conversations, read from exports of five formats; null where none is found."""
    from mnemospark.sources import chats

    exports = fx.chat_exports(spark, sf).withColumn("export", F.col("content"))
    read = chats.normalized(exports, "content", F.lit("json"))
    return read.select("conv_id", "format", F.nullif("content", "export").alias("transcript"))


@query
def export_rows(spark, sf):
    from mnemospark.sources import exchange

    rows = exchange.export_rows(fx.drawers(spark, sf).withColumn("added_by", F.lit("me")))
    return rows.select("id", "wing", "room", "content", "source_file", "chunk_index", "filed_at", "importance")


@query
def import_rows(spark, sf):
    """Exported rows read back: ids and metadata as they were, whatever the place."""
    from mnemospark.sources import exchange

    metadata = F.concat(F.lit('{"session":"007","n":'), (F.col("chunk_index") % 7), F.lit(',"list":["[a]",1]}'))
    exported = exchange.export_rows(
        fx.drawers(spark, sf).withColumn("added_by", F.lit("me")).withColumn("metadata", metadata)
    )
    back = exchange.import_rows(exported, fx.instant(fx.AS_OF_DRAWERS))
    return back.select("id", "wing", "room", "content", "source_file", "chunk_index", "importance", "metadata")


@query
def metadata_merge(spark, sf):
    """Preference keys set or removed in stored metadata."""
    from mnemospark.plans import store

    rows = fx.note_text(spark, sf).withColumn(
        "metadata",
        F.concat(
            F.lit('{"code":"007","nested":{"a":[1,"2"],"b":null},"preference":true,"preference_span":"old","topic":"[draft] '),
            F.col("o_orderkey"), F.lit('"}'),
        ),
    )
    merged = store.merged_metadata("metadata", "content")
    return rows.select("o_orderkey", merged.alias("m")).select(
        "o_orderkey", F.get_json_object("m", "$.topic").alias("topic"),
        F.get_json_object("m", "$.preference").alias("preference"),
        F.get_json_object("m", "$.preference_span").alias("span"),
        F.to_json(F.variant_get(F.parse_json("m"), "$.code", "variant")).alias("code"),
        F.get_json_object("m", "$.nested").alias("nested"),
    )
