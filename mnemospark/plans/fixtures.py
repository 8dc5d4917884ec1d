"""Domain views over the given tables.

Nothing here is made up: every row is derived from a row of the tables, so the
work of each query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.block_index import BlockIndex
from mnemospark.operators.ordered import neighbour
from mnemospark.session import new_path

EPOCH_2024 = 1_704_067_200
AS_OF_DRAWERS = 1_735_689_600  # 2025-01-01
AS_OF_NOTES = 1_009_843_200  # 2002-01-01
AS_OF_DIARY = 1_704_067_200 + 30 * 3600
AS_OF_USAGE = 1_706_659_200  # 2024-01-31

# Ten kinds of remark about an order; plain SQL that Spark and the oracle share.
NOTE_TEXT = """
CASE o_orderkey % 10
 WHEN 0 THEN concat('Noted for order ', cast(o_orderkey AS string), '. I prefer ', lower(o_orderpriority),
   ' handling. We never use plain labels!')
 WHEN 1 THEN concat('We decided to ship order ', cast(o_orderkey AS string),
   ' by rail rather than road because the tradeoff was cost. The approach is the default now.')
 WHEN 2 THEN concat('The bug in order ', cast(o_orderkey AS string),
   ' failed twice. Root cause was a broken label, the fix was a new printer and it was fixed. It works, amazing and perfect.')
 WHEN 3 THEN concat('Run cargo test before order ', cast(o_orderkey AS string),
   ' leaves.\nSetup steps are in the command guide -- see DeskAPI and order-tools.')
 WHEN 4 THEN concat('I feel happy and proud of order ', cast(o_orderkey AS string),
   '. I love this team, they are wonderful.')
 WHEN 5 THEN concat('Walker: Alice Walker asked about PricingAPI for order ', cast(o_orderkey AS string),
   '. DeskSQL holds the answer.')
 WHEN 6 THEN concat('What changed in order ', cast(o_orderkey AS string),
   ' since the last session? The problem is that it keeps failing, error after error.')
 WHEN 7 THEN concat('My convention is to always use snake_case names. ', o_orderpriority,
   ' orders like ', cast(o_orderkey AS string), ' must never use tabs.')
 WHEN 8 THEN concat('What is the status of order ', cast(o_orderkey AS string), '? ', o_orderpriority)
 ELSE concat('Remember the archive: recall the database design of order ', cast(o_orderkey AS string),
   ' and the music in the game story.')
END"""
NOTE_ROOM = """
CASE o_orderkey % 10 WHEN 0 THEN 'preferences' WHEN 1 THEN 'decisions' WHEN 2 THEN 'problems'
 WHEN 3 THEN 'commands' WHEN 4 THEN 'general' WHEN 5 THEN 'support' WHEN 6 THEN 'current'
 WHEN 7 THEN 'conventions' WHEN 8 THEN 'questions' ELSE 'memory' END"""
# Questions of suppliers; plain SQL that Spark and the oracle share.
SUPPLIER_QUESTION = """
CASE s_suppkey % 5
 WHEN 0 THEN concat('what do i prefer for order ', cast(s_suppkey AS string), ' handling?')
 WHEN 1 THEN concat('why did we decide to ship order ', cast(s_suppkey AS string), ' by rail')
 WHEN 2 THEN concat('run cargo test before order ', cast(s_suppkey AS string))
 WHEN 3 THEN concat('what failed, the root cause of bug ', cast(s_suppkey AS string))
 ELSE concat('database design of order ', cast(s_suppkey AS string), ', as of the last session') END"""
# Questions an agent might ask about an order.
QUESTION_TEXT = """
CASE o_orderkey % 8
 WHEN 0 THEN concat('What do I prefer for ', o_orderpriority, ' orders?')
 WHEN 1 THEN concat('why did we choose rail for order ', cast(o_orderkey AS string), '?')
 WHEN 2 THEN concat('How do I run the cli setup for the api, order ', cast(o_orderkey AS string), '?')
 WHEN 3 THEN concat('What is the status of order ', cast(o_orderkey AS string), '?')
 WHEN 4 THEN concat('You are an agent.\n{"tool":"shell"}\nSearch query: mcp server for order ',
   cast(o_orderkey AS string), '\nend')
 WHEN 5 THEN concat('plain words about order ', cast(o_orderkey AS string))
 WHEN 6 THEN concat('context line\n```\nquery code\n```\nDid the db test of order ',
   cast(o_orderkey AS string), ' fail?\nother line')
 ELSE concat('tell me about impl, auth and rpc of order ', cast(o_orderkey AS string), ' as of now')
END"""
TOOL = """
CASE event_type WHEN 'click' THEN 'search' WHEN 'error' THEN 'search' WHEN 'view' THEN 'kg_query'
 WHEN 'purchase' THEN 'diary_write' WHEN 'signup' THEN 'delete_drawer' ELSE 'noop' END"""
OUTCOME = """
CASE event_type WHEN 'click' THEN 'hit' WHEN 'error' THEN 'error' WHEN 'view' THEN 'kg_fact'
 WHEN 'purchase' THEN (CASE WHEN event_id % 2 = 0 THEN 'duplicate_skip' ELSE 'diary_recall' END)
 ELSE 'miss' END"""
INTENT = """
CASE event_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'how_to' WHEN 2 THEN 'preference'
 ELSE 'unknown' END"""
FLAGGED = "event_id % 7 = 0"
TOP_DRAWER = "concat('drawer_', cast((event_id * 3 + {k}) % 50 AS string))"
META = f"""
CASE event_type
 WHEN 'click' THEN concat('{{"query_id":"query_', cast(event_id AS string), '","intent":"', {INTENT},
   '","top_drawer_ids":["', {TOP_DRAWER.format(k=0)}, '","', {TOP_DRAWER.format(k=11)}, '","',
   {TOP_DRAWER.format(k=22)}, '"]', CASE WHEN {FLAGGED} THEN ',"is_repeat":true' ELSE '' END, '}}')
 WHEN 'purchase' THEN concat('{{"referenced_drawer_ids":["drawer_', cast(event_id % 50 AS string), '"]}}')
 WHEN 'signup' THEN concat('{{"drawer_id":"drawer_', cast(event_id % 50 AS string), '"}}')
 ELSE '{{}}' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(epoch: int) -> Column:
    return F.timestamp_seconds(F.lit(epoch))


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawer per document; a vector where one has the same number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    file_no = F.floor(F.col("doc_id") / 5)
    joined = docs.join(labels, "doc_id", "left").join(vecs, "doc_id", "left")
    return joined.select(
        F.concat(F.lit("drawer_"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("wing_"), (file_no % 20).cast("string")).alias("wing"),
        F.col("lang").alias("room"),
        F.col("text").alias("content"),
        F.concat(F.lit("file_"), file_no.cast("string")).alias("source_file"),
        (F.col("doc_id") % 5).alias("chunk_index"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("filed_at"),
        (
            F.lit(3.0) + F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0))
        ).alias("importance"),
        "embedding",
    )


def drawer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawers without importance and vector: no join, straight from the scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    file_no = F.floor(F.col("doc_id") / 5)
    return docs.select(
        F.concat(F.lit("drawer_"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("wing_"), (file_no % 20).cast("string")).alias("wing"),
        F.col("lang").alias("room"),
        F.col("text").alias("content"),
        F.concat(F.lit("file_"), file_no.cast("string")).alias("source_file"),
        (F.col("doc_id") % 5).alias("chunk_index"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("filed_at"),
    )


def notes(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """One remark per order, two thirds of them with a vector."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    rows = orders.select(
        "o_orderkey",
        F.concat(F.lit("note_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("wing_"), (F.col("o_custkey") % 25).cast("string")).alias("wing"),
        F.expr(NOTE_ROOM).alias("room"),
        F.expr(NOTE_TEXT).alias("content"),
        F.concat(
            F.lit("desk_"), F.floor(F.col("o_orderkey") / 4).cast("string")
        ).alias("source_file"),
        (F.col("o_orderkey") % 4).alias("chunk_index"),
        F.col("o_orderdate").cast("timestamp").alias("filed_at"),
        (F.lit(1.0) + F.col("o_orderkey") % 5).alias("importance"),
    )
    if not vectors:
        return rows
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vecs.agg(F.count(F.lit(1))).scalar()
    # Rows without a vector take no part in the join: a null key would bring them all to one task.
    with_vec = (F.col("o_orderkey") % 3 != 0) & (size > 0)
    joined = rows.where(with_vec).withColumn("vec_id", F.col("o_orderkey") * 7 % size).join(vecs, "vec_id", "left").drop("vec_id")
    return joined.unionByName(rows.where(~with_vec).withColumn("embedding", F.lit(None).cast("array<float>")))


_INDEXES: dict[tuple[str, str, str], BlockIndex] = {}


def block_index(spark: SparkSession, sf_dir: str, of: str) -> BlockIndex:
    """The stored index of all drawers or notes: written at the first use in a session, read afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, of)
    if key not in _INDEXES:
        rows = drawer_text(spark, sf_dir) if of == "drawers" else notes(spark, sf_dir, vectors=False)
        _INDEXES[key] = BlockIndex.write(rows, new_path(spark, "index"))
    return _INDEXES[key]


def chat_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, format, content): every conversation as an export of one of five formats, by its number."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role, text = F.col("role"), F.col("text")
    one = {
        "session": F.to_json(F.struct(role.alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")).alias("message"))),
        "events": F.to_json(F.struct(
            F.lit("event_msg").alias("type"),
            F.struct(F.concat(F.when(role == "assistant", "agent").otherwise(role), F.lit("_message")).alias("type"), text.alias("message")).alias("payload"),
        )),
        "list": F.to_json(F.struct(role.alias("role"), text.alias("content"))),
        "channel": F.to_json(F.struct(F.when(role == "system", "join").otherwise("message").alias("type"), role.alias("user"), text.alias("text"))),
        "tree": F.concat(F.lit('"n'), F.col("turn").cast("string"), F.lit('":'), F.to_json(F.struct(
            F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message"),
            F.concat(F.lit("n"), (F.col("turn") - 1).cast("string")).alias("parent"),
            F.array(F.concat(F.lit("n"), (F.col("turn") + 1).cast("string"))).alias("children"),
        ))),
    }
    names = F.array(*(F.lit(n) for n in one))
    kind = F.get(names, (F.col("conv_id") % len(one)).cast("int"))
    piece = F.coalesce(*(F.when(kind == n, line) for n, line in one.items()))
    whole = turns.groupBy("conv_id", kind.alias("format")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("line")))), lambda t: t["line"]).alias("lines"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    joined = F.array_join("lines", ",")
    low, high = F.col("low").cast("string"), (F.col("high") + 1).cast("string")
    # The tree gets a root without a message, and an empty node that ends the chain.
    tree = F.concat(
        F.lit('{"mapping":{"root":{"parent":null,"children":["n'), low, F.lit('"]},'), joined,
        F.lit(',"n'), high, F.lit('":{"parent":"x","children":[]}}}'),
    )
    content = (
        F.when(F.col("format") == "session", F.array_join("lines", "\n"))
        .when(F.col("format") == "events", F.concat(F.lit('{"type":"session_meta"}\n'), F.array_join("lines", "\n")))
        .when(F.col("format") == "list", F.concat(F.lit('{"messages":['), joined, F.lit("]}")))
        .when(F.col("format") == "channel", F.concat(F.lit("["), joined, F.lit("]")))
        .otherwise(tree)
    )
    return whole.select("conv_id", "format", content.alias("content"))


def note_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.select("o_orderkey", F.expr(NOTE_TEXT).alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.select("o_orderkey", F.expr(QUESTION_TEXT).alias("query"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id)
    return list(rows.select("embedding").first()[0])


# ---------------------------------------------------------- knowledge graph
def kg_facts(spark: SparkSession, sf_dir: str, dated: bool = True) -> DataFrame:
    """Facts by name; without dates the orders need not be put in order."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    following = orders.withColumns({"_day": day, "_year": F.year("o_orderdate")})
    if dated:
        following = neighbour(
            following, ["o_custkey"], "_year", ["o_orderdate", "o_orderkey"], ["_day"], +1
        )
    else:
        following = following.withColumn("_day_near", none)
    priority = following.select(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("has_priority").alias("predicate"),
        F.col("o_orderpriority").alias("object"),
        F.col("_day").alias("valid_from"),
        F.col("_day_near").alias("valid_to"),
    )
    lives = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("subject"),
        F.lit("lives_in").alias("predicate"), F.col("n_name").alias("object"),
        none.alias("valid_from"), none.alias("valid_to"),
    )
    within = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("subject"), F.lit("in_region").alias("predicate"),
        F.col("r_name").alias("object"), none.alias("valid_from"), none.alias("valid_to"),
    )
    return priority.unionByName(lives).unionByName(within)


def kg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from mnemospark.operators import kg as ops

    facts = kg_facts(spark, sf_dir)
    triples = ops.with_ids(facts, F.col("valid_from")).withColumn("confidence", F.lit(1.0))
    return triples, ops.entities_of(kg_facts(spark, sf_dir, dated=False))


# --------------------------------------------------------------- room graph
def room_drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sighting per line item: room = kind and brand of the part, wing = nation
    of the supplier."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", F.lower("p_type"), F.lower("p_brand")).alias("room"),
            F.col("n_name").alias("wing"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        )
    )


def price_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sighting per order: room = price band, wing = customer.  Sparse, so walks
    take several hops."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("price-"), F.floor(F.col("o_totalprice") / 200).cast("string")).alias("room"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("wing"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


# -------------------------------------------------------------------- usage
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("project_"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.expr(TOOL).alias("tool"),
        F.concat(F.lit("wing_"), (F.col("user_id") % 9).cast("string")).alias("wing"),
        F.concat(F.lit("room_"), (F.col("event_id") % 11).cast("string")).alias("room"),
        F.when(F.col("event_id") % 13 != 0, F.col("props")).alias("query_hash"),
        (F.lit(1) + F.col("user_id") % 4).alias("result_count"),
        F.floor(F.col("value") * 10).cast("long").alias("est_tokens_saved"),
        F.floor("value").cast("long").alias("duration_ms"),
        F.expr(OUTCOME).alias("outcome"),
        F.expr(META).alias("meta"),
    )


def explicit_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per labelled number, on the top drawer of the query so numbered."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "event_id")
    verdict = (
        F.when(F.col("toxic") == 1, "wrong_answer")
        .when(F.col("quality") == 1, "useful")
        .otherwise("not_useful")
    )
    return labels.select(
        F.concat(F.lit("query_"), F.col("event_id").cast("string")).alias("query_id"),
        F.expr(TOP_DRAWER.format(k=0)).alias("drawer_id"),
        verdict.alias("verdict"),
    )


# -------------------------------------------------------------------- diary
def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as diary entries of three agents."""
    talk = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return talk.select(
        F.concat_ws("_", F.lit("entry"), F.col("conv_id"), F.col("turn")).alias("id"),
        F.concat(
            F.lit("wing_diary__agent_"), (F.col("conv_id") % 3).cast("string")
        ).alias("wing"),
        F.col("text").alias("content"),
        F.timestamp_seconds(
            F.lit(EPOCH_2024) + F.col("conv_id") * 3600 + F.col("turn")
        ).alias("filed_at"),
        F.concat(F.lit("/work/p"), (F.col("conv_id") % 4).cast("string")).alias("project_path"),
    )
