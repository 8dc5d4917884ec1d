"""BM25 over drawer text.

Two ways to score.  ``score_text`` reads un-indexed drawers: it counts only the
query's terms inside each row, so no token is ever shuffled.  ``score_postings``
reads a stored inverted index and touches only the postings of the query's terms.
N, average length and document frequency always come from the whole corpus; a
wing or room filter narrows the scored rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import text as t
from mnemospark.functions.columns import any_of, computed, let
from mnemospark.session import stored

TERM_BUCKETS = 512


def query_terms(query: str) -> list[str]:
    return sorted(set(q.tokenize(query)))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def term_weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    norm = 1.0 - fv.BM25_B + fv.BM25_B * (doc_len / avg_len)
    return tf * (fv.BM25_K1 + 1.0) / (tf + fv.BM25_K1 * norm)


def occurrences(hits: str, word: str) -> Column:
    return F.size(F.filter(hits, lambda x: x == word)).cast("double")


def narrow(df: DataFrame, wing: str | None, room: str | None) -> DataFrame:
    """Optional equality filters, built only when given so that they prune."""
    if wing is not None:
        df = df.filter(F.col("wing") == wing)
    if room is not None:
        df = df.filter(F.col("room") == room)
    return df


# ------------------------------------------------------------ un-indexed text
def _with_hits(rows: DataFrame, terms: list[str], skip_misses: bool = False) -> DataFrame:
    """Adds _len and the query-term occurrences _hits of each row.

    With ``skip_misses`` a cheap substring test decides first, and rows that
    cannot match are not tokenised; their _hits are null.
    """
    words = t.tokens("content")
    if skip_misses:
        held = let(F.lower("content"), lambda low: any_of(low.contains(w) for w in terms))
        words = F.when(held, words)
    one = let(
        words,
        lambda ws: F.struct(
            F.size(ws).alias("len"), F.filter(ws, lambda x: x.isin(terms)).alias("hits")
        ),
    )
    return computed(rows, {"_w": one}).withColumns(
        {"_len": F.col("_w.len"), "_hits": F.col("_w.hits")}
    ).drop("_w")


def corpus_stats(drawers: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n, avg_len and the document frequency of each term."""
    counted = _with_hits(drawers.select("content"), terms)
    return counted.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("_len").alias("avg_len"),
        F.array(
            *[
                F.count_if(F.array_contains("_hits", w)).cast("double")
                for w in terms
            ]
        ).alias("df"),
    )


def score_text(
    drawers: DataFrame, query: str, wing: str | None = None, room: str | None = None
) -> DataFrame:
    """Drawers of the filter with a ``bm25`` column, null where no term occurs."""
    terms = query_terms(query)
    scope = narrow(drawers, wing, room)
    if not terms:
        return scope.withColumn("bm25", F.lit(None).cast("double"))
    stats = corpus_stats(drawers, terms).select(F.struct("n", "avg_len", "df")).scalar()
    rows = _with_hits(scope, terms, skip_misses=True).withColumn("_stats", stats)
    parts = []
    for i, w in enumerate(terms):
        weight = term_weight(occurrences("_hits", w), F.col("_len"), F.col("_stats.avg_len"))
        parts.append(idf(F.col("_stats.n"), F.col("_stats.df")[i]) * weight)
    total = reduce(lambda a, b: a + b, parts)
    scored = computed(rows, {"bm25": F.when(F.size("_hits") > 0, total)})
    return scored.drop("_len", "_hits", "_stats")


def bm25_search(
    drawers: DataFrame,
    query: str,
    n: int,
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    scored = score_text(drawers, query, wing, room).filter(F.col("bm25").isNotNull())
    return scored.orderBy(F.desc("bm25"), F.desc("filed_at"), "id").limit(n)


# -------------------------------------------------------------- stored index
def term_runs(rows: DataFrame) -> DataFrame:
    """The rows without ``content``, with doc_len and runs: each of its terms and how often it occurs.

    A drawer is one row, so its term counts are run lengths in its own sorted
    token array; grouping exploded tokens would shuffle every one of them.
    """
    ordered = computed(rows, {"s": F.sort_array(t.tokens("content"))}).drop("content")
    starts = computed(
        ordered,
        {
            "p": F.filter(
                F.transform(
                    "s", lambda x, i: F.when((i == 0) | (F.get("s", i - 1) != x), i)
                ),
                F.isnotnull,
            )
        },
    )
    runs = F.transform(
        "p",
        lambda at, j: F.struct(
            F.get("s", at).alias("term"),
            (F.coalesce(F.get("p", j + 1), F.size("s")) - at).cast("long").alias("tf"),
        ),
    )
    return starts.select(*ordered.drop("s").columns, F.size("s").cast("long").alias("doc_len"), runs.alias("runs"))


def postings(drawers: DataFrame) -> DataFrame:
    """(drawer_id, wing, room, term, tf, doc_len), built without a shuffle."""
    keyed = drawers.select(F.col("id").alias("drawer_id"), "wing", "room", "content")
    rows = term_runs(keyed).select("*", F.explode("runs").alias("r"))
    return rows.select("drawer_id", "wing", "room", "r.term", "r.tf", "doc_len")


def doc_stats(drawers: DataFrame) -> DataFrame:
    return drawers.select(
        F.col("id").alias("drawer_id"),
        F.size(t.tokens("content")).cast("long").alias("doc_len"),
    )


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def python_term_buckets(spark, terms: list[str]) -> list[int]:
    """Buckets of a few literal terms, folded by the optimiser without a scan."""
    if not terms:
        return []
    row = spark.range(1).select(F.array(*[term_bucket(F.lit(w)) for w in terms])).first()
    return sorted(set(row[0]))


def contributions(
    post: DataFrame,
    stats: DataFrame,
    query: str,
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    """(drawer_id, part): what each query term adds to each drawer's score.

    Partition pruning on ``term_bucket`` and a pushed-down term filter leave only
    the postings of the query's terms; their counts give the document frequency.
    """
    terms = query_terms(query)
    hits = post.filter(F.col("term").isin(terms))
    if "term_bucket" in post.columns:
        hits = hits.filter(F.col("term_bucket").isin(python_term_buckets(post.sparkSession, terms)))
    df = document_frequency(hits)
    corpus = stats.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("doc_len").alias("avg_len")
    )
    # At most one row per distinct query term, so the broadcast is bounded.
    weighted = narrow(hits, wing, room).join(F.broadcast(df), "term").withColumn(
        "_c", corpus.select(F.struct("n", "avg_len")).scalar()
    )
    score = idf(F.col("_c.n"), F.col("df").cast("double")) * term_weight(
        F.col("tf").cast("double"), F.col("doc_len"), F.col("_c.avg_len")
    )
    return weighted.select("drawer_id", score.alias("part"))


def score_postings(
    post: DataFrame,
    stats: DataFrame,
    query: str,
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    """(drawer_id, bm25) from the stored index."""
    parts = contributions(post, stats, query, wing, room)
    return parts.groupBy("drawer_id").agg(F.sum("part").alias("bm25"))


def multi_query_scores(drawers: DataFrame, probes: list[dict], bonuses: list[Column]) -> DataFrame:
    """(probe, id, source_file, filed_at, bonus, bm25) for a literal list of queries in one pass over the text.

    The pass keeps of each row its length, how often the queries' terms occur, and the bonus of each
    query that it answers; statistics and scores are taken from that.
    """
    term_lists = [query_terms(p["query"]) for p in probes]
    vocabulary = sorted({w for ws in term_lists for w in ws})
    if not vocabulary:
        return drawers.limit(0).select(F.lit(0).alias("probe"), "id", "source_file", "filed_at", F.lit(0.0).alias("bonus"), F.lit(0.0).alias("bm25"))
    rows = computed(_with_hits(drawers, vocabulary), {"_text": F.lower("content"), "_room": F.lower("room")})
    asked = []
    for i, (probe, ws) in enumerate(zip(probes, term_lists)):
        if not ws:
            continue
        hit = F.arrays_overlap("_hits", F.array(*[F.lit(w) for w in ws]))
        for key in ("wing", "room"):
            if probe.get(key) is not None:
                hit = hit & (F.col(key) == probe[key])
        asked.append(F.when(hit, F.struct(F.lit(i).alias("probe"), bonuses[i].alias("bonus"))))
    kept = stored(
        rows.select(
            *(F.when(F.size("_hits") > 0, F.col(c)).alias(c) for c in ("id", "source_file", "filed_at")),
            "_len", F.when(F.size("_hits") > 0, F.array(*(occurrences("_hits", w) for w in vocabulary))).alias("_tf"),
            F.array(*asked).alias("_asked"),
        ),
        "hits",
    )
    df = F.array(*(F.count_if(F.get("_tf", i) > 0).cast("double") for i in range(len(vocabulary))))
    stats = kept.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("_len").alias("avg_len"), df.alias("df"))
    pairs = kept.select("*", F.inline("_asked")).where(F.col("probe").isNotNull()).withColumn("_s", stats.select(F.struct("n", "avg_len", "df")).scalar())
    at = {w: i for i, w in enumerate(vocabulary)}
    score = F.lit(None).cast("double")
    for i, ws in enumerate(term_lists):
        parts = [
            idf(F.col("_s.n"), F.col("_s.df")[at[w]]) * term_weight(F.col("_tf")[at[w]], F.col("_len"), F.col("_s.avg_len"))
            for w in ws
        ]
        if parts:
            score = F.when(F.col("probe") == i, reduce(lambda a, b: a + b, parts)).otherwise(score)
    return pairs.select("probe", "id", "source_file", "filed_at", "bonus", score.alias("bm25"))
