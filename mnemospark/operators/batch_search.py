"""Search of a whole table of questions over the stored block index.

The questions' terms are joined with the index, never the questions with the drawers.  For each
question, terms are ordered by the most they can add; those at the low end that together stay below
the score to reach cannot bring a drawer in, so common words are looked up only in slots that a
rarer term opened.  Two rounds: the n best by BM25 alone give each question's maximum and a base that
its n best reach; the second round brings all drawers that the bonuses, which need the text, can still lift
that high.  Text is read last, for those drawers.  Of every question only n rows leave a task for ranking.

Questions of one kind (``kinds``) differ in words only that few questions have.  For them the drawers are
scored once a kind, by the words that they share; a question's own words can lift a drawer only where they occur
in it, and those pairs are scored one by one.  Of all other drawers, n that are no worse in BM25 and in bonuses
stand before any that is not listed for the kind, whatever a question's greatest score is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import scoring
from mnemospark.functions import text as t
from mnemospark.functions.columns import computed, round_to
from mnemospark.operators import bm25
from mnemospark.operators.block_index import SCORE_DIGITS, BlockIndex
from mnemospark.session import stored


#: A word that at most so many different questions hold is their own.
OWN = 8


def _weight(tf: str, length: str) -> Column:
    return bm25.term_weight(F.col(tf).cast("double"), F.col(length).cast("double"), F.col("avg_len"))


def known_terms(index: BlockIndex, questions: DataFrame) -> DataFrame:
    """(qid, term, idf, avg_len) of the questions' terms that occur."""
    corpus = index.corpus().select(F.struct("n", "avg_len")).scalar()
    words = questions.select("qid", F.explode(F.array_distinct(t.tokens("query"))).alias("term"))
    return words.join(index.terms, "term").withColumn("_c", corpus).select(
        "qid", "term", bm25.idf(F.col("_c.n"), F.col("df").cast("double")).alias("idf"), F.col("_c.avg_len").alias("avg_len")
    )


def asked_terms(index: BlockIndex, questions: DataFrame, n: int) -> DataFrame:
    """(qid, term, idf, avg_len, most, nth) of the questions' terms that occur.

    most: the greatest part of the term in any drawer, at least; nth: a part that n drawers have.
    """
    found = known_terms(index, questions)
    heads = index.blocks.select("term", "max_tf", "min_len", "best_tf", "best_len").join(found.select("term").distinct(), "term", "left_semi")
    heads = heads.withColumn("avg_len", index.corpus().select("avg_len").scalar())
    parts = heads.select("term", _weight("max_tf", "min_len").alias("most"), _weight("best_tf", "best_len").alias("part"))
    most = parts.groupBy("term").agg(F.max("most").alias("most"))
    order = Window.partitionBy("term").orderBy(F.desc("part"))
    nth = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).where(F.col("rank") == n)
    known = most.join(nth.select("term", F.col("part").alias("nth")), "term", "left")
    rows = found.join(known, "term")
    return rows.select("qid", "term", "idf", "avg_len", (F.col("idf") * F.col("most")).alias("most"),
                       (F.col("idf") * F.coalesce("nth", F.lit(0.0))).alias("nth"))


def reaching(index: BlockIndex, terms: DataFrame, least: DataFrame) -> DataFrame:
    """(qid, doc, slot, bm25) of the drawers that can reach their question's ``least`` (qid, least)."""
    running = Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = terms.join(least, "qid").withColumn("_sum", F.sum("most").over(running))
    rows = rows.withColumn("opens", F.col("_sum") >= F.col("least") * (1 - 1e-9))
    rest = rows.groupBy("qid").agg(F.coalesce(F.max(F.when(~F.col("opens"), F.col("_sum"))), F.lit(0.0)).alias("rest"))
    heads = index.blocks.select("term", "slot", "max_tf", "min_len")
    bounds = rows.where("opens").join(heads, "term").groupBy("qid", "slot").agg(
        F.sum(F.col("idf") * _weight("max_tf", "min_len")).alias("bound"), F.first("least").alias("least")
    )
    slots = bounds.join(rest, "qid").where(F.col("bound") + F.col("rest") >= F.col("least") * (1 - 1e-9)).groupBy("slot").agg(F.collect_list("qid").alias("_open"))
    # Postings go to their slot once, however many questions want them, and are summed where they lie.
    wanted = terms.select("qid", "term", "idf", "avg_len").withColumnRenamed("qid", "_asks")
    blocks = index.blocks.join(wanted.select("term").distinct(), "term", "left_semi").select("term", "slot", "entries")
    placed = blocks.repartition("slot").join(slots.hint("shuffle_hash"), "slot").join(wanted, "term").where(F.array_contains("_open", F.col("_asks")))
    entries = placed.select(F.col("_asks").alias("qid"), "slot", "idf", "avg_len", F.explode("entries").alias("e")).select("qid", "slot", "idf", "avg_len", "e.*")
    if index.dead is not None:
        entries = entries.join(index.dead, "doc", "left_anti")
    scored = entries.groupBy("qid", "doc", "slot").agg(
        F.round(F.sum(F.col("idf") * _weight("tf", "len")), SCORE_DIGITS).alias("bm25")
    )
    return scored.join(least, "qid").where(F.col("bm25") >= F.col("least") * (1 - 1e-9)).drop("least")


def first_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows of each question, with their rank; tasks pass on n rows of a question at most."""
    place = Window.partitionBy("qid").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def nth_of(rows: DataFrame, n: int, score: str) -> DataFrame:
    """(qid, best, nth): the greatest score, and the n-th (0 where there are fewer)."""
    top = first_n(rows.select("qid", score), n, F.desc(score))
    return top.groupBy("qid").agg(
        F.max(score).alias("best"),
        F.coalesce(F.max(F.when(F.col("rank") == n, F.col(score))), F.lit(0.0)).alias("nth"),
    )


def best_by_terms(index: BlockIndex, questions: DataFrame, n: int) -> DataFrame:
    """(qid, rank, id, filed_at, bm25): the n best drawers of each question (qid, query) by BM25."""
    terms = stored(asked_terms(index, questions, n + index.n_dead), "search")
    least = terms.groupBy("qid").agg(F.max("nth").alias("least"))
    # Ties of the last place stay until time and id decide; tasks pass on no more.
    place = Window.partitionBy("qid").orderBy(F.desc("bm25"))
    tied = reaching(index, terms, least).withColumn("place", F.rank().over(place)).where(F.col("place") <= n)
    named = tied.join(index.docs.select("doc", "slot", "id", "filed_at"), ["doc", "slot"])
    return first_n(named, n, F.desc("bm25"), F.desc("filed_at"), F.col("id")).select("qid", "rank", "id", "filed_at", "bm25")


def search_all(index: BlockIndex, drawers: DataFrame, questions: DataFrame, n: int, as_of: Column) -> DataFrame:
    """(qid, rank, id, filed_at, bm25, coding_boost, preference_match, combined, query, content, source_file).

    The n best drawers of each question by BM25 share, boosts, preference bonus and recency, as a
    search for one question without a vector ranks them.
    """
    members = stored(kinds(questions), "kinds")
    if members.isEmpty():
        return search_each(index, drawers, questions, n, as_of)
    found = search_kinds(index, drawers, members, n, as_of)
    rest = stored(questions.select("qid", "query").join(members.select("qid"), "qid", "left_anti"), "questions")
    return found if rest.isEmpty() else found.unionByName(search_each(index, drawers, rest, n, as_of))


def kinds(questions: DataFrame) -> DataFrame:
    """The columns of ``scoring.asked`` with kind, shape, own and edge, of the questions that share a kind.

    shape: the question in runs of letters and digits and what lies between, null in place of its own words, which
    at most OWN different questions hold; kind: the least qid with the same shape, rules and intent; edge: the own
    word that the question ends with, else begins with.  A qid that comes several times shares no kind.
    """
    single = questions.groupBy("qid").agg(F.count(F.lit(1)).alias("_rows"), F.first("query").alias("query"))
    single = single.where("_rows = 1 AND qid IS NOT NULL AND query IS NOT NULL").drop("_rows")
    words = single.select("query").distinct().select("query", F.explode(F.array_distinct(t.tokens("query"))).alias("word"))
    few = words.groupBy("word").agg(F.count(F.lit(1)).alias("_asks")).where(F.col("_asks") <= OWN)
    own = words.join(few, "word").groupBy("query").agg(F.collect_list("word").alias("own"))
    pieces = F.regexp_extract_all("_low", F.lit(t.PIECE_PATTERN), F.lit(0))
    rows = scoring.asked(single).join(own, "query").withColumn("_pieces", pieces)
    rows = rows.withColumn("shape", F.expr("transform(_pieces, p -> IF(array_contains(own, p), NULL, p))"))
    rows = rows.withColumn(
        "edge",
        F.when(F.element_at("shape", -1).isNull(), F.element_at("_pieces", -1)).when(F.get("shape", F.lit(0)).isNull(), F.get("_pieces", F.lit(0))),
    ).drop("_pieces")
    alike = ["shape", "_rules", "_pairs", "_prefers"]
    shared = rows.groupBy(*alike).agg(F.min("qid").alias("kind"), F.count_distinct("query").alias("_texts")).where("_texts > 1").drop("_texts")
    return rows.join(shared, alike)


def _shared_part(members: DataFrame) -> DataFrame:
    """(kind, query, middle, last, bonus, ...): one row a kind, with the columns that ``scoring`` asks for.

    query: the text without own words; middle: what a drawer must hold, with an own word beside it, to hold a whole
    question without holding its own words as words (null: none can); last: whether that word comes after.
    """
    lengths = F.expr("transform(filter(own, w -> octet_length(w) > 3), w -> length(w))")
    rows = members.groupBy("kind").agg(
        *(F.first(c).alias(c) for c in ("shape", "_rules", "_pairs", "_prefers", "bonus")),
        F.collect_set(F.length("edge")).alias("_edges"), F.array_distinct(F.flatten(F.collect_set(lengths))).alias("_inner"),
    )
    rows = rows.withColumns({"last": F.element_at("shape", -1).isNull(), "_first": F.get("shape", F.lit(0)).isNull()})
    rows = rows.withColumn("_mid", F.expr("slice(shape, 1 + int(_first), greatest(0, size(shape) - int(_first) - int(last)))"))
    rows = rows.withColumns(
        {
            "query": F.expr("array_join(transform(shape, p -> coalesce(p, ' ')), '')"),
            "middle": F.expr("IF((last OR _first) AND NOT exists(_mid, p -> p IS NULL), array_join(_mid, ''), NULL)"),
            "_low": F.lit(None).cast("string"),
        }
    )
    return rows.withColumn("_words", F.filter(F.array_distinct(t.tokens("query")), lambda w: F.octet_length(w) > 3)).drop("shape", "_first", "_mid")


def _touched() -> Column:
    """Strings of the row's text that lift it for a question of the row's kind if they are its own words."""
    run = t.quoted(t.RUN)
    literal = r"concat('\\Q', replace(middle, '\\E', '\\E\\\\E\\Q'), '\\E')"
    beside = (
        f"IF(middle IS NULL OR NOT contains(_text, middle), array(), regexp_extract_all(_text, "
        f"IF(last, concat('(?<=', {literal}, ')', {run}), concat({run}, '(?=', {literal}, ')')), 0))"
    )
    edges = f"flatten(transform({beside}, r -> transform(filter(_edges, k -> k <= length(r)), k -> IF(last, left(r, k), right(r, k)))))"
    span = f"lower({t.sql_preference_span('content')})"
    within = "transform(sequence(1, length(r) - k + 1), i -> substring(r, i, k))"
    parts = f"flatten(transform(regexp_extract_all(s, {run}, 0), r -> flatten(transform(filter(_inner, k -> k <= length(r)), k -> {within}))))"
    spans = (
        f"IF(_prefers AND size(_inner) > 0 AND {t.sql_is_preference('content')}, "
        f"transform(array({span}), s -> IF(exists(_words, w -> contains(s, w)), array(), {parts}))[0], array())"
    )
    return F.expr(f"array_distinct(concat({edges}, {spans}))")


def _with_bonuses(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.withColumns(
        {
            "recent": scoring.recency(F.col("filed_at"), as_of),
            "coding_boost": F.expr(scoring.asked_boost("_text", "_room")),
            "preference_match": F.expr(scoring.asked_preference("content", "_room")),
            "version": F.xxhash64("content", "room", "source_file"),
        }
    )


_SCORED = ["doc", "id", "filed_at", "version", "bm25", "recent", "coding_boost", "preference_match"]


def _scored_pairs(index: BlockIndex, drawers: DataFrame, pairs: DataFrame, asks: DataFrame, as_of: Column) -> DataFrame:
    """The pairs (qid, doc) with their scores, all of a question's words and its whole text counted."""
    docs = index.docs.select("doc", "id", "filed_at", F.col("doc_len").alias("len"))
    rows = pairs.join(docs, "doc").join(drawers.select("id", "room", "content", "source_file"), "id").join(asks, "qid")
    rows = computed(rows, {"_text": F.lower("content"), "_room": F.lower("room"), "_held": t.tokens("content")})
    counted = F.expr("transform(_terms, x -> struct(x.idf AS idf, size(filter(_held, w -> w = x.term)) AS tf))")
    parts = F.transform(counted, lambda x: x.idf * bm25.term_weight(x.tf.cast("double"), F.col("len").cast("double"), F.col("avg_len")))
    score = F.round(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), SCORE_DIGITS)
    return _with_bonuses(rows.withColumn("bm25", score), as_of).select("qid", *_SCORED)


def _undominated(rows: DataFrame, n: int) -> DataFrame:
    """Of each kind the rows that fewer than n others match or beat in BM25 and in bonuses, and some more.

    Of rows with equal bonuses, of which there are as many as days and rules make, n go on.
    """
    rows = rows.withColumn("_plus", F.col("recent") + F.col("coding_boost") + F.col("preference_match"))
    order = (F.desc("bm25"), F.desc("filed_at"), F.col("id"))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("kind", "_plus").orderBy(*order))).where(F.col("_rank") <= n)
    before = Window.partitionBy("kind").orderBy(F.desc("bm25"), F.desc("_plus"), F.desc("filed_at"), "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_layer", F.lit(None).cast("int"))
    for layer in range(n):
        beaten = F.max(F.when(F.col("_layer").isNull(), F.col("_plus"))).over(before)
        rows = rows.withColumn("_most", beaten)
        rows = rows.withColumn("_layer", F.when(F.col("_layer").isNull() & (F.col("_most").isNull() | (F.col("_plus") > F.col("_most"))), layer).otherwise(F.col("_layer")))
    return rows.where(F.col("_layer").isNotNull()).select("kind", *_SCORED)


def search_kinds(index: BlockIndex, drawers: DataFrame, members: DataFrame, n: int, as_of: Column) -> DataFrame:
    """``search_all`` for the questions of ``kinds``."""
    share = F.lit(fv.BM25_WEIGHT)
    words = known_terms(index, members).groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("_terms"), F.first("avg_len").alias("avg_len"))
    asks = stored(members.drop("shape", "bonus", "own", "edge", "kind", "query").join(words, "qid"), "search")
    # Drawers with an own word, at most OWN questions a posting.
    own = members.select("qid", F.explode("own").alias("term"))
    pairs = index.blocks.select("term", "entries").join(own, "term").select("qid", F.explode("entries.doc").alias("doc")).distinct()
    lifted = stored(_scored_pairs(index, drawers, pairs, asks, as_of), "search")
    # All drawers by the shared words, once a kind.
    shared = stored(_shared_part(members), "search")
    terms = stored(asked_terms(index, shared.withColumnRenamed("kind", "qid"), n + index.n_dead), "search")
    first = reaching(index, terms, terms.groupBy("qid").agg(F.max("nth").alias("least")))
    top = stored(nth_of(first, n, "bm25").where("best > 0").withColumnRenamed("qid", "kind"), "search")
    best = members.select("qid", "kind").join(top.select("kind", "best"), "kind", "left").join(lifted.groupBy("qid").agg(F.max("bm25").alias("_own")), "qid", "left")
    best = stored(best.select("qid", "kind", F.greatest("best", "_own").alias("best")).where("best > 0"), "search")
    most = best.groupBy("kind").agg(F.max("best").alias("_most")).join(top, "kind").join(shared.select("kind", "bonus"), "kind")
    spare = F.col("nth") / F.col("_most") * share - F.col("bonus") - fv.RECENCY_WEIGHT - 1e-9
    least = most.select(F.col("kind").alias("qid"), (F.greatest(F.lit(0.0), spare) / share * F.col("_most")).alias("least"))
    narrow = reaching(index, terms, least).groupBy("doc", "slot").agg(F.collect_list(F.struct(F.col("qid").alias("kind"), "bm25")).alias("_kinds"))
    named = narrow.join(index.docs.select("doc", "slot", "id", "filed_at"), ["doc", "slot"]).join(drawers.select("id", "room", "content", "source_file"), "id")
    read = computed(named, {"_text": F.lower("content"), "_room": F.lower("room")}).select("*", F.inline("_kinds")).drop("_kinds")
    scored = _with_bonuses(read.join(shared.drop("query", "bonus"), "kind"), as_of).withColumn("touched", _touched())
    scored = stored(scored.select("kind", *_SCORED, "touched"), "search")
    # Drawers that hold a question or an own word of it without holding the word as a word.
    longer = F.filter("own", lambda w: F.octet_length(w) > 3)
    keys = members.select("qid", "kind", F.explode(F.array_distinct(F.concat(longer, F.array_compact(F.array("edge"))))).alias("key"))
    touched = scored.select("kind", "doc", F.explode("touched").alias("key")).join(keys, ["kind", "key"]).select("qid", "doc").distinct()
    touched = touched.join(lifted.select("qid", "doc"), ["qid", "doc"], "left_anti")
    lifted = lifted.unionByName(stored(_scored_pairs(index, drawers, touched, asks, as_of), "search"))
    # Every question ranks its kind's list; pairs scored on their own replace those of the list.
    total = share * F.col("bm25") / F.col("best") + F.col("recent") + F.col("coding_boost") + F.col("preference_match")
    listed = _undominated(scored.drop("touched"), n).groupBy("kind").agg(F.collect_list(F.struct(*_SCORED)).alias("_list"))
    total_of = f"{fv.BM25_WEIGHT}D * x.bm25 / best + x.recent + x.coding_boost + x.preference_match"
    placed = F.expr(
        f"slice(array_sort(transform(_list, x -> struct(-({total_of}) AS worse, x.filed_at IS NULL AS undated, "
        f"-unix_micros(x.filed_at) AS age, x.id AS id, x AS row))), 1, {n})"
    )
    plain = best.join(listed, "kind").select("qid", "best", F.explode(placed).alias("_p")).select("qid", "best", "_p.row.*")
    plain = plain.join(lifted.select("qid", "doc").distinct(), ["qid", "doc"], "left_anti")
    every = plain.unionByName(lifted.join(best.select("qid", "best"), "qid")).withColumn("combined", total)
    found = first_n(every, n, F.desc("combined"), F.desc("filed_at"), F.col("id"))
    texts = drawers.select("id", F.xxhash64("content", "room", "source_file").alias("version"), "content", "source_file")
    texts = texts.groupBy("id", "version").agg(F.first("content").alias("content"), F.first("source_file").alias("source_file"))
    named = found.join(members.select("qid", "query"), "qid").join(texts, ["id", "version"], "left")
    return named.select("qid", "rank", "id", "filed_at", "bm25", "coding_boost", "preference_match", "combined", "query", "content", "source_file")


def search_each(index: BlockIndex, drawers: DataFrame, questions: DataFrame, n: int, as_of: Column) -> DataFrame:
    """``search_all`` for questions that have nothing in common: pairs grow with questions times drawers."""
    terms = stored(asked_terms(index, questions, n + index.n_dead), "search")
    asked = scoring.asked(questions)
    first = reaching(index, terms, terms.groupBy("qid").agg(F.max("nth").alias("least")))
    best = stored(nth_of(first, n, "bm25").where("best > 0"), "search")
    share = F.lit(fv.BM25_WEIGHT)
    spare = F.col("nth") / F.col("best") * share - F.col("bonus") - fv.RECENCY_WEIGHT - 1e-9
    least = best.join(asked.select("qid", "bonus"), "qid").select("qid", (F.greatest(F.lit(0.0), spare) / share * F.col("best")).alias("least"))
    narrow = reaching(index, terms, least).join(best.select("qid", "best"), "qid")
    dated = narrow.join(index.docs.select("doc", "slot", "id", "filed_at"), ["doc", "slot"]).select(
        "qid", "id", "filed_at", "bm25",
        (share * F.col("bm25") / F.col("best") + scoring.recency(F.col("filed_at"), as_of)).alias("base"),
    )
    dated = stored(dated, "search")
    floor = nth_of(dated, n, "base").select("qid", "nth").join(asked, "qid")
    left = dated.join(floor, "qid").where(F.col("base") + F.col("bonus") + 1e-9 >= F.col("nth")).drop("nth", "bonus")
    texts = drawers.select("id", "room", "content", "source_file")
    read = computed(left.join(texts, "id"), {"_text": F.lower("content"), "_room": F.lower("room")})
    scored = read.withColumns(
        {
            "coding_boost": F.expr(scoring.asked_boost("_text", "_room")),
            "preference_match": F.expr(scoring.asked_preference("content", "_room")),
        }
    ).withColumn("combined", F.col("base") + F.col("coding_boost") + F.col("preference_match"))
    top = first_n(scored, n, F.desc("combined"), F.desc("filed_at"), F.col("id"))
    return top.select("qid", "rank", "id", "filed_at", "bm25", "coding_boost", "preference_match", "combined", "query", "content", "source_file")


def recall(found: DataFrame, questions: DataFrame, hit: Column) -> DataFrame:
    """One row per question: the rank of its first hit among the drawers found, and the best drawer."""
    marked = found.groupBy("qid").agg(
        F.min(F.when(hit, F.col("rank"))).alias("rank"), F.min_by("id", "rank").alias("top_id"),
        F.min_by("combined", "rank").alias("top_similarity"),
    )
    return questions.select("qid").join(marked, "qid", "left").select(
        "qid", F.col("rank").isNotNull().alias("passed"), "rank", "top_id", round_to(F.col("top_similarity"), 3).alias("top_similarity")
    )
