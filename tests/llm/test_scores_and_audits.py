"""Hard negatives, context-tree scores and the filter audit against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import context_trees, filter_audit, hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


# hard negatives


@pytest.mark.parametrize("low, high, dims", [(-300, 300, 64), (0, 1, 5), (-(10**7), 10**7, 33), (10**12, 10**12 + 3, 7), (-(2**40), 2**40, 9), (5, 6, 4)])
def test_packed_products_are_exact(low, high, dims):
    rng = np.random.default_rng(dims)
    a, r = rng.integers(low, high, (7, dims)), rng.integers(low, high, (101, dims))
    want = np.clip(a.astype(object) @ r.astype(object).T, *hard_negatives.LONG)
    assert (hard_negatives.packed_scores(a, r).astype(object) == want).all()


def plain_negatives(rows):
    """rows of (vec_id, embedding, label) -> the sorted result."""
    kept = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in e], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, q, label) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), j, m, other) for m, (j, p, other) in enumerate(kept) if m != n)
        for s, j, _, _ in [x for x in scored if x[3] == label][:5]:
            fit = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit[:5], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("clash")).withColumn("q", F.lit(1)).withColumn("l", F.lit(2))
    return sorted(tuple(r) for r in hard_negatives.mined(df).collect())


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rng = random.Random(5)
    hot = [rng.gauss(0, 0.3) for _ in range(6)]
    rows = []
    for i in range(900):
        vector = hot if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(6)]  # a third of all rows are one vector
        rows.append((i, vector, rng.choice([1, 1, 1, 2, 3])))
    assert mined(spark, rows) == plain_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.5, 0.5], 1), (101, [0.5, 0.5], 1), (101, [0.5, 0.5], 1), (102, [0.4], 2), (103, [], 2), (104, None, 2), (None, [0.5, 0.5], 2),
            (105, [0.5, None], 2), (106, [nan, 0.1], 2), (107, [inf, 0.1], 2), (108, [0.5, 0.5], None), (109, [0.5, 0.5], 2), (110, [0.45, 0.5], 3),
            (200, [0.0, 0.0], 4), (300, [], 5), (301, [1e30, -1e30], 5), (302, [0.5, 0.5, 0.25], 6)]
    got = mined(spark, rows)
    assert [r for r in got if r[0] != 300] == [r for r in plain_negatives([r for r in rows if r[0] != 301]) if r[0] != 300]
    assert all(r[4] == 0 for r in got if r[0] == 300)
    assert mined(spark, []) == []


# context-tree scores


def plain_tree_scores(rows, depth):
    """Probabilities of whole training sequences with and without the next decision, by the definition."""
    from fractions import Fraction

    mark = b"\xff"
    texts = [((t or "").encode().lower(), i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    seen = defaultdict(lambda: [0, 0])  # (decision, context newest first) -> zeros, ones

    def steps(text):
        held = mark * depth + text + mark
        for at in range(depth, len(held)):
            context = held[at - depth : at][::-1]
            for b in range(8):
                yield ((1 << b) | (held[at] >> (8 - b))), context, (held[at] >> (7 - b)) & 1

    for text, out in texts:
        if not out:
            for m, context, bit in steps(text):
                for d in range(depth + 1):
                    seen[m, context[:d]][bit] += 1
    children = defaultdict(set)
    for m, context in list(seen):
        if context:
            children[m, context[:-1]].add(context)

    def kt(zeros, ones):
        p = Fraction(1)
        for k in range(zeros):
            p *= Fraction(2 * k + 1, 2)
        for k in range(ones):
            p *= Fraction(2 * k + 1, 2)
        return p / math.factorial(zeros + ones)

    held = {}

    def weighted(m, context):
        if (m, context) not in held:
            zeros, ones = seen.get((m, context), (0, 0))
            p = kt(zeros, ones)
            if len(context) < depth:
                below = Fraction(1)
                for child in children.get((m, context), ()):
                    below *= weighted(m, child)
                p = (p + below) / 2
            held[m, context] = p
        return held[m, context]

    def with_next(m, context, bit, d):
        """Pw of the node at depth d of the path, if the decision came once more."""
        zeros, ones = seen.get((m, context[:d]), (0, 0))
        p = kt(zeros + (bit == 0), ones + (bit == 1))
        if d < depth:
            below = with_next(m, context, bit, d + 1)
            for child in children.get((m, context[:d]), ()):
                if child != context[: d + 1]:
                    below *= weighted(m, child)
            p = (p + below) / 2
        return p

    return [sum(math.log10(with_next(m, c, bit, 0) / weighted(m, b"")) for m, c, bit in steps(text)) for text, _ in texts]


@pytest.mark.parametrize("depth", [2, 4, 5])
def test_context_tree_scores_equal_the_definition(spark, depth):
    rows = [(i, t) for i, t in enumerate(["abab ab", "ABAB ba", "abc", None, "", "żółw", "ab" * 10, "zzz", "a\x00b", "abab ab"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_trees.scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, depth, 20).collect()}
    want = plain_tree_scores(rows, depth)
    for (i, text), score in zip(rows, want):
        assert got[i]["score"] == pytest.approx(score, rel=1e-9), (i, text)


def test_base_scores_and_counts(spark):
    rng = random.Random(2)
    vocabulary = ["Word%d" % rng.randrange(40) for _ in range(60)] + ["x" * 200, "ÄB"]
    rows = [(i, "\t ".join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \r\n"), (None, "word1 other"), (7, "word1"), (7, "word1")]
    docs = [(i, (t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    counts = Counter(w for _, words, out in docs if not out for w in words)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w, out in docs)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("clash")).withColumn("trains", F.lit(1))
    got = context_trees.scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, group_bytes=500).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    whole = {r["doc_id"]: r["n_coded"] for r in got}
    assert all(whole[i] == len((t or "").encode()) + 1 for i, t in rows if i != 7)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["ab", "x" * 90, "Ünï", "\t", "c"], k=200)).encode() for _ in range(5)] + [b"", None, b"y" * 300]
    table = pa.table([pa.array([0] * 8, pa.int32()), pa.array(texts), pa.array([True] * 7 + [False])], ["g", "text", "trains"])

    def counted():
        t = context_trees.counts_of(table, 5).to_pylist()
        return sorted((r["kind"], r["key"], r["n"]) for r in t)

    whole = counted()
    monkeypatch.setattr(context_trees, "PIECE", 64)
    assert counted() == whole


def test_scores_tell_the_corpus_from_noise(spark):
    rng = random.Random(3)
    words = ["river", "stone", "meadow", "lantern", "harvest"]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)] + [(99, "qzx vkj " * 30)]
    held = F.col("doc_id").isin(5, 99)
    one = {r["doc_id"]: r for r in context_trees.scores(spark.createDataFrame(rows, "doc_id long, text string"), held).collect()}
    assert one[5]["bits_per_byte"] < 1 < 3 < one[99]["bits_per_byte"]


def test_scores_of_empty_tables_and_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert context_trees.document_scores(empty).collect() == []
    row = context_trees.scores(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(True)).first()
    assert row["score"] == pytest.approx(3 * 8 * math.log10(0.5)) and (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0)


# filter audit


def by_sql(rows, labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id bigint, text varchar, lang varchar)")
    con.execute("CREATE TABLE labels (doc_id bigint, quality int, toxic int)")
    for table, values in (("documents", rows), ("labels", labels)):
        for value in values:
            con.execute(f"INSERT INTO {table} VALUES (?, ?, ?)", list(value))
    return sorted(con.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({filter_audit.SQL})").fetchall())


def audited(spark, rows, labels):
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("failed", F.lit(2))
    found = filter_audit.audit(df, spark.createDataFrame(labels, LABELS).withColumn("row", F.lit(0)))
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def plain_audit(rows, labels):
    """One filter after another, for every order."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    marked = []
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": copy}
        marked.append((i, lang or "", {k for k, v in fails.items() if v}))
    out, shapley = [], Counter()
    for part in {p for _, p, _ in marked}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, p, f in marked if p == part]
            everything = list(left)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in everything)
                shapley[part, letter] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in everything),
                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_equals_filters_one_after_another(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma", "DELTA", "#tag", "omega%d" % rng.randrange(300)], k=rng.choice([3, 150, 220]))) for _ in range(30)]
    long = " ".join(f"w{k}" for k in range(260))
    rows = [(i, rng.choice([*texts, long, long + " A|B", None, "", "\t", "ÄÖ É"]), rng.choice(["en", "de", None, ""])) for i in range(80)]
    rows += [(None, long, "en"), (None, long, "en"), (3, long, "en"), (3, long, "en"), (200, long, "fr")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (999, 1, 1)]
    want = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == want
    assert by_sql(rows, labels) == want


def test_filter_audit_of_an_empty_table(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    found = audited(spark, [(1, " ".join(f"w{k}" for k in range(260)), None)], [])
    assert len(found) == 600 and all(r[3] == 1 and sum(r[4:]) == 0 for r in found)
