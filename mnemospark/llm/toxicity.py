"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (with ends marked) and of the whole
word; a span of SPAN words is the average of its words; a linear softmax turns the span into two
class probabilities.  Vectors and softmax are trained jointly in numpy.  Labels hold for documents
while insults are single words in long texts, so training takes the span of a toxic document that
is most toxic so far, against the spans of clean documents.  A document's score is that of its
worst span, calibrated on labelled documents that the vectors have not seen.

Because the softmax is linear, a trained model is one number for each n-gram bucket, and scoring a
word is an average of these; misspelt words share n-grams with known ones.

Training sample (bounded, see fit): the first rows of each label in hash order.  Defined results:
null, empty and wordless texts score as a span of no words; repeated rows score alike; rows with a
null id are never held out, so they would count for training if labelled; without labels of both
classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import CACHE_WORDS, MIX, column, in_arrow, is_held_out, mix64, pieces

BUCKETS = 1 << 16
SIZES = (3, 4, 5, 6)
DIMENSIONS = 8
SPAN = 6
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # toxic minus clean, for each bucket
    bias: float
    slope: float
    shift: float


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): the buckets of all n-grams, word by word, and how many each word has."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[owner]
    place = np.arange(len(points))
    buckets, owners = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int64)], [np.arange(len(words))]
    for n in SIZES:
        if len(points) < n:
            continue
        code = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(MIX[0]) + points[i : len(points) - n + 1 + i]
        inside = place[: len(code)] + n <= ends[: len(code)]
        buckets.append((mix64(code[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(code)][inside])
    every, whose = np.concatenate(buckets), np.concatenate(owners)
    return every[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))


def span_means(values: np.ndarray) -> np.ndarray:
    """The averages of all spans of SPAN neighbours, or of all values if they are fewer."""
    if len(values) <= SPAN:
        return np.array([values.mean() if len(values) else 0.0])
    sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return (sums[SPAN:] - sums[:-SPAN]) / SPAN


class Words:
    """The values of words under a model; kept for a bounded number of words."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def values(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for words in texts for w in words if w not in self.known})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            buckets, counts = grams(part)
            sums = np.add.reduceat(self.weights[buckets], np.r_[0, np.cumsum(counts)[:-1]])
            self.known.update(zip(part, (sums / counts).tolist()))
        known = self.known
        return [np.array([known[w] for w in words]) for words in texts]


def worst(model_words: Words, bias: float, texts: list[list[str]]) -> np.ndarray:
    return np.array([span_means(v).max() + bias for v in model_words.values(texts)])


def first_spans(texts: list[list[str]], labels: np.ndarray) -> list[list[str]]:
    """For each document, the span whose words are most peculiar to toxic documents."""
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    # Words are compared by their beginnings as well, so that inflected forms count together.
    keys = [{k for w in words for k in (w, w[:5])} for words in texts]
    for found, label in zip(keys, labels):
        for k in found:
            (toxic if label else clean)[k] = (toxic if label else clean).get(k, 0) + 1
    p, n = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))

    def peculiar(k: str) -> float:
        return max(0.0, np.log((toxic.get(k, 0) + 0.02) / p) - np.log((clean.get(k, 0) + 0.5) / n)) * (toxic.get(k, 0) > 1)

    odds: dict[str, float] = {}
    for words in texts:
        for w in words:
            if w not in odds:
                odds[w] = peculiar(w) + peculiar(w[:5])
    spans = []
    for words in texts:
        at = int(span_means(np.array([odds[w] for w in words])).argmax()) if words else 0
        spans.append(words[at : at + SPAN])
    return spans


def train(texts: list[list[str]], labels: np.ndarray, seed: int = 7, rounds: int = 4, steps: int = 250, size: int = 192) -> tuple[np.ndarray, float]:
    """(bucket weights, bias) of the jointly trained vectors and softmax."""
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = random.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-6), 1e-6, 1e-6
    toxic_ids, clean_ids = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    chosen = first_spans(texts, labels)
    hardest = [chosen[i] for i in clean_ids]
    for turn in range(rounds):
        for _ in range(steps):
            half = size // 2
            spans = [chosen[i] for i in random.choice(toxic_ids, half)]
            for i in random.choice(len(clean_ids), half):
                words = texts[clean_ids[i]]
                at = int(random.integers(0, max(1, len(words) - SPAN + 1)))
                spans.append(hardest[i] if random.random() < 0.3 else words[at : at + SPAN])
            target = np.r_[np.ones(half, int), np.zeros(size - half, int)]
            keep = [i for i, s in enumerate(spans) if s]
            spans, target = [spans[i] for i in keep], target[keep]
            flat = [w for s in spans for w in s]
            buckets, counts = grams(flat)
            per_word = np.repeat(1.0 / counts, counts)
            n_words = np.array([len(s) for s in spans])
            span_of = np.repeat(np.repeat(np.arange(len(spans)), n_words), counts)
            share = per_word / np.repeat(np.repeat(n_words, n_words), counts)
            mean = np.stack([np.bincount(span_of, share * vectors[buckets, d], len(spans)) for d in range(DIMENSIONS)], 1)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(spans)), target] -= 1
            error /= len(spans)
            to_mean = error @ out.T
            to_out, to_bias = mean.T @ error, error.sum(0)
            ids, place = np.unique(buckets, return_inverse=True)
            change = np.stack([np.bincount(place, share * to_mean[span_of, d], len(ids)) for d in range(DIMENSIONS)], 1)
            seen_v[ids] += (change**2).mean(1)
            seen_o += (to_out**2).mean()
            seen_b += (to_bias**2).mean()
            vectors[ids] -= 0.3 * change / np.sqrt(seen_v[ids])[:, None]
            out -= 0.1 * to_out / np.sqrt(seen_o)
            bias -= 0.05 * to_bias / np.sqrt(seen_b)
        weights, offset = vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])
        if turn < rounds - 1:
            values = Words(weights).values(texts)
            for i, v in enumerate(values):
                at = int(span_means(v).argmax()) if len(v) else 0
                chosen[i] = texts[i][at : at + SPAN]
            hardest = [chosen[i] for i in clean_ids]
    return weights, offset


def calibrated(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores; classes weigh alike, the slope is bounded."""
    centre, scale = float(np.median(scores)), float(scores.std() + 1e-9)
    x = (scores - centre) / scale
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    a, b = 1.0, 0.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        e = (p - labels) * weight
        a -= 2.0 * ((e * x).sum() + 0.002 * a)
        b -= 2.0 * e.sum()
    a = max(a, 0.05)
    return a / scale, b - a * centre / scale


def sample(documents: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int, longest: int) -> list:
    """At most so many labelled documents of each class, texts up to longest characters, none held out."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    ids = known.where("toxic = 1").orderBy("place", "doc_id").limit(toxic_rows).union(
        known.where("toxic = 0").orderBy("place", "doc_id").limit(clean_rows)
    )
    texts = documents.select(F.col("doc_id"), "text").where(F.length("text") <= longest)
    # toxic_rows + clean_rows ids at most: a bounded broadcast, so that the texts are not shuffled.
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).collect()


def fit(
    documents: DataFrame, labels: DataFrame, toxic_rows: int = 1000, clean_rows: int = 2500, longest: int = 40_000
) -> Model | None:
    """The model from a bounded sample: at most toxic_rows and clean_rows labelled documents of at most longest characters."""
    found = sorted(sample(documents, labels, toxic_rows, clean_rows, longest), key=lambda r: r["doc_id"])
    marks = np.array([r["toxic"] for r in found], int)
    if len(set(marks.tolist())) < 2:
        return None
    texts = [words_of(r["text"]) for r in found]
    later = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in found])
    if len(set(marks[later].tolist())) < 2 or len(set(marks[~later].tolist())) < 2:
        later = np.zeros(len(found), bool)
    weights, bias = train([t for t, x in zip(texts, later) if not x], marks[~later])
    use = later if later.any() else ~later
    slope, shift = calibrated(worst(Words(weights), bias, [t for t, x in zip(texts, use) if x]), marks[use])
    return Model(weights.astype(np.float32), bias, slope, shift)


def score(df: DataFrame, model: Model | None, as_name: str = "score") -> DataFrame:
    """(doc_id, score) of each row of df (doc_id, text, ...)."""
    schema = f"doc_id long, {as_name} double"
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return df.select("doc_id", F.lit(0.0).alias(as_name))
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model.weights.astype(np.float64))
        for batch in pieces(batches):
            raw = worst(words, model.bias, [words_of(t) for t in column(batch, "text").to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], ["doc_id", as_name])

    return in_arrow(df, run, schema)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(documents, fit(documents, labels)).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the model does not reject, with their own columns."""
    model = fit(documents, labels)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model.weights.astype(np.float64))
        for piece in pieces(batches):
            raw = worst(words, model.bias, [words_of(t) for t in piece.column(at).to_pylist()])
            yield piece.filter(pa.array(model.slope * raw + model.shift < 0))

    return in_arrow(documents, run, documents.schema)
