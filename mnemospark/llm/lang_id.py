"""Language identification by rank-order profiles.

A profile is the RANKS most frequent n-grams of letters (one to three, with word ends as spaces),
in order.  A document's distance to a language is the sum, over its own ranked n-grams, of how far
each is out of place in the language's profile; one that is missing there counts RANKS.  The
language with the smallest distance is predicted.

Language profiles count the n-grams of all training documents: each task keeps sums and Spark adds
them up.  Defined results: texts that are null or have no letter are ``und`` with score 0, as are
all texts if nothing could be learned; ties of distance go to the smaller language name, ties of
frequency to the smaller n-gram; the score is the runner-up's share of both distances (0.5: a tie,
1: no other language, or a perfect fit).  Languages that are null are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import column, is_held_out, pieces

RANKS = 400
#: Characters counted at once, and different n-grams that a task holds before it hands its sums on.
SLICE = 1 << 20
HELD = 1 << 20
BITS = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(text: str) -> np.ndarray:
    """The n-grams of a text, as numbers."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.where(is_letter, points, 32).astype(np.int64)
    keep = is_letter | np.r_[True, is_letter[:-1]]
    points = np.r_[32, points[keep], 32]
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    two = (points[:-1] << BITS) | points[1:]
    three = (two[:-1] << BITS) | points[2:]
    return np.concatenate([points[points != 32], two, three])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, how often) of a whole text, n-grams ascending."""
    found = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(text or ""), SLICE):
        one = np.unique(codes(text[i : i + SLICE]), return_counts=True)
        found = added(found, one) if len(found[0]) else one
    return found


def added(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sums of two counts."""
    names, place = np.unique(np.r_[a[0], b[0]], return_inverse=True)
    return names, np.bincount(place, np.r_[a[1], b[1]]).astype(np.int64)


def ranked(names: np.ndarray, times: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams in order."""
    if len(names) > 4 * ranks:
        least = np.partition(times, len(times) - ranks)[len(times) - ranks]
        names, times = names[times >= least], times[times >= least]
    return names[np.lexsort((names, -times))][:ranks]


def training_counts(df: DataFrame) -> DataFrame:
    """(lang, code, c): summed n-grams of each task's documents by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}

        def handed_on() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, v in held.items() for _ in range(len(v[0]))], pa.string()),
                    pa.array(np.concatenate([v[0] for v in held.values()])), pa.array(np.concatenate([v[1] for v in held.values()])),
                ],
                ["lang", "code", "c"],
            )
            held.clear()
            return rows

        for batch in pieces(batches):
            found: dict[str, list] = {}
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist()):
                for i in range(0, len(text or ""), SLICE):
                    found.setdefault(lang, []).append(codes(text[i : i + SLICE]))
            for lang, parts in found.items():
                one = np.unique(np.concatenate(parts), return_counts=True)
                held[lang] = added(held[lang], one) if lang in held else one
            if sum(len(v[0]) for v in held.values()) > HELD:
                yield handed_on()
        if held:
            yield handed_on()

    return df.select("text", "lang").mapInArrow(run, "lang string, code long, c long")


def profiles(df: DataFrame, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams, from all rows of df (text, lang)."""
    total = training_counts(df.where("lang is not null and text is not null")).groupBy("lang", "code").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c"), "code")
    best = total.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ranks)
    rows = best.collect()  # languages x ranks rows
    return {
        lang: np.array([r["code"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["r"])], np.int64)
        for lang in sorted({r["lang"] for r in rows})
    }


def distances(own: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], ranks: int = RANKS) -> np.ndarray:
    """The out-of-place distance of a document's ranked n-grams to each language."""
    mine = np.arange(len(own))
    result = []
    for names, places in known:
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        result.append(np.where(names[at] == own, np.minimum(np.abs(places[at] - mine), ranks), ranks).sum())
    return np.array(result)


def predict(df: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of df (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(learned)  # languages x RANKS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(shared.value)
        known = []
        for lang in langs:
            order = np.argsort(shared.value[lang])
            known.append((shared.value[lang][order], order))
        for batch in pieces(batches):
            names, scores = [], []
            for text in column(batch, "text").to_pylist():
                own = ranked(*counts(text))
                if not len(own) or not langs:
                    names.append("und"), scores.append(0.0)
                    continue
                far = distances(own, known)
                best = int(far.argmin())
                rest = np.delete(far, best)
                both = float(far[best] + (rest.min() if len(rest) else 0))
                names.append(langs[best])
                scores.append(float(rest.min() / both) if len(rest) and both else 1.0 if not len(rest) else 0.5)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(df: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of df (doc_id, text, lang); held-out rows are not learned from."""
    learned = profiles(df.where(~is_held_out(F.col("doc_id"))))
    return predict(df, learned).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
