"""What several operators share: reading, shared tables, word hashes, linked components."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import new_path

#: Odd multipliers of the 64-bit hashes.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of text that a task takes apart at once: word lists take several times as much memory.
BATCH_BYTES = 4 << 20
#: Spark's setting by which a finished query removes its shuffle files.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes that go to a Python worker at once; without it, a batch holds 10,000 rows of any length.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words whose derived values a task keeps; beyond, the store is emptied.
CACHE_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame, *parts: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and readable after any executor is lost.

    parts: columns whose values each get a folder of their own.  Shuffle files of the computation go as soon
    as the table is there: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, "llm")
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.partitionBy(*parts).parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[1])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name; the first one if the name is repeated."""
    return batch.column(batch.schema.names.index(name))


def pieces(batches: Iterator[pa.RecordBatch], by: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece stay near BATCH_BYTES (one row may be larger)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in column(batch, by).cast(pa.large_binary())])
        group = sizes // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded size; a task's memory goes back to the system at its end.

    Python workers stay for later tasks and stages, and what one of them has kept adds to all that follow.
    """
    df.sparkSession.conf.set(ARROW_BYTES, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return df.mapInArrow(lean, schema)


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 5, is 0; a missing id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reached by links, for every node that has one.

    Alternates two star operations until nothing changes: neighbours that are larger than a node
    are tied to its smallest neighbour, then smaller ones are tied to each other's smallest.  A
    node's neighbours are only aggregated, never gathered, and each round is a written table.
    """

    def tied(pairs: DataFrame, larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = pairs.join(low, "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select("u", "v", "m")

    pairs = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    state = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(tied(both, True).where("u <> v").distinct())
        small = tied(large, False)
        pairs = written(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("linked components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
