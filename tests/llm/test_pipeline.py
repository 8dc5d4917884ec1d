"""The corpus pipeline whole, on small, odd and empty tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
COPY = " ".join(f"copied{i % 40} word{i}" for i in range(80))


def tables(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect_and_ids_come_out(spark, tmp_path):
    rows = [(1, COPY), (2, COPY), (3, COPY + " end"), (4, f"before {PASSAGE} after"), (5, "write to jane.doe@example.org please"), (6, None), (7, ""), (8, "nul \x00 byte")]
    sf = tables(spark, tmp_path, rows)
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in found} == {1, 5, 6, 7, 8}
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in found)
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"] for r in found)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == COLUMNS, name
    masked = corpus_pipeline.mask_pii(spark, docs, sf).where("doc_id = 5").first()["text"]
    assert "jane.doe" not in masked


@pytest.mark.parametrize("rows", [[], [(None, "a b c"), (None, None), (3, "x"), (3, "x"), (3, None)]])
def test_empty_tables_and_odd_rows(spark, tmp_path, rows):
    found = corpus_pipeline.run(spark, tables(spark, tmp_path, rows))
    assert set(found.columns) >= {"doc_id", "sample", "ids", "round_trip"}
    got = found.where("sample = 0").agg(F.count(F.lit(1)), F.count(F.when(~F.col("round_trip"), 1))).first()
    assert tuple(got) == (len(rows), 0)
