"""What Python workers hold: batches of bounded size, whatever the rows' lengths."""

import pyarrow as pa
from pyspark.sql import functions as F

from mnemospark.llm.common import BATCH_BYTES, in_arrow


def test_batches_of_long_texts_are_bounded(spark):
    rows = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("some words "), 600).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "b"])

    found = in_arrow(rows, run, "n long, b long").collect()
    assert sum(r["n"] for r in found) == 3000
    assert max(r["b"] for r in found) < 2 * BATCH_BYTES  # all 20 MB came at once
