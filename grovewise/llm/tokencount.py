"""Token counts of whole documents by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.tokens import byte_tokens, count_spliced


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = 1 << 16, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; ``vocabulary`` is a byte-level BPE file's path
    on every worker.

    Null texts count as empty: 0 bytes, 0 tokens. Texts of more than ``chunk`` bytes are encoded in overlapping chunks.
    Repeated rows count each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(vocabulary)
        for batch in batches:
            text = batch.column("text").fill_null("")
            n = pa.array([count_spliced(tokens, t.as_py(), chunk, overlap) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
