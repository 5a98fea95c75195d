"""Cost-balanced packing of documents into token sequences of one capacity.

A document's ids are cut at multiples of the capacity; the rest is one piece. Pieces enter, in descending order, the
sequence of the lowest estimated cost (linear in tokens plus quadratic for attention within the piece) that still has
room. Groups of pieces are packed apart, each with as many sequences as its tokens fill, so no task holds more than
``group_pieces`` and what stays open is a sequence or two a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import stored, text_slices
from grovewise.llm.tokens import word_tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
GROUP_IDS = 1 << 32  # sequence ids of a group


def _cut(vocabulary: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, cuts = tokens.ids([t or "" for t in part.column("text").to_pylist()])
                out: list[tuple] = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(closing)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        out.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def assign(length: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces in descending order of length."""
    n = max(1, -(-int(length.sum()) // capacity))
    load, cost = np.zeros(2 * n + len(length) // 64 + 16, dtype=np.int64), np.zeros(2 * n + len(length) // 64 + 16)
    price = linear * length + quadratic * np.square(length.astype(np.float64))
    sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    for k, size in enumerate(length):
        open_ = np.where(load[:n] + size <= capacity, cost[:n], np.inf)
        s = int(open_.argmin())
        if open_[s] == np.inf:
            s, n = n, n + 1
            if n > len(load):
                load, cost = np.append(load, np.zeros(n, np.int64)), np.append(cost, np.zeros(n))
        sequence[k], offset[k] = s, load[s]
        load[s] += size
        cost[s] += price[k]
    return sequence, offset


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, closing: int = 2, linear: float = 1.0, quadratic: float = 1 / 6144, group_pieces: int = 32768,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    Every document ends with id ``closing``, so null and empty texts are one piece of one id. ``ids_crc32`` is over the
    piece's ids as little-endian 32-bit numbers. ``linear`` and ``quadratic`` are the cost of a token and of a pair of
    tokens in one piece (by default attention weighs as much as the rest at 6,144 tokens). Repeated rows are packed
    each. An empty table gives no rows; other columns are ignored.
    """
    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_cut(vocabulary, capacity, closing), PIECES)
    # Numbered, so that repeated rows are dealt to different groups.
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    groups = max(1, round(pieces.count() / group_pieces))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sequence, pdf["offset"] = assign(pdf["length"].to_numpy(), capacity, linear, quadratic)
        pdf["sequence_id"] = pdf.pop("group") * GROUP_IDS + sequence
        return pdf[[c.split()[0] for c in PACKED.split(", ")]]

    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return grouped.groupBy("group").applyInPandas(pack, PACKED)
