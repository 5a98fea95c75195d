"""Cells: the rows of a bucket that one task compares pair by pair, however large the bucket is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS_AT_ONCE = 1 << 15


def dealt_to_cells(
    rows: DataFrame, sizes: DataFrame, key: str, id_: str, cell_rows: int, cells_rows: int = 65536, carry: Callable[[DataFrame], DataFrame] | None = None,
    cell_bytes: int | None = None,
) -> DataFrame:
    """``rows`` in cells (key, low, high), sorted within partitions; ``sizes``: (key, rows) of the buckets to compare.

    A bucket of up to ``cell_rows`` rows is one cell. A larger one is cut into parts by a hash of ``id_``, and each two
    parts meet in a cell of their own, so no task gathers a large bucket. ``carry`` adds what only rows in cells need.
    With ``cell_bytes``, parts are also so many that their share of the buckets' ``bytes`` in ``sizes`` stays below it.
    """
    filled = F.col("rows") / cell_rows if cell_bytes is None else F.greatest(F.col("rows") / cell_rows, F.col("bytes") / cell_bytes)
    parts = sizes.select(key, F.ceil(filled).cast("int").alias("parts"))
    cells = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(id_), F.col("parts")).cast("int"))
    cells = cells.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cells = cells.withColumn("low", F.least("part", "other_part")).withColumn("high", F.greatest("part", "other_part"))
    cells = carry(cells) if carry else cells
    n = max(1, -(-sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] // cells_rows))
    return cells.repartition(n, key, "low", "high").sortWithinPartitions(key, "low", "high")


def whole_cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole cells of the sorted batches; rows of an unfinished cell wait for the next batch."""
    held: list[pa.RecordBatch] = []

    def at(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in (key, "low", "high"))

    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k, v in zip((key, "low", "high"), at(batch, batch.num_rows - 1), strict=True):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and at(held[-1], 0) != at(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def cell_runs(cells: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First row and size of each cell; per row, its part and whether its cell compares two different parts."""
    low, high, k = (cells.column(c).to_numpy() for c in ("low", "high", key))
    cuts = np.flatnonzero(np.append(True, (np.diff(k) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)))
    return cuts, np.diff(np.append(cuts, len(k))), cells.column("part").to_numpy(), low != high


def pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j within runs of rows, a bounded number at once."""
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return
    left = np.concatenate([np.arange(s, s + n - 1) for s, n in zip(start, size, strict=True)])
    many = np.repeat(start + size, size - 1) - left - 1
    upto = np.cumsum(many)
    at = 0
    while at < len(left):
        done = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
        i = np.repeat(left[at:end], many[at:end])
        first = np.repeat(upto[at:end] - many[at:end], many[at:end])
        yield i, i + 1 + (np.arange(len(i)) + done - first)
        at = end


def blocks(start: np.ndarray, size: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within runs of rows whose rows of ``x`` have an inner product of ``least`` or more, found by
    products of blocks of bounded size."""
    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        step = max(1, (1 << 21) // n)
        for a in range(s, s + n, step):
            b = min(a + step, s + n)
            i, j = np.nonzero(x[a:b] @ x[a : s + n].T >= least)
            up = j > i
            i, j = i[up] + a, j[up] + a
            for at in range(0, len(i), 8 * PAIRS_AT_ONCE):
                yield i[at : at + 8 * PAIRS_AT_ONCE], j[at : at + 8 * PAIRS_AT_ONCE]


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links a-b."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class Forest:
    """Links gathered as a star forest: reduced whenever more than ``room`` wait, so memory follows nodes, not links."""

    def __init__(self, room: int = 1 << 18) -> None:
        self.room, self.waiting, self.held = room, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.waiting += len(a)
            if self.waiting > self.room:
                self.held = [self.links()]
                self.waiting = 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return star_forest(*(np.concatenate(e) for e in zip(*self.held, strict=True)))
