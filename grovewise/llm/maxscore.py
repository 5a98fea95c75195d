"""Exact top-k by inner product with MaxScore over sharded postings.

A term is a dimension; a posting is a vector's weight in it. In each shard a query's terms are ordered by score bound
(the most that any posting of the shard adds). While the bounds of the terms not yet read could lift an unseen vector
to the k-th best score, the next term is essential and its postings are read in full; after that the rest are probed
only for the vectors whose score so far plus the remaining bounds is still competitive. The survivors' scores are
exact. Each shard keeps its best k and a window merges the shards.

First every query searches one shard only; its k-th score there is a floor from which it starts in all shards. Queries
and vectors meet in blocks: a task sees one shard and one block of queries, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.llm.common import stored

RESULT = "query_id long, vec_id long, score double"
STEP = 4  # terms between two cuts of the competitive set


class Postings:
    """A shard's index. Terms held by most vectors are stored as columns, so a read is one pass over memory."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.ascontiguousarray(rows[order])
        self.columns = np.ascontiguousarray(self.rows.T)
        self.high, self.low = self.columns.max(axis=1), self.columns.min(axis=1)

    def top(self, own: int, q: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, float]]:
        """The ``k`` best (id, score) of a score of at least ``floor``, ties to smaller ids, without the query's own id."""
        bounds = np.maximum(q * self.high, q * self.low)  # the most that a term can add, signs included
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[q[terms] != 0]
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0.0)
        alive, score = None, np.zeros(len(self.ids))
        for at in range(0, len(terms), STEP):
            some = terms[at : at + STEP]
            if alive is None:
                score += q[some] @ self.columns[some]  # essential: all postings
            else:
                score += self.rows[np.ix_(alive, some)] @ q[some]  # probes
            left = rest[min(at + STEP, len(terms))]
            if at % (4 * STEP) == 0 or alive is not None:
                floor = max(floor, self._floor(own, q, k, score, alive))
            keep = score + left >= floor
            if keep.mean() < 0.5:
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                score = score[keep]
        ids = self.ids if alive is None else self.ids[alive]
        score = np.where(ids == own, -np.inf, score)
        best = np.lexsort((ids, -score)) if len(ids) <= 4 * k else self._best(ids, score, k)
        return [(int(ids[i]), float(score[i])) for i in best if ids[i] != own and score[i] >= floor][:k]

    def _best(self, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        at_least = np.partition(score, len(score) - k)[len(score) - k]
        found = np.flatnonzero(score >= at_least)
        return found[np.lexsort((ids[found], -score[found]))]

    def _floor(self, own: int, q: np.ndarray, k: int, score: np.ndarray, alive: np.ndarray | None) -> float:
        """A lower bound of the k-th best score: the exact scores of the vectors that lead so far."""
        n = min(len(score), 4 * k)
        lead = np.argpartition(score, len(score) - n)[-n:]
        lead = lead if alive is None else alive[lead]
        lead = lead[self.ids[lead] != own]
        return float(np.sort(self.rows[lead] @ q)[-k]) if len(lead) >= k else -np.inf


def _index(vectors: pd.DataFrame) -> Postings:
    return Postings(vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()))


def _floors(k: int):
    """The queries with a floor: their k-th score in this shard, if there are so many."""

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        floors = np.full(len(queries), -np.inf)
        if len(vectors) and len(queries):
            index = _index(vectors)
            found = [index.top(q, np.asarray(v), k) for q, v in zip(queries["id"], queries["v"], strict=True)]
            floors = np.array([f[k - 1][1] if len(f) == k else -np.inf for f in found])
        return queries[["id", "v"]].assign(floor=floors)

    return run


def _search(k: int):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = _index(vectors)
        found = [(q, i, s) for q, v, f in zip(queries["id"], queries["v"], queries["floor"], strict=True) for i, s in index.top(q, np.asarray(v), k, f)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best vectors by inner product, ties to the smaller id.

    Both tables are (id long, v array<double>), finite and not null; weights should be integers where exact ties matter.
    Every row is a candidate, also of a repeated id; rows with the query's id aren't its answers. Rows of one query id
    are one query: the best of all their scores count. Vectors of another width than the query's are no candidates.
    Fewer than ``k`` candidates give fewer rows, an empty table none. Other columns are ignored.
    """
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // query_rows))
    # Rows of one id may be many, so the shard depends on the vector as well.
    left = vectors.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"))
    right = queries.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("v", "id"), F.lit(shards)).alias("shard"))
    near = left.groupBy("width", "shard").cogroup(right.groupBy("width", "shard")).applyInPandas(_floors(k), "id long, v array<double>, floor double")
    near = stored(near, "maxscore-floors")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = near.withColumn("width", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(id, v) with v = floor(scale * x) of every row; vectors that are null or hold null or non-finite components, and
    rows without an id, are left out."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), x.alias("v"))
