"""Hard negatives by a pivot table.

A vector x of norm at most M becomes x' = (x, sqrt(M^2 - |x|^2)), a query q becomes q' = (q M / |q|, 0): all lie on a
sphere, and the larger an inner product, the smaller the Euclidean distance. The table holds every row's distances to a
few pivots. By the triangle inequality |d(q', p) - d(p, x')| <= d(q', x') <= d(q', p) + d(p, x'), so the stored distances
bracket a score without reading the vector; only rows whose brackets reach what is asked for are checked exactly.

Rows are filed in the cell of their nearest pivot, large cells in shards of bounded size. A cell's least and largest
distance to each pivot bracket all of its rows, and an anchor goes only to cells whose brackets reach what it asks for.
It first asks one shard of its own cell, which gives a floor: the last score that counts there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.llm.common import stored

ANCHOR = "key long, id long, label int, v array<double>, pos_ids array<long>, pos_scores array<double>, floors array<double>"
VISIT = f"shard long, kind int, {ANCHOR}, d array<double>"
SAMPLE = 4096  # rows of a width, about, among which pivots are chosen; what is found doesn't depend on the choice
STEP = 4  # pivots between two cuts of the survivors
SLACK = 1e-6  # of M: more than rounding can move a distance


class Pivots(NamedTuple):
    """The pivots of one width, what their cells hold, and the numbers of their shards."""

    points: np.ndarray  # pivots x width
    more: np.ndarray  # the pivots' last coordinate
    m: float
    least: np.ndarray = np.zeros((0, 0))  # cell x pivot: least and largest distance of the cell's rows
    most: np.ndarray = np.zeros((0, 0))
    first: np.ndarray = np.zeros(0, np.int64)  # each cell's first shard and number of shards, 0 where it is empty
    shards: np.ndarray = np.zeros(0, np.int64)

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of augmented rows to the pivots."""
        more = np.sqrt(np.maximum(self.m**2 - (v * v).sum(axis=1), 0.0))
        return np.sqrt(np.maximum(2 * (self.m**2 - v @ self.points.T - more[:, None] * self.more), 0.0))

    def scale(self, v: np.ndarray) -> float:
        norm = float(np.sqrt(v @ v))
        return self.m / norm if norm else 1.0

    def of_query(self, v: np.ndarray) -> np.ndarray:
        q = v * self.scale(v)
        return np.sqrt(np.maximum(q @ q + self.m**2 - 2 * (self.points @ q), 0.0))

    def reach(self, v: np.ndarray, low: float, high: float) -> tuple[float, float]:
        """Rows of a score from ``low`` to ``high`` lie at a distance from the second to the first number; the first is
        negative where no row can have such a score."""
        t = self.scale(v)
        top = (t * t) * (v @ v) + self.m**2 - 2 * t * low if np.isfinite(low) else np.inf
        near = (t * t) * (v @ v) + self.m**2 - 2 * t * high if np.isfinite(high) else 0.0
        slack = SLACK * self.m
        return (np.sqrt(top) + slack if top >= 0 else slack if top >= -(slack**2) else -1.0), max(np.sqrt(max(near, 0.0)) - slack, 0.0)

    def cells(self, v: np.ndarray, low: float, high: float) -> np.ndarray:
        """The cells that may hold a row of a score from ``low`` to ``high``."""
        d, (far, near) = self.of_query(v), self.reach(v, low, high)
        at_least = np.maximum(np.maximum(self.least - d, d - self.most), 0.0).max(axis=1)
        return np.flatnonzero((self.shards > 0) & (at_least <= far) & ((d + self.most).min(axis=1) >= near))


class Shard:
    """Rows of one shard, sorted by the distance to the pivot of their cell."""

    def __init__(self, rows: pd.DataFrame, pivots: Pivots) -> None:
        d = np.stack(rows["d"].to_numpy())
        self.own = int(d[0].argmin())
        order = np.argsort(d[:, self.own], kind="stable")
        self.d, self.v, self.pivots = d[order], np.stack(rows["v"].to_numpy())[order], pivots
        self.ids, self.labels = rows["id"].to_numpy(np.int64)[order], rows["label"].to_numpy(np.int64)[order]
        self.sorted = np.ascontiguousarray(self.d[:, self.own])
        self.steps = [s for s in np.array_split(np.delete(np.arange(d.shape[1]), self.own), range(STEP, d.shape[1], STEP)) if len(s)]

    def found(self, query: pd.Series, same: bool, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the rows of the query's label, or of other labels, whose brackets meet ``low`` to ``high``."""
        v = np.asarray(query.v)
        d, (far, near) = self.pivots.of_query(v), self.pivots.reach(v, low, high)
        a, b = np.searchsorted(self.sorted, d[self.own] - far, "left"), np.searchsorted(self.sorted, d[self.own] + far, "right")
        alive = a + np.flatnonzero(((self.labels[a:b] == query.label) == same) & (self.ids[a:b] != query.id) & (self.sorted[a:b] + d[self.own] >= near))
        for some in self.steps:
            if far == np.inf or not len(alive):
                break
            stored = self.d[np.ix_(alive, some)]
            alive = alive[((np.abs(stored - d[some]) <= far) & (stored + d[some] >= near)).all(axis=1)]
        return self.ids[alive], self.v[alive] @ v


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to smaller ids."""
    some = np.arange(len(ids))
    if len(ids) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Bounds(NamedTuple):
    """A negative's score is from ``low`` to ``high`` hundredths of the positive's."""

    low: float
    high: float

    def inside(self, scores: np.ndarray, positive: float) -> np.ndarray:
        return (self.low * positive <= 100 * scores) & (100 * scores <= self.high * positive)

    def of(self, query: pd.Series) -> tuple[float, float]:
        """From where to where a score counts for any of the query's positives, floors included."""
        return float(min(query.floors)), float(max(np.asarray(query.pos_scores) * self.high / 100))


def _streamed(pivots: dict[int, Pivots], answer: Callable[[Shard | None, pd.DataFrame], pd.DataFrame]):
    """Rows come sorted by shard, a shard's own rows before its visitors. The former are held, the latter pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, index = None, [], None
        for batch in batches:
            number = batch["shard"].to_numpy()
            cuts = [*np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)] if len(number) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = batch.iloc[a:b]
                if number[a] != shard:
                    shard, held, index = number[a], [], None
                own = int((rows["kind"].to_numpy() == 0).sum())
                if own:
                    held.append(rows.iloc[:own])
                if own < len(rows):
                    if held:
                        whole = pd.concat(held)
                        index, held = Shard(whole, pivots[len(whole["v"].iloc[0])]), []
                    yield answer(index, rows.iloc[own:])

    return run


def _first_floors(k: int):
    def answer(index: Shard | None, queries: pd.DataFrame) -> pd.DataFrame:
        floors = []
        for q in queries.itertuples():
            scores = index.found(q, True, -np.inf, np.inf)[1] if index else np.zeros(0)
            floors.append([float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf])
        return queries[["key", "id", "label", "v", "pos_ids", "pos_scores"]].assign(floors=floors)

    return answer


def _positives(k: int):
    def answer(index: Shard | None, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in queries.itertuples():
            if index:
                ids, scores = index.found(q, True, q.floors[0], np.inf)
                out += [(q.key, ids[i], scores[i]) for i in _best(ids, scores, k) if scores[i] >= q.floors[0]]
        return pd.DataFrame(out, columns=["key", "found", "score"])

    return answer


def _negatives(k: int, bounds: Bounds, index: Shard, q: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive of ``q``: its place, and ids and scores of the shard's ``k`` first negatives from its floor on."""
    ids, scores = index.found(q, False, *bounds.of(q))
    for j, (positive, floor) in enumerate(zip(q.pos_scores, q.floors, strict=True)):
        some = np.flatnonzero(bounds.inside(scores, positive) & (scores >= floor))
        some = some[_best(ids[some], scores[some], k)]
        yield j, ids[some], scores[some]


def _second_floors(k: int, bounds: Bounds):
    def answer(index: Shard | None, queries: pd.DataFrame) -> pd.DataFrame:
        floors = []
        for q in queries.itertuples():
            mine = list(q.floors)
            for j, ids, scores in _negatives(k, bounds, index, q) if index else ():
                mine[j] = float(scores[-1]) if len(ids) == k else mine[j]
            floors.append(mine)
        return queries[["key", "id", "label", "v", "pos_ids", "pos_scores"]].assign(floors=floors)

    return answer


def _mined(k: int, bounds: Bounds):
    def answer(index: Shard | None, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in queries.itertuples():
            for j, ids, scores in _negatives(k, bounds, index, q) if index else ():
                out += [(q.key, j, q.id, q.pos_ids[j], q.pos_scores[j], i, s) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["key", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return answer


def choose_pivots(rows: DataFrame, pivots: int) -> dict[int, Pivots]:
    """For each width, M over all rows, and pivots each farthest from those before among about SAMPLE rows drawn at random,
    at most twice as many."""
    out = {}
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    for width, m, n in sorted(rows.groupBy(F.size("v")).agg(F.sqrt(F.max(norm)), F.count(F.lit(1))).collect()):
        some = rows.where(F.size("v") == width).select("v")
        sample = (some.sample(SAMPLE / n, seed=7) if n > SAMPLE else some).limit(2 * SAMPLE).collect() or some.limit(1).collect()
        sample = np.array([r[0] for r in sample], float).reshape(len(sample), width)
        every = np.hstack([sample, np.sqrt(np.maximum(m * m - (sample * sample).sum(axis=1), 0.0))[:, None]])
        chosen, far = [0], np.full(len(every), np.inf)
        while len(chosen) < min(pivots, len(every)):
            far = np.minimum(far, ((every - every[chosen[-1]]) ** 2).sum(axis=1))
            if not far.max() > 0:
                break
            chosen.append(int(far.argmax()))
        out[width] = Pivots(every[chosen, :-1], every[chosen, -1], float(m))
    return out


def pivot_table(rows: DataFrame, pivots: int = 16, shard_rows: int = 8192) -> tuple[DataFrame, dict[int, Pivots]]:
    """(id, label, v, d, shard) of all ``rows``, stored: distances to the pivots and the shard of the nearest one's cell."""
    chosen = choose_pivots(rows, pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, some in batch.groupby(batch["v"].map(len)):
                d = chosen[width].of_rows(np.stack(some["v"].to_numpy()))
                yield some.assign(d=list(d), cell=d.argmin(axis=1).astype(np.int32))

    filed = rows.select("id", "label", "v").mapInPandas(run, "id long, label int, v array<double>, d array<double>, cell int")
    # Rows of a cell are dealt to its shards by where they lie, so repeated rows don't gather.
    filed = stored(filed.withColumn("at", F.monotonically_increasing_id()), "pivot-rows")
    number = 0
    for width, p in chosen.items():
        n = len(p.points)
        least, most, first, shards = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = filed.where(F.size("v") == width).groupBy("cell").agg(F.count(F.lit(1)), *(f(F.col("d")[j]) for f in (F.min, F.max) for j in range(n)))
        for cell, count, *d in sorted(ends.collect()):
            first[cell], shards[cell], least[cell], most[cell] = number, -(-count // shard_rows), d[:n], d[n:]
            number += int(shards[cell])
        chosen[width] = p._replace(least=least, most=most, first=first, shards=shards)
    lengths = {(w, c): (int(p.first[c]), int(p.shards[c])) for w, p in chosen.items() for c in range(len(p.points)) if p.shards[c]}
    if not lengths:
        return filed.select("id", "label", "v", "d", F.lit(0).cast("long").alias("shard")), chosen
    # As many entries as widths and pivots.
    of_cell = F.create_map(*(x for (w, c), (a, n) in lengths.items() for x in (F.lit(f"{w} {c}"), F.struct(F.lit(a).cast("long").alias("a"), F.lit(n).cast("long").alias("n")))))
    cell = of_cell[F.concat_ws(" ", F.size("v"), "cell")]
    return filed.select("id", "label", "v", "d", (cell["a"] + F.pmod(F.xxhash64("at"), cell["n"])).alias("shard")), chosen


def _sent(anchors: DataFrame, pivots: dict[int, Pivots], reach: Callable[[pd.Series], tuple[float, float]] | None) -> DataFrame:
    """Each anchor once for each shard that it has to ask; with no ``reach`` for one shard of its nearest cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, shard = [], []
            for i, q in enumerate(batch.itertuples()):
                p, v = pivots.get(len(q.v)), np.asarray(q.v)
                if p is None:
                    continue
                if reach:
                    asked = [np.arange(p.first[c], p.first[c] + p.shards[c]) for c in p.cells(v, *reach(q))]
                else:
                    c = int(np.where(p.shards > 0, p.of_query(v), np.inf).argmin())
                    asked = [p.first[c : c + 1] + q.key % p.shards[c]]
                asked = np.concatenate(asked) if asked else np.zeros(0, np.int64)
                shard.append(asked)
                place.append(np.full(len(asked), i))
            if place:
                yield batch.iloc[np.concatenate(place)].assign(shard=np.concatenate(shard))

    return anchors.mapInPandas(run, f"{ANCHOR}, shard long")


def _asked(rows: DataFrame, sent: DataFrame, blocks: int, pivots: dict[int, Pivots], answer: Callable, schema: str) -> DataFrame:
    """Shards with the anchors that visit them. A shard's rows are copied for each block of a quarter of a million anchors,
    so that its visitors are several tasks' work."""
    names = [c.split()[0] for c in VISIT.split(", ")]
    own = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    for c in ("key", "pos_ids", "pos_scores", "floors"):
        own = own.withColumn(c, F.lit(None).cast({"key": "long", "pos_ids": "array<long>"}.get(c, "array<double>")))
    visits = sent.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("kind", F.lit(1)).withColumn("d", F.lit(None).cast("array<double>"))
    both = own.unionByName(visits).withColumn("shard", F.col("shard") * blocks + F.col("block")).select(*names)
    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInPandas(_streamed(pivots, answer), schema)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: float = 30, high: float = 90, pivots: int = 16, shard_rows: int = 8192, query_rows: int = 1 << 18) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores double.

    ``rows`` and ``anchors`` are (id long, label int, v array<double>), none null, components finite; whole numbers where
    ties must be exact. An anchor's positives are its ``positives`` first rows of its label by inner product, ties to
    smaller ids. For each, rank 1 to ``negatives`` are the first rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's. Rows of the anchor's own id are neither. Every row of a repeated id counts;
    equal anchors are one, anchors of one id with other labels or vectors each have their own. Only vectors of one width
    are compared; each width has pivots of its own, so widths should be few. Anchors without positives, and positives
    without negatives, give no row, empty tables none. Other columns are ignored.

    Every row is covered: floors and brackets only leave out what can't count. A task holds one shard and a batch.
    """
    bounds = Bounds(low, high)
    filed, chosen = pivot_table(rows, pivots, shard_rows)
    none = F.lit(None)
    first = anchors.select("id", "label", "v").dropDuplicates().withColumn("key", F.xxhash64("id", "label", "v"))
    first = first.select("key", "id", "label", "v", none.cast("array<long>").alias("pos_ids"), none.cast("array<double>").alias("pos_scores"), none.cast("array<double>").alias("floors"))
    blocks = max(1, -(-first.count() // query_rows))
    first = stored(_asked(filed, _sent(first, chosen, None), blocks, chosen, _first_floors(positives), ANCHOR), "pivot-anchors")
    found = _asked(filed, _sent(first, chosen, lambda q: (float(q.floors[0]), np.inf)), blocks, chosen, _positives(positives), "key long, found long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "found")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # At most so many positives an anchor.
    found = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "found", "score"))).alias("p")).select("key", F.col("p.found").alias("pos_ids"), F.col("p.score").alias("pos_scores"))
    second = first.drop("pos_ids", "pos_scores", "floors").join(found, "key").where(F.exists("pos_scores", lambda s: s * low <= s * high))
    second = second.withColumn("floors", F.transform("pos_scores", lambda s: s * low / 100)).select("key", "id", "label", "v", "pos_ids", "pos_scores", "floors")
    second = stored(_asked(filed, _sent(second, chosen, None), blocks, chosen, _second_floors(negatives, bounds), ANCHOR), "pivot-positives")
    schema = "key long, place int, anchor_id long, positive_id long, positive_score double, negative_id long, negative_score double"
    mined = _asked(filed, _sent(second, chosen, bounds.of), blocks, chosen, _mined(negatives, bounds), schema)
    rank = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(embeddings: DataFrame, label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v) with v = floor(scale * x) of every row that has an id, a label and a vector of finite components."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return embeddings.where(sound & F.col(label).isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), F.col(label).cast("int").alias("label"), x.alias("v"))
