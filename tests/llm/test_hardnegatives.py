"""Hard negatives: brute force over many shards, ties, repeated ids, widths; brackets; odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "id long, label int, v array<double>, rank int"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    out = []
    for a, label, v in {(a[0], a[1], tuple(a[2])) for a in anchors}:
        scored = sorted((-float(np.dot(v, r[2])), r[0], r[1]) for r in rows if r[0] != a and len(r[2]) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def rows_with_ties(n, width=6, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [(i, int(rnd.integers(0, 4)), rnd.integers(-4, 6, width).astype(float).tolist()) for i in range(n)]
    hot = [5.0, 4.0, 3.0] + [1.0] * (width - 3)
    rows += [(n + i, i % 2, hot) for i in range(n // 3)]  # a third of all are one vector
    rows += [(n // 2, 1, rows[0][2]), (n // 2, 2, rows[1][2]), (n // 2, 2, rows[1][2]), (40, 0, [0.0] * width)]  # repeated ids, a zero
    return rows


@pytest.mark.parametrize(("shard_rows", "pivots", "query_rows"), [(7, 5, 3), (64, 16, 1 << 18), (8192, 1, 1 << 18)])
def test_hard_negatives_against_brute_force(spark, shard_rows, pivots, query_rows):
    from grovewise.llm.hardnegatives import hard_negatives

    rows = rows_with_ties(240) + [(1000 + i, i % 3, [float(i % 7), float(i % 5)]) for i in range(60)] + [(2000, 1, []), (2001, 1, []), (2002, 2, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)
    found = hard_negatives(df, df.where("id % 20 = 0"), positives=3, negatives=4, shard_rows=shard_rows, pivots=pivots, query_rows=query_rows)
    assert sorted(map(tuple, found.collect())) == brute(rows, [r for r in rows if r[0] % 20 == 0], 3, 4)


def test_odd_tables(spark):
    from grovewise.llm.hardnegatives import hard_negatives, labelled_vectors

    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none, none).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0, 2.0], 0)], SCHEMA)
    assert hard_negatives(one, one).count() == 0 and hard_negatives(one, none).count() == 0 and hard_negatives(none, one).count() == 0
    far = spark.createDataFrame([(0, 1, [1.0], 0), (1, 1, [-1.0], 0), (2, 2, [-1.0], 0)], SCHEMA)
    assert hard_negatives(far, far.where("id = 0")).count() == 0  # a negative best positive has no window
    embeddings = [(1, [0.5, -0.25], 1), (None, [0.5, 0.5], 1), (2, None, 1), (3, [None, 0.5], 1), (4, [float("nan"), 0.5], 1), (5, [float("-inf"), 0.5], 1), (6, [0.5, 0.5], None)]
    kept = labelled_vectors(spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int"))
    assert [tuple(r) for r in kept.collect()] == [(1, 1, [128.0, -64.0])]


def test_an_anchor_that_is_no_row(spark):
    from grovewise.llm.hardnegatives import hard_negatives

    rows = rows_with_ties(90, width=4)
    anchors = [(-1, 1, [900.0, -3.0, 2.0, 7.0]), (-2, 2, [0.0, 0.0, 0.0, 1.0]), (-3, 2, [1.0])]
    frames = (spark.createDataFrame([(*r, 0) for r in t], SCHEMA) for t in (rows, anchors))
    assert sorted(map(tuple, hard_negatives(*frames, shard_rows=16).collect())) == brute(rows, anchors)


@given(st.integers(0, 10_000), st.sampled_from([1.0, 1e-3, 1e6]))
@settings(max_examples=60, deadline=None)
def test_brackets_hold_every_row(seed, scale):
    from grovewise.llm.hardnegatives import Pivots

    rnd = np.random.default_rng(seed)
    rows = rnd.normal(size=(40, 5)) * scale * rnd.choice([0.0, 0.1, 1.0], size=(40, 1))
    m = float(np.sqrt((rows * rows).sum(axis=1)).max())
    points = rows[:4]
    p = Pivots(points, np.sqrt(np.maximum(m * m - (points * points).sum(axis=1), 0)), m)
    d = p.of_rows(rows)
    cell = d.argmin(axis=1)
    least, most = (np.array([f(d[cell == c], axis=0) if (cell == c).any() else np.full(4, x) for c in range(4)]) for f, x in ((np.min, np.inf), (np.max, -np.inf)))
    p = p._replace(least=least, most=most, shards=np.bincount(cell, minlength=4))
    for q in (*rows[:3], rnd.normal(size=5), np.zeros(5)):
        scores, dq = rows @ q, p.of_query(q)
        for low, high in ((-np.inf, np.inf), tuple(sorted(rnd.choice(scores, 2)))):
            far, near = p.reach(q, low, high)
            inside = (scores >= low) & (scores <= high)
            assert (np.abs(d - dq).max(axis=1)[inside] <= far).all() and ((d + dq).min(axis=1)[inside] >= near).all()
            assert set(cell[inside]) <= set(p.cells(q, low, high))


def test_brackets_leave_rows_out():
    from grovewise.llm.hardnegatives import Pivots, Shard
    import pandas as pd

    rnd = np.random.default_rng(5)
    rows = np.repeat(rnd.normal(size=(8, 16)) * 100, 50, axis=0) + rnd.normal(size=(400, 16))
    m = float(np.sqrt((rows * rows).sum(axis=1)).max())
    p = Pivots(rows[::50], np.sqrt(np.maximum(m * m - (rows[::50] ** 2).sum(axis=1), 0)), m)
    shard = Shard(pd.DataFrame({"id": np.arange(400), "label": np.arange(400) % 2, "v": list(rows), "d": list(p.of_rows(rows))}), p)
    q = pd.Series({"id": 0, "label": 0, "v": rows[0]})
    others = (rows @ rows[0])[2::2]
    best = np.sort(others)[-5]
    ids, scores = shard.found(q, True, best, np.inf)
    assert 5 <= len(ids) < 100 and (scores >= best).sum() == 5


def test_query_over_the_whole_table(spark):
    from grovewise.llm.queries import op12_hard_negatives

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [float(np.floor(256 * float(c))) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_hard_negatives(spark, sf).collect())) == brute(rows, [r for r in rows if r[0] % 100 == 0])
