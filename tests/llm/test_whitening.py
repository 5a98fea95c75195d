"""Whitening: against numpy and whole-number arithmetic, odd rows, degenerate tables."""

from __future__ import annotations

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, x int"


def plain(xs, components=8):
    """n, deviations and whitened rows by whole numbers and numpy."""
    n, sums = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in xs])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_whitening_against_numpy_with_odd_rows(spark):
    from grovewise.llm.whitening import integer_vectors, whitened_components

    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=12) * np.linspace(0.5, 0.05, 12) + 0.3).astype(np.float32).tolist(), None, 4) for i in range(300)]
    rows += [(5, rows[5][1], 1, 4), (None, rows[6][1], 1, 4)]
    odd = [(900, None, 1, 4), (901, [None] + [0.1] * 11, 1, 4), (902, [float("nan")] * 12, 1, 4), (903, [float("inf")] * 12, 1, 4), (904, [], 1, 4)]
    found = whitened_components(integer_vectors(spark.createDataFrame(rows + odd, SCHEMA))).collect()
    xs = [[int(np.floor(1024 * float(c))) + 100_000 for c in r[1]] for r in rows]
    n, deviation, whitened, explained = plain(xs)
    assert len(found) == 8 * len(rows) and {r["vec_id"] for r in found} == {r[0] for r in rows}
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-9 and len({r["identity_error"] for r in found}) == 1
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    sign = {c: np.sign(by_id[0][c][0]["whitened"] * whitened[0][c - 1]) for c in range(1, 9)}
    for (vec_id, *_), d, w in zip(rows, deviation, whitened, strict=True):
        for c in range(1, 9):
            assert len(by_id[vec_id][c]) == (2 if vec_id == 5 else 1)
            for r in by_id[vec_id][c]:
                assert r["deviation"] == d and abs(r["whitened"] * sign[c] - w[c - 1]) < 1e-9
                assert abs(r["explained"] - explained[c - 1]) < 1e-12


def test_degenerate_tables(spark):
    from grovewise.llm.whitening import RESULT, integer_vectors, whitened_components

    def run(rows):
        return whitened_components(integer_vectors(spark.createDataFrame(rows, SCHEMA)))

    assert run([]).count() == 0 and run([(1, [0.5, 0.25], 0, 0)]).count() == 0
    assert run([(i, [0.5, 0.25], 0, 0) for i in range(9)]).count() == 0  # equal rows
    line = run([(i, [i / 8, i / 4, 1.0], 0, 0) for i in range(9)])
    assert sorted(r["component"] for r in line.collect()) == [1] * 9 and line.schema.simpleString() == spark.createDataFrame([], RESULT).schema.simpleString()
    two = run([(i, [i % 3 / 8, i % 5 / 4], 0, 0) for i in range(30)] + [(100 + i, [i % 7 / 8], 0, 0) for i in range(14)])  # widths apart
    assert {(r["n"], r["component"]) for r in two.collect()} == {(30, 1), (30, 2), (14, 1)}


def test_sums_of_squares_beyond_64_bits():
    from grovewise.llm.whitening import squared

    assert squared(np.array([[3, -4], [1, 0]])) == [25, 1]
    big = 3_000_000_000
    assert squared(np.array([[big, 0], [big, big], [1, 2]])) == [big**2, None, 5]


def test_entries_that_cant_be_centred_exactly_are_an_error(spark):
    from grovewise.llm.whitening import integer_vectors, whitened_components

    with pytest.raises(ArithmeticError):
        whitened_components(integer_vectors(spark.createDataFrame([(i, [4e15, 1.0], 0, 0) for i in range(2)], SCHEMA)))


def test_query_over_the_whole_table(spark):
    from grovewise.llm.queries import op13_whiten_vectors

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    xs = [[int(np.floor(1024 * float(c))) + 100_000 for c in r["embedding"]] for r in rows]
    n, deviation, whitened, explained = plain(xs)
    found = op13_whiten_vectors(spark, sf).toPandas()
    assert len(found) == 8 * len(rows)
    for c in range(1, 9):
        one = found[found.component == c].set_index("vec_id")
        w = np.array([one.whitened[r["vec_id"]] for r in rows])
        assert min(np.abs(w - whitened[:, c - 1]).max(), np.abs(w + whitened[:, c - 1]).max()) < 1e-8
        assert [one.deviation[r["vec_id"]] for r in rows] == deviation and (one.n == n).all()
        assert np.allclose(one.explained, explained[c - 1], rtol=1e-9, atol=0) and (one.identity_error < 1e-9).all()
