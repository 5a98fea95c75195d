"""Lists ranked by contraction."""

from __future__ import annotations

from grovewise.operators import intervals


def test_contracted_lists_have_the_sums_of_their_steps(spark):
    # Lists of 3,000, 1 and 40 steps, one of 30 that leads to a step that isn't there, and a circle of 50.
    lists, rows, want, at = [3000, 1, 40, 30, 50], [], {}, 0
    for k, size in enumerate(lists):
        for i in range(size):
            last = {3: 10**6, 4: at}.get(k)
            rows.append((at + i, at + i + 1 if i + 1 < size else last, i % 3, 1))
            want[at + i] = (sum(j % 3 for j in range(i, size)), size - i) if k < 3 else None
        at += size
    steps = spark.createDataFrame(rows, "e long, s long, n long, depth long").repartition(5)
    got = intervals.ranked_steps(steps, few=40).collect()
    assert len(got) == len(rows)
    assert {r["e"]: (r["n"], r["depth"]) if r["s"] is None else None for r in got} == want


def test_contraction_moves_a_bounded_number_of_rows(spark, monkeypatch):
    written = []
    real = intervals.observed

    def counted(df, **metrics):
        out = real(df, **metrics)
        written.append(out[0].count())
        return out

    monkeypatch.setattr(intervals, "observed", counted)
    n = 20_000
    steps = spark.range(n).selectExpr("id as e", f"if(id + 1 < {n}, id + 1, null) as s", "1L as n", "1L as depth")
    assert intervals.ranked_steps(steps, few=100).selectExpr("sum(n)").first()[0] == n * (n + 1) // 2
    assert len(written) > 10 and sum(written) < 5 * n
