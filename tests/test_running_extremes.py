"""What comes after a row is found without a frame that runs to the end, which takes the square of the rows."""

import random

from grovewise.operators import ordering


def test_no_frame_runs_to_the_end_and_extremes_are_right(spark):
    rng = random.Random(3)
    rows = [(p, n, rng.choice([None, *range(50)])) for p in (0, 1, None) for n in rng.sample(range(200), 60)]
    found = ordering.running_extremes(spark.createDataFrame(rows, "p int, n int, v int").repartition(5), "p", "n", "v", "hi", "lo")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    got = {(r["p"], r["n"], r["v"]): (r["hi"], r["lo"]) for r in found.collect()}
    for p, n, v in rows:
        of = [(m, w) for q, m, w in rows if q == p and w is not None]
        assert got[p, n, v] == (max((w for m, w in of if m < n), default=None), min((w for m, w in of if m > n), default=None))
