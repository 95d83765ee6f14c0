from __future__ import annotations

from itertools import product

from veilspark.plans.similar import similar


def test_rows_too_long_for_all_of_the_other_side_are_not_taken_apart(spark):
    sets = {k: [f"w{(k * j * j + j) % 23}" for j in range(1 + k % 9)] for k in range(60)}
    a = spark.createDataFrame([*((k, list(dict.fromkeys(v))) for k, v in sets.items()), (900, [f"w{j}" for j in range(400)]), (901, [])], "i long, w array<string>")
    b = spark.createDataFrame([(k, list(dict.fromkeys(sets[k + 1]))) for k in range(0, 50, 3)], "j long, w array<string>")
    for least in (0.3, 0.5, 1.0):
        rows = {(i, j): s for i, j, s in similar(a, b, "i", "j", "w", least).collect()}
        want = {}
        for (i, x), (j, y) in product(a.collect(), b.collect()):
            s = len(set(x) & set(y)) / len(set(x) | set(y))
            if s >= least:
                want[i, j] = s
        assert rows == want
    plan = similar(a, b, "i", "j", "w", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "_most" in plan
