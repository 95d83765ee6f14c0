"""The similarity join against all pairs."""

import random

import pytest

from veilspark.plans.similar import similar


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(1)
    common = [f"c{k}" for k in range(6)]
    sets = []
    for _ in range(30):
        own = {*rng.sample(common, rng.randint(0, 6)), *(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12)))}
        sets += [own, own ^ {rng.choice(common)}, own | {f"w{rng.randint(0, 60)}"}]
    a, b = {k: sorted(s) for k, s in enumerate(sets)}, {k: sorted(s) for k, s in enumerate(sets[::2])}
    got = similar(spark.createDataFrame(list(a.items()), "i int, w array<string>"), spark.createDataFrame(list(b.items()), "j int, w array<string>"), "i", "j", "w", least).collect()
    want = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for i, x in a.items() for j, y in b.items() if x and y and len({*x} & {*y}) >= least * len({*x} | {*y})}
    assert {(r.i, r.j): pytest.approx(r.similarity) for r in got} == want and len(got) == len(want) > 30
