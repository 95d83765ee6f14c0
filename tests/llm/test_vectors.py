"""Vector codes against the contract in plain Python, whitening against a dense decomposition; odd rows for both."""

import hashlib
from math import floor, isfinite

import duckdb
import numpy as np
import pytest

from veilspark.llm import vector_codes, whitening
from veilspark.llm.queries import OP12_SQL, op12_vector_codes, op13_embedding_whitening

COLUMNS = "vec_id long, embedding array<float>, label int, code string, n int"


def table(spark, rows):
    """Rows of (id, vector, label), with columns whose names the operators use."""
    return spark.createDataFrame([(*r, "x", 5) for r in rows], COLUMNS)


def whole(rows):
    return [r for r in rows if r[1] is not None and None not in r[1] and all(isfinite(x) for x in r[1])]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(whole(rows), key=lambda r: (r[0], r[1]))
    w = len(rows[0][1]) // parts
    cut = [[[floor(256 * np.float32(x).item()) for x in v[p * w : (p + 1) * w]] for p in range(parts)] for _, v, _ in rows]
    books = [[cut[r][p] for r in range(min(entries, len(rows)))] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((square(v, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in cut:
                got.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(x) // len(got[k]) for x in zip(*got[k])] if k in got else c for k, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(rows, cut):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return [(i, code, e, total[label], sha) for i, code, e, label in out]


def got_codes(df, **kw):
    return sorted(tuple(r) for r in vector_codes.compressed(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("seed,d", [(1, 64), (2, 16), (3, 32)])
def test_codes_are_the_plain_version(spark, seed, d):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=d) * rng.choice([0.01, 1, 30]))], int(rng.integers(0, 4)) or None) for i in rng.permutation(150)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(2000, [0.0] * d, 1), (2001, [-1 / 256] * d, None)]
    rows += [(3000, None, 1), (3001, [None] + [1.0] * (d - 1), 1), (3002, [float("nan")] * d, 1), (3003, [float("inf")] * d, None)]
    assert got_codes(table(spark, rows).repartition(5)) == sorted(plain_codes(rows))


def test_codes_of_few_rows_hot_labels_and_empty_tables(spark, monkeypatch):
    rows = [(k, [float(k), 1.0] * 8, 7) for k in range(9)]
    want = sorted(plain_codes(rows))
    assert got_codes(table(spark, rows)) == want and {r[2] for r in want} == {0}
    monkeypatch.setattr(vector_codes.shared, "HEAVY", 2)
    assert got_codes(table(spark, rows)) == want
    assert got_codes(table(spark, rows[:1])) == sorted(plain_codes(rows[:1]))
    assert got_codes(table(spark, rows).limit(0)) == [] and got_codes(table(spark, [(1, None, 2)])) == []


def test_codes_of_other_lengths_and_large_components(spark):
    rows = [(k, [float(k % 3)] * 16, 1) for k in range(30)]
    more = [(100, [1.0, 2.0, 3.0], 1), (101, [2.0, 2.0, 3.0], 1), (102, [], 1), (103, [1e30] * 16, 1), (104, [5.0] * 17, None), (105, [1e30] * 5, 2)]
    by = {r[0]: r for r in got_codes(table(spark, rows + more))}
    assert len(by) == 36
    own = {r[0]: r for r in plain_codes(rows)}
    assert all(by[k][1:3] == own[k][1:3] and by[k][4] == own[k][4] for k in range(30))
    assert by[100][1:3] == ("00" * 16, 0) and by[101][1:3] == ("01" + "00" * 15, 0) and by[102][2] == 0 and by[104][2] == 0
    assert by[103][1:3] == (None, None) and by[105][1:4] == (None, None, None)
    # a code stands for whole numbers near the vector
    books = [np.array([[1], [5]])] * 2
    assert vector_codes.decoded("0001", books) == [1, 5]


def test_int64_products_don_t_overflow_at_the_reach():
    for d in (16, 64, 1000):
        most, bounds = vector_codes.reach(d), vector_codes.bounds_of(d)
        x = np.full((1, d), most)
        books = [np.full((2, b - a), -most) for a, b in zip(bounds, bounds[1:])]
        codes, error = vector_codes.assigned(x, books, bounds)
        assert error[0] == d * (2 * most) ** 2 and not codes.any()


def test_codes_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op12_vector_codes(spark, sf_dir).collect()) == sorted(con.execute(OP12_SQL).fetchall())


def check_whitened(rows, out, components=8):
    rows = whole(rows)
    x = np.array([[floor(1024 * np.float32(c).item()) + 100000 for c in v] for _, v, _ in rows], object)
    n, sums = len(rows), x.sum(0)
    centred = (n * x - sums).astype(float) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(values))
    by = {}
    for r in out:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, k + 1)) and all(len(g) == n for g in by.values())
    error = next(iter(by[1].values())).identity_error
    assert error is not None and error < 1e-8
    for c, g in by.items():
        w = np.array([g[r[0]].whitened for r in rows])
        want = centred @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-7
        for (i, _, _), t in zip(rows, x):
            assert g[i].n == n and g[i].deviation == sum((n * a - s) ** 2 for a, s in zip(t, sums)) and g[i].identity_error == error
            assert g[i].explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)


@pytest.mark.parametrize("seed,d,n", [(1, 64, 300), (2, 5, 40), (3, 100, 400)])
def test_whitening_is_the_dense_one(spark, seed, d, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.geomspace(1, 0.05, d)[rng.permutation(d)] @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 3
    rows = [(k, [float(c) for c in np.float32(v)], 0) for k, v in enumerate(x)]
    rows += [(3000, None, 1), (3001, [None] + [1.0] * (d - 1), 1), (3002, [float("nan")] * d, 1), (3003, [float("-inf")] * d, None)]
    check_whitened(rows, whitening.whitened(table(spark, rows).repartition(5)).collect())


def test_lobpcg_certifies_close_eigenvalues():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = np.concatenate([[5, 4.999, 4.998, 3, 2.9999, 2, 1.01, 1.0], np.linspace(0.99, 0, 292)])
    v = (q * values) @ q.T
    got, axes, norms = whitening.lobpcg(lambda b: v @ b, 300, 8)
    assert np.abs(got - values[:8]).max() < 1e-12 and norms.max() < 5e-10
    assert np.abs(np.abs((axes * q[:, :8]).sum(0)) - 1).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: v @ b, 300, 8, steps=2)


def test_whitening_of_few_equal_and_large_rows(spark):
    few = [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 0.0, 1.0], 0), (2, [2.0, 0.0, 1.0], 0)]
    out = whitening.whitened(table(spark, few)).collect()
    assert len(out) == 9 and [r.whitened is None for r in sorted(out, key=lambda r: (r.component, r.vec_id))] == [False] * 3 + [True] * 6
    assert all(r.explained == pytest.approx(float(r.component == 1)) for r in out) and {round(r.identity_error, 9) for r in out} == {0.0}
    same = whitening.whitened(table(spark, [(k, [0.5] * 16, 0) for k in range(5)])).collect()
    assert len(same) == 40 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}
    assert whitening.whitened(table(spark, few).limit(0)).count() == 0 and whitening.whitened(table(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    mixed = whitening.whitened(table(spark, few + [(7, [1.0, 2.0], 0), (8, [3.0, 5.0], 0), (9, [1e30, 1.0], 0), (10, [1e10, 0.0, 0.0], 0)])).collect()
    assert sorted({r.vec_id for r in mixed}) == [1, 2, 7, 8, 10] and {r.n for r in mixed if r.vec_id in (7, 8)} == {2} and {r.n for r in mixed if r.vec_id < 3} == {4}
    assert {r.deviation for r in mixed if r.vec_id == 10} == {None}


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitened(rows, op13_embedding_whitening(spark, sf_dir).collect())
