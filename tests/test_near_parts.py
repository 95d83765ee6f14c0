"""Near keys by the parts of their letter pairs, against all pairs."""

from collections import Counter

import numpy as np

from veilspark.operators import rows


def plain(a, b):
    if a == b or min(len(a), len(b)) < rows.SHORTEST or rows._digits(a) != rows._digits(b) or abs(len(a) - len(b)) > max(3, len(a) * rows.BAND):
        return False
    x, y = (Counter(k[i : i + 2] for i in range(len(k) - 1)) for k in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2) >= rows.ALIKE


def made(seed, n):
    """Keys of all lengths and forms of them: a letter misread, left out, added, or many of them."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list("abcdé12\U0001f600"), k, p=[0.3, 0.3, 0.2, 0.1, 0.04, 0.02, 0.02, 0.02]))
    out = ["", "a", "aaaaaaaaaaaa", "a" * 13, "a" * 15, "a" * 16]
    for _ in range(n):
        k = word(int(rng.choice([11, 12, 13, 20, 40, 90, 400])))
        out.append(k)
        for _ in range(3):
            for _ in range(int(rng.integers(1, max(2, len(k) // 20)))):
                i = int(rng.integers(len(k)))
                k = k[:i] + str(rng.choice(["", "b", "ab"])) + k[i + 1 :]
            out.append(k)
    return list(dict.fromkeys(out))


def test_parts_miss_no_near_key(monkeypatch):
    for seed, at_once in enumerate((rows.AT_ONCE, 1)):
        monkeypatch.setattr(rows, "AT_ONCE", at_once)
        keys = made(seed, 25)
        rng = np.random.default_rng(seed)
        group, own, read = np.repeat([0, 1], [len(keys), len(keys)]), rng.random(2 * len(keys)) < 0.7, rng.random(2 * len(keys)) < 0.7
        both = keys + keys
        x, y = rows.near_pairs(group, both, own, read)
        want = {(i, j) for i in np.flatnonzero(own).tolist() for j in np.flatnonzero(read).tolist() if group[i] == group[j] and plain(both[i], both[j])}
        assert set(zip(x.tolist(), y.tolist())) == want and len(want) > 50


def test_documents_over_chunks_of_batches(spark, monkeypatch):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(rows, "CHUNK", 100)
        keys = made(5, 8)
        data = [(d, k) for d in range(5) for k in keys[d:]]
        df = spark.createDataFrame(data, "doc int, key string")
        got = Counter(tuple(r) for r in rows.near_keys(df, df, ["doc"]).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == Counter((d, a, b) for d in range(5) for a in keys[d:] for b in keys[d:] if a == b or plain(a, b))


def test_nothing_of_lines_is_spread_over_letters(spark):
    """What moves are keys: no row for each letter pair, and no window over what meets."""
    df = spark.createDataFrame([(0, 0, "abcdefghijklmnop")], "doc int, j int, key string")
    plan = rows.offsets(df, df.selectExpr("doc", "0 as read", "j as i", "key"), ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") <= 2
