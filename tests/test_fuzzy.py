"""Near lines and votes for offsets against the plain versions, line by line."""

import random

from pyspark.sql import functions as F

from veilspark.functions import rowmatch
from veilspark.functions.assembly import Assembly
from veilspark.operators import rows


def misread(rng, key):
    key = list(key)
    for _ in range(rng.randint(0, 3)):
        if key:
            k = rng.randrange(len(key))
            key[k : k + 1] = rng.choice([[], ["q"], ["a", "a"], ["1"], ["é"]])
    return "".join(key)


def test_letter_pairs(spark):
    df = spark.createDataFrame([("abcé",), ("aaaa",), ("ab\U0001f600",)], "k string")
    assert [r.p for r in df.select(rows.letter_pairs(F.col("k")).alias("p")).collect()] == [["ab", "bc", "cé"], ["aa", "aa", "aa"], ["ab", "b\U0001f600"]]


def test_near_keys_are_the_plain_ones(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcde12") for _ in range(n)) for n in (5, 12, 13, 20, 40, 41, 90, 300)] + ["aaaaaaaaaaaaaaaa", "abababababababab"]
    own = [(d, misread(rng, k)) for d in range(3) for k in base for _ in range(6)]
    read = [(d, misread(rng, k)) for d in range(4) for k in base for _ in range(6)] + [(0, ""), (1, None)]
    got = rows.near_keys(spark.createDataFrame(own, "doc int, key string"), spark.createDataFrame(read, "doc int, key string"), ["doc"]).collect()
    want = {(d, a, b) for d, a in own for e, b in read if d == e and b is not None and rowmatch.same_line(a, b)}
    assert sorted(map(tuple, got)) == sorted(want) and any(a != b for _, a, b in want) and any(len(a) > 100 and a != b for _, a, b in want)


def test_offsets_are_the_plain_ones(spark):
    rng = random.Random(2)
    docs, reads, want = [], [], {}
    for d in range(25):
        lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([2, 6, 15, 30, 60]))) for _ in range(rng.randint(1, 30))]
        lines += rng.sample(lines, len(lines) // 3)
        keys = [rowmatch.key(t) for t in lines]
        docs += [(d, j, k) for j, k in enumerate(keys)]
        a = Assembly()
        a.rows = [a._row({"text": t}, 1) for t in lines]
        for r in range(4):
            at = rng.randint(0, len(lines) - 1)
            seen = [misread(rng, k) if rng.random() < 0.4 else k for k in keys[at : at + rng.randint(1, 8)]] if r else ["zzzz", "yyyyyy"]
            reads += [(d, r, i, k) for i, k in enumerate(seen)]
            want[d, r] = a._offset(seen)
    got = rows.offsets(spark.createDataFrame(docs, "doc int, j int, key string"), spark.createDataFrame(reads, "doc int, read int, i int, key string"), ["doc"]).collect()
    assert {(r.doc, r["read"]): r.offset for r in got} == want
    assert sum(v is not None for v in want.values()) > 40
    none = spark.createDataFrame([], "doc int, j int, key string")
    assert {r.offset for r in rows.offsets(none, spark.createDataFrame(reads, "doc int, read int, i int, key string"), ["doc"]).collect()} == {None}


def test_keys_of_rows(spark):
    said = ["É a-1 ﬁ", None, "", "日本 Ⅷ"]
    assert [r.k for r in spark.createDataFrame([(t,) for t in said], "t string").select(rows.row_key(F.col("t")).alias("k")).collect()] == [rowmatch.key(t or "") for t in said]
