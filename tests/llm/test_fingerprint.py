"""Fingerprints against a plain version of the same parsing, symbol by symbol; what equal substrings share; odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import fingerprint as fp
from veilspark.llm.queries import op11_document_fingerprints

ALL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


PLACE = [mixed(k * 0x9E3779B97F4A7C15 & ALL) for k in range(1, 17)]


def plain_colours(row):
    label = [x & 0xFFFFFFFF for x in row]
    for _ in range(4):
        new = []
        for i, x in enumerate(label):
            k = 0 if not i else ((x ^ label[i - 1]) & -(x ^ label[i - 1])).bit_length() - 1
            new.append(2 * k + (x >> k & 1))
        label = new
    for c in (5, 4, 3):
        label = [min({0, 1, 2} - {*label[max(i - 1, 0) : i], *label[i + 1 : i + 2]}) if x == c else x for i, x in enumerate(label)]
    return label


def plain_levels(text):
    """The phrases of every level as (name, the part of the text), and the one symbol at the end."""
    row, levels = [(ord(c), i, i + 1) for i, c in enumerate(text)], []
    while row:
        runs = []
        for x, a, b in row:
            if runs and runs[-1][0] == x:
                runs[-1][1:] = [runs[-1][1] + 1, runs[-1][2], b]
            else:
                runs.append([x, 1, a, b])
        row = [(x if n == 1 else mixed((x * 0xD1342543DE82EF95 + n) & ALL), a, b) for x, n, a, b in runs]
        if len(row) == 1:
            return levels, row[0][0]
        colour = plain_colours([x for x, _, _ in row])
        padded = [-1, *colour, -1]
        starts = [i for i in range(len(row)) if i == 0 or i > 1 and padded[i + 1] > max(padded[i], padded[i + 2])]
        levels.append([])
        for a, b in zip(starts, [*starts[1:], len(row)]):
            part = row[a:b]
            name = mixed((sum(mixed(x ^ PLACE[k]) for k, (x, _, _) in enumerate(part)) + len(levels)) & ALL)
            levels[-1].append((name, part[0][1], part[-1][2]))
        row = levels[-1]
    return levels, None


def plain_fingerprint(text):
    levels, whole = plain_levels(text)
    if whole is None:
        return "0" * 12
    least = 1 if len(text) < fp.SHORT else fp.LEVEL
    counted, out = {}, []
    for name in [mixed(whole ^ 0xA24BAED4963EE407), *(n for level in levels[least - 1 :] for n, _, _ in level)]:
        name >>= 16
        k = counted[name] = counted.get(name, -1) + 1
        out.append(name if not k else mixed((name + k * 0xD1342543DE82EF95) & ALL) >> 16)
    return ",".join(f"{x:012x}" for x in sorted(out)[: fp.SIZE])


def some_texts():
    rng = np.random.default_rng(11)
    texts = ["", "a", "ab", "aa", "aaaa", "aab", "abababab", "é日本\U0001f600\U0001f600", "x" * 5000, "ab" * 3000, "same text here", "same text here"]
    for n in (3, 10, 63, 64, 65, 300, 3000):
        texts += ["".join(rng.choice(list("abcde \n"), n)), "".join(rng.choice(list("ab"), n)), " ".join(rng.choice(["one", "two", "three"], n))]
    return texts


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_fingerprints_are_the_plain_version(monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    texts = some_texts()
    assert fp.fingerprints_of(texts) == [plain_fingerprint(t) for t in texts]
    assert [fp.fingerprints_of([t])[0] for t in texts] == fp.fingerprints_of(texts)


def test_colours_are_three_and_neighbours_differ():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    first = rng.random(5000) < 0.05
    first[0] = True
    c = fp.colours(x, first)
    assert set(c.tolist()) == {0, 1, 2} and ((c[1:] != c[:-1]) | first[1:]).all()


def test_equal_substrings_share_interior_names_at_any_offset():
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz    ")
    shared = "".join(rng.choice(letters, 4000))
    around = ["".join(rng.choice(letters, n)) for n in (0, 1, 7, 333, 50, 1211)]
    inside = []
    for before, after in zip(around, reversed(around)):
        levels, _ = plain_levels(before + shared + after)
        at = len(before)
        # an end of the substring reaches some ten symbols of each level inwards
        inside.append([{(n, a - at, b - at) for n, a, b in level if a - at >= 16 * 4**k and b - at <= 4000 - 16 * 4**k} for k, level in enumerate(levels[:3], 1)])
    assert all(x == inside[0] for x in inside) and all(len(s) > 50 for s in inside[0])


def test_likeness(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(n) for n in (40, 400, 4000)]
    rows = []
    for t in base:
        rows += [(t, t, 1.0, 1.0), (t, text(500), 0.0, 0.1), (t, t[: len(t) * 3 // 4] + text(len(t) // 20), 0.6, 0.85), (t, text(9) + t, 0.6, 1.0), (t, "", 0.0, 0.0)]
    rows += [("", "", 1.0, 1.0)]
    prints = [(*fp.fingerprints_of([a, b]), lo, hi) for a, b, lo, hi in rows]
    for r in spark.createDataFrame(prints, "a string, b string, lo double, hi double").select("*", fp.likeness(F.col("a"), F.col("b")).alias("x"), fp.likeness(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.lo <= r.x <= r.hi and r.x == r.y
        a, b = set(r.a.split(",")), set(r.b.split(","))
        least = sorted(a | b)[: fp.SIZE]
        j = len(set(least) & a & b) / len(least)
        assert r.x == pytest.approx(2 * j / (1 + j))


def check(out, docs):
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        gone = len(t) // 4
        e = t[: len(t) - gone] + n[:gone]
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), *fp.fingerprints_of([t, e, n])))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.next_fingerprint) for r in out.collect()) == sorted(want)


def test_edits_reach_over_partitions(spark):
    rng = np.random.default_rng(4)
    docs = [(int(i), "".join(rng.choice(list("abcé日 "), int(rng.integers(0, 400))))) for i in rng.permutation(300) * 7 - 500] + [(None, "no id"), (10**12, None), (10**13, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(fp.edited(df.repartition(5)), docs)
    check(fp.edited(df.coalesce(1)), docs)
    for few in (docs[:1], docs[:2], docs[:3]):
        check(fp.edited(spark.createDataFrame(few, "doc_id long, text string")), few)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(5, "same row here", "x", 1), (5, "same row here", "x", 1), (5, None, "y", 2), (6, long, "z", 3), (7, "", "z", 3), (8, "abc", None, None)] + [(9, "many of one id", "z", 4)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, _part int")
    out = {(r.doc_id, r.n_chars): r for r in fp.edited(df).collect()}
    assert fp.edited(df).count() == len(rows) and fp.edited(df.limit(0)).count() == 0
    # rows of one id come in the order of their hashes, equal rows beside each other
    assert out[8, 3].fingerprint == out[8, 3].edited_fingerprint and out[7, 0].fingerprint == "0" * 12
    assert fp.fingerprints(df).select("doc_id", "fingerprint").distinct().count() == 6
    assert out[6, len(long)].edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 4]).encode()).hexdigest()


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = op11_document_fingerprints(spark, sf_dir).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}
    check(fp.edited(docs), [tuple(r) for r in docs.collect()])
    by = {r.text: set() for r in docs.collect()}
    prints = {r.doc_id: r.fingerprint for r in rows}
    for r in docs.collect():
        by[r.text].add(prints[r.doc_id])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    long = [r for r in rows if r.n_chars >= 64]
    assert min(r.near_edited for r in long) > 0.5 and np.median([r.near_next for r in long]) < 0.1
