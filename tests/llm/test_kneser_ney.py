import math
import zlib
from collections import Counter, defaultdict

import pytest

from veilspark.llm import kneser_ney as kn
from veilspark.llm.queries import op5_lm_scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*((text or "").translate(LOWER).encode().split()), "end"]


class Brute:
    """The formulas over plain dictionaries."""

    def __init__(self, texts):
        self.c, self.one = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(zip(["begin", *w], w))
            self.one.update(w)
        self.n = sum(self.one.values())
        self.follow, self.before = defaultdict(list), Counter()
        for (v, w), c in self.c.items():
            self.follow[v].append(c)
            self.before[w] += 1
        self.d = kn.discounts(*(sum(c == k for c in self.c.values()) for k in (1, 2, 3, 4)))
        self.e = kn.discounts(*(sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)))
        self.spare = sum(self.e[min(c, 3)] for c in self.before.values()) / len(self.c)

    def p(self, v, w):
        b = self.before[w]
        single = max(b - self.e[min(b, 3)], 0) / len(self.c) + self.spare / (len(self.one) + 1)
        if v not in self.follow:
            return single
        c, total = self.c[v, w], sum(self.follow[v])
        return max(c - self.d[min(c, 3)], 0) / total + sum(self.d[min(x, 3)] for x in self.follow[v]) / total * single

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(v, x)) for v, x in zip(["begin", *w], w))

    def base(self, text):
        return sum(math.log10((self.one[w] + 1) / (self.n + len(self.one) + 1)) for w in tokens(text))


def test_probabilities_sum_to_one():
    model = Brute(["a b a b c", "a c", "b b b", None, "d e f g"])
    words = [*model.one, "unseen"]
    for v in ["begin", "a", "b", "nowhere"]:
        assert sum(model.p(v.encode() if v not in ("begin",) else v, w) for w in words) == pytest.approx(1)


def test_query_is_the_formulas_over_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    model = Brute([t for d, t in docs.items() if not held[d]])
    rows = op5_lm_scoring(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    gain = 0.0
    for r in rows:
        w = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(model.one[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(model.base(docs[r.doc_id]), rel=1e-9)
        assert r.score == pytest.approx(model.score(docs[r.doc_id]), rel=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_are_the_formulas(spark, order):
    """Any order against the recursion over plain dictionaries."""
    import numpy as np

    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 30), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])) for _ in range(60)] + [None]
    tops = Counter()
    for t in texts:
        w = ["begin"] * (order - 1) + tokens(t)
        tops.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    counts = {order: dict(tops)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: kn.discounts(*(sum(c == x for c in counts[k].values()) for x in (1, 2, 3, 4))) for k in counts}
    vocabulary, types = len(counts[1]), sum(counts[1].values())
    spare = sum(d[1][min(c, 3)] for c in counts[1].values()) / types

    def p(gram):
        k = len(gram)
        c = counts[k].get(gram, 0)
        if k == 1:
            return max(c - d[1][min(c, 3)], 0) / types + spare / (vocabulary + 1)
        led = [x for g, x in counts[k].items() if g[:-1] == gram[:-1]]
        lower = p(gram[1:])
        return max(c - d[k][min(c, 3)], 0) / sum(led) + sum(d[k][min(x, 3)] for x in led) / sum(led) * lower if led else lower

    asked = [*texts[:8], "a b zz c a a", "g g g g g", None]
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order=order)
    got = kn.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for r in got:
        w = ["begin"] * (order - 1) + tokens(asked[r.doc_id])
        want = sum(math.log10(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w)))
        assert r.score == pytest.approx(want, rel=1e-9), r.doc_id


def test_a_missing_shard_is_an_error(spark, tmp_path):
    import os

    model = kn.train(spark.createDataFrame([("a b c",)], "text string"))
    kn._shard.cache_clear()
    os.rename(f"{model.folder}/1-0", f"{model.folder}/away")
    with pytest.raises(Exception, match="1-0"):
        [kn._shard(f"{model.folder}/1-{k}") for k in range(model.about["shards"])]


def test_nothing_to_learn_from_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "a b", 0.7), (None, "", 0.1)], "doc_id long, text string, score double")
    out = kn.score(docs, kn.train(docs.limit(0))).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 3] and all(r.score == 0 and r.n_known == 0 for r in out)
    assert kn.score(docs.limit(0), kn.train(docs)).count() == 0


def test_large_counts_survive_storage(tmp_path):
    import numpy as np

    h = np.array([3, 9, 27, 81], np.uint64)
    kn._store(str(tmp_path), "x", h, np.array([1, 255, 70000, 254]), np.array([2**40, 0, 1, 300]))
    got = kn.Shard(f"{tmp_path}/x").find(np.array([3, 4, 9, 27, 81, 99], np.uint64))
    assert got[0].tolist() == [1, 0, 255, 70000, 254, 0] and got[1].tolist() == [2**40, 0, 0, 1, 300, 0]
