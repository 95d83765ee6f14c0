"""Phrases, dictionary names, leaks and repeats of names against plain versions, over texts put together by chance."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import align, known, people
from veilspark.operators import lexicon
from veilspark.plans import phrases

WORD = re.compile(r"[^\W_]+|[^\s\w]|_")


def plain_places(text, toks):
    own = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]
    return [(own[i][1], own[i + len(toks) - 1][2]) for i in range(len(own) - len(toks) + 1) if [t for t, _, _ in own[i : i + len(toks)]] == toks]


@pytest.mark.parametrize("most", [1 << 24, 1])
def test_phrases_are_found_wherever_they_stand(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST", most)
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "C", "dd", "é", ".", "-"])
    docs = [(k, k % 5, rng.choice([" ", "", "\n "]).join(word() for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(40, 1, None), (41, 2, "")]
    own = sorted({tuple(word().lower() for _ in range(rng.randint(1, 4))) for _ in range(40)})
    df, table = spark.createDataFrame(docs, "row long, doc int, text string").repartition(3), spark.createDataFrame([(list(p), k) for k, p in enumerate(own)], "toks array<string>, p int")
    want = sorted((r, k, *place) for r, _, t in docs for k, p in enumerate(own) for place in plain_places(t, list(p)))
    assert sorted((r.row, r.p, r.start, r.end) for r in phrases.found(df, table, []).collect()) == want
    # phrases of documents of their own
    mine = spark.createDataFrame([(list(p), k, d) for k, p in enumerate(own) for d in range(5) if (k + d) % 3 == 0], "toks array<string>, p int, doc int")
    group = {r: d for r, d, _ in docs}
    assert sorted((r.row, r.p, r.start, r.end) for r in phrases.found(df, mine, ["doc"]).collect()) == [x for x in want if (x[1] + group[x[0]]) % 3 == 0]
    assert phrases.found(df, table.limit(0), []).count() == 0 and phrases.found(df.limit(0), table, []).count() == 0


def test_cover_walks_from_left_to_right(spark):
    rng = random.Random(2)
    rows = [(d, a := rng.randint(0, 60), a + rng.randint(1, 6), rng.randint(0, 3)) for d in range(20) for _ in range(40)]
    got = phrases.cover(spark.createDataFrame(rows, "doc int, start int, end int, o int").distinct(), ["doc"], [F.col("o"), F.col("end")]).collect()
    for d in range(20):
        free, want = 0, []
        for a, o, z in sorted({(a, o, z) for x, a, z, o in rows if x == d}):
            if a >= free:
                want.append((a, z, o))
                free = z
        assert sorted((r.start, r.end, r.o) for r in got if r.doc == d) == want


NAMES = [("Bank of India", "banks"), ("Bank of Baroda", "banks"), ("Procter & Gamble", "fmcg"), ("Levi's", "clothes"), ("IBM", "it"), ("Infosys", "it"), ("Infosys Ltd", "it"), ("AT&T", "telecom"), ("Max Life", "x"), ("Max Life Insurance", "x")]


def test_dictionary_names_are_the_plain_ones(spark):
    rng = random.Random(3)
    own = ["Bank of India", "BANK OF BARODA", "bank of india", "Bank  of\nIndia", "Procter and Gamble", "Procter & Gamble", "Procter&Gamble", "Levi’s", "LEVI'S", "IBM", "Ravi IBM", "The IBM", "xIBM", "IBMs", "Infosys", "Infosys Ltd", "Infosys Limited.",
           "Infosys Technologies Pvt Ltd", "AT&T", "AT & T", "Max Life Insurance", "Max Life", "MAX LIFE", "Ltd", "and", "of", ".", "é", "Pvt. Ltd."]
    docs = [(k, "".join(rng.choice(own) + rng.choice([" ", ", ", "\n", "", ". "]) for _ in range(rng.randint(0, 15)))) for k in range(400)] + [(400, None), (400, "IBM"), (400, "IBM")]
    dictionary = known.Dictionary([(n, c) for n, c in NAMES])
    table = spark.createDataFrame([(n, c, k) for k, (n, c) in enumerate(NAMES)], "name string, category string, place int")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, name string")
    got = sorted(map(tuple, lexicon.known_names(df, table).collect()))
    want = sorted((i, k.start, k.end, k.text, k.name, k.category) for i, t in docs for k in dictionary.find(t or ""))
    assert got == want and len(got) > 500
    values = own + [" IBM ", "", None, "infosys ltd ltd ltd", "INFOSYS, ", "Levi’s Inc"]
    looked = {r.text: (r.known_name, r.known_category) for r in lexicon.lookup(spark.createDataFrame([(v,) for v in values], "text string"), lexicon.dictionary_of(table)).collect()}
    for v in values:
        hit = dictionary.by_key.get(known.key(v)) if v is not None and known.key(v) else None
        assert looked[v] == (hit or (None, None)), v


def test_built_in_dictionary_and_many_entries(spark):
    names = list(known.entries(json.loads(known.BUILT_IN))) + [(f"Company {k} of Nowhere", "made") for k in range(20000)]
    table = spark.createDataFrame([(n, c, k) for k, (n, c) in enumerate(names)], "name string, category string, place int")
    got = lexicon.known_names(spark.createDataFrame([(1, "HDFC Bank bought Company 777 of Nowhere Ltd and COMPANY 19999 OF NOWHERE")], "doc_id int, text string"), table).orderBy("start").collect()
    assert [r.text for r in got] == ["HDFC Bank", "Company 777 of Nowhere Ltd", "COMPANY 19999 OF NOWHERE"]


def test_leaks_are_the_plain_ones(spark):
    rng = random.Random(4)
    values = ["Ravi Kumar", "@ravi", "user@gmail.com", "10.0.0.1", "ab", "Kumar", "RAVI kumar", "555-1234"]
    found, rights = [], []
    for k in range(80):
        for n, v in enumerate(rng.sample(values, rng.randint(0, 6))):
            found.append((k, n, n * 20, n * 20 + len(v), f"L{n % 3}", rng.choice([0.9, 0.8, 0.5]), v))
        rights.append((k, "".join(rng.choice(values + ["x", "and", "ravi", "é"]) + rng.choice([" ", "", ", ", "-"]) for _ in range(rng.randint(0, 12)))))
    rights.append((99, None))
    got = lexicon.leaks(spark.createDataFrame(found, "pair_id long, ord int, start int, end int, label string, confidence double, text string"), spark.createDataFrame(rights, "pair_id long, right_text string")).collect()
    want = []
    for k, text in rights:
        toks, by = align.tokens(text or ""), {}
        for _, n, a, z, label, sure, v in [f for f in found if f[0] == k]:
            key = tuple(t.low for t in align.tokens(v))
            if sure >= 0.7 and len(re.findall("[A-Za-z0-9_]", v)) >= 3 and key not in by:
                by[key] = (label, v, a, z)
        j = 0
        while j < len(toks):
            for key, hit in by.items():
                place = toks[j : j + len(key)]
                around = (text[place[0].start - 1 : place[0].start] if place[0].start else "") + text[place[-1].end : place[-1].end + 1]
                if tuple(t.low for t in place) == key and not re.search(r"[^\W_]", around):
                    want.append((k, *hit, place[0].start, place[-1].end, text[place[0].start : place[-1].end]))
                    j += len(key) - 1
                    break
            j += 1
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_repeats_are_the_plain_ones(spark):
    rng = random.Random(5)
    words = ["Ravi", "Kumar", "Sharma", "Al", "K.", "the", "Mr. ", "and", "Ravix", "Bank", "\n", "Asha"]
    docs, found, want = [], [], []
    for k in range(120):
        text = rng.choice(["Mr. Ravi Kumar Sharma came. ", "Ms. Asha K. saw Dr. Ravi Kumar. ", "Mr. Al Bank here. ", "", "Name: Sharma\n"]) + "".join(rng.choice(words) + rng.choice([" ", "", "  ", ", "]) for _ in range(rng.randint(0, 25)))
        docs.append((k, text))
        own = [s for s in people.names(text) if not s.rule.startswith("name-repeat")]
        found += [(k, s.start, s.end, s.confidence, s.text) for s in own]
        want += [(k, s.start, s.end, s.confidence, s.rule, s.text) for s in people._repeats(text, own)]
    got = lexicon.repeated_names(spark.createDataFrame(found, "doc_id long, start int, end int, confidence double, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
