"""Pairs and reports read a text once, and say the same of it."""

import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from veilspark.functions import addresses, known, language, people
from veilspark.operators import analyze, compare, verify

WORDS = ["the", "der", "und", "le", "aap", "a1-b2c", "x9@zz.", "K1L2;", "{a=1};", "foo()", "§§§", "12.5%", "x" * 45, "name:", "Straße", "é", "end."]


def texts(n=400):
    rng = random.Random(4)
    odd = ["", None, " ", "\n", "." * 450, "?" * 500 + "\nthe house and the garden", "x" * 300, "\t" + "word " * 130, "{a=1};\n" * 80, "a\n" * 200]
    return odd + ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", ": ", "\x0b", "  "]) for _ in range(rng.choice([10, 90, 200]))) for _ in range(n)]


def plain_reasons(t):
    """Word by word, as the reference goes."""
    t = (t or "").strip(" ")
    kind = lambda c: unicodedata.category(c)[0]
    if len(t) < 300:
        return []
    space = r"[ \t\n\x0b\f\r]"
    words, bare = re.split(space + "+", t), re.sub(space, "", t)
    symbols = sum(kind(c) not in "LN" and c not in ".,:;'\"()?!-" for c in bare) / max(len(bare), 1)
    long = sum(len(w) > 40 for w in words)
    mixed = sum(len(w) >= 5 and any(kind(c) == "L" for c in w) and re.search("[0-9]", w) is not None and any(kind(c) not in "LN" for c in re.sub(r"[.,;:]\Z", "", w)) for w in words)
    code = len(re.findall(r"(?m)[{}<>;=]|=>|\(\)|</?\w+>|^\s*[\w$]+\s*[:=]\s*[\[{]", t, re.A))
    ends, lines = len(re.findall(rf"[.!?](?:{space}|\Z)", t)), [x for x in t.split("\n") if x.strip(" ")]
    fields = sum(re.search(rf"^[^:]{{1,40}}:{space}*[^ \t\n\x0b\f\r]", x) is not None for x in lines)
    said = [
        (symbols > 0.18, f"{int(symbols * 100 + 0.5)}% symbols"), (long >= 3 or long / len(words) > 0.02, "long runs of characters without spaces"),
        (mixed / len(words) > 0.12, "many garbled words mixing letters, digits and symbols"), (code / len(words) > 0.15, "looks like code, markup or a data dump"),
        (ends < len(t) / 600 and fields < len(lines) * 0.3 and len(words) > 120, "almost no sentences or form fields"),
    ]
    return [x for yes, x in said if yes]


def test_reports_read_a_text_once(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("the house").alias("text"))
    plan = language.document_report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Join" not in plan and "Window" not in plan


def test_reasons_are_the_plain_ones(spark):
    said = texts()
    got = language.document_report(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).select("doc_id", "reasons").collect()
    want = {k: plain_reasons(t) for k, t in enumerate(said)}
    assert {r.doc_id: r.reasons for r in got} == want and {len(x) for x in want.values()} >= {0, 1, 2, 3}


def test_each_row_has_its_report(spark):
    rows = [(1, "le chat et la souris dans les champs\n\nthe house of the people"), (1, None), (2, "\n \n"), (3, "." * 500), (None, "the house of the people")]
    got = language.document_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 1, 3: 1, None: 1}
    by = {r.doc_id: r for r in got}
    assert (by[1].verdict, by[1].main_language, by[2].verdict, by[3].total_letters, by[3].languages, by[None].verdict) == ("other", "French", "english", 0, None, "english")


def test_both_stages_see_a_pair_once(spark, monkeypatch):
    calls = []
    for module in (compare, verify):
        real = module.pair_rows
        monkeypatch.setattr(module, "pair_rows", lambda *a, real=real: calls.append(1) or real(*a))
    left = "Write to ann@gmail.com or call +44 20 7946 0018 now. Mr. Ravi Kumar said so."
    pairs = spark.createDataFrame([(1, left, left.replace("ann@gmail.com", "bob@yahoo.com")), (2, left, left), (3, None, "")], "pair_id long, left_text string, right_text string")
    out = analyze.analyze(pairs, labels=None)
    assert len(calls) == 1
    for got, want in ((out["L1"], compare.identify(compare.compare(pairs, labels=None))), (out["L2"].drop("moved"), verify.verify(pairs))):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_words_are_made_near_anchors_alone(monkeypatch):
    made = []

    class Counted(addresses.Word):
        def __post_init__(self):
            made.append(self.raw)
            super().__post_init__()

    monkeypatch.setattr(addresses, "Word", Counted)
    text = "one two three " * 2000 + "Flat 4, 4th Cross Road, Bengaluru 560038. " + "four five six " * 2000
    assert [s.text for s in addresses.addresses(text)] == ["Flat 4, 4th Cross Road, Bengaluru 560038"] and len(made) < 50


def test_anchors_are_those_of_the_words():
    rng = random.Random(6)
    few = "Road road RD St. st. (St) \"St\" Sector 21 5th Block C No. 560038 560 12/4 Bengaluru a(Road Road) BlocK Hwy; PIN ‘Main’ (110 x".split(" ")
    for _ in range(3000):
        text = "".join(rng.choice(few) + rng.choice([" ", " ", "\n", ", ", "\t", " ", ""]) for _ in range(rng.randint(1, 12)))
        words = addresses.Words(text)
        every = [k for k in range(len(words)) if addresses._anchors(words, k, text)]
        assert set(every) <= set(words.anchors())


def test_companies_are_not_sought_without_their_words(monkeypatch):
    class Never:
        def finditer(self, text):
            raise AssertionError

    monkeypatch.setattr(people, "_SUFFIXED", Never())
    monkeypatch.setattr(people, "_COMPANY_FIELD", Never())
    assert people.companies("We went over the hill. Ravi Kumar saw Two Rivers in the valley. " * 20) == []


def test_public_names_are_sought_where_words_changed(monkeypatch):
    monkeypatch.setattr(known, "find", lambda text, extra=(): 1 / 0)
    text = "We went to Infosys over the hill."
    assert verify.Walk(compare.Pair(text, text, [])).all() == []


def test_repeats_of_few_names_are_sought_and_are_the_same(monkeypatch):
    rng = random.Random(8)
    few = "Mr. Ravi Kumar O'Brien Rao-Patil R. Ravi. Raviji xRavi Kumar,Dr Asha Shah Ravi\nRavi é éRavi Ravié Mrs. Lu Verma_ _Asha".split(" ")
    said = [" ".join(rng.choice(few) for _ in range(rng.choice([6, 20, 60]))) for _ in range(1000)]
    got = [people.names(t) for t in said]
    monkeypatch.setattr(people, "FEW_NAMES", -1)
    assert got == [people.names(t) for t in said] and sum(s.rule.startswith("name-repeat") for x in got for s in x) > 1000
