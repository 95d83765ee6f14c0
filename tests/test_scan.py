"""Structured rules as expressions: the same spans as the rules one by one in Python, over texts put together by chance."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark import made
from veilspark.functions import rules, scan, spans
from veilspark.functions import sqltext as Q
from veilspark.operators import detect
from veilspark.operators import scan as structured

PIECES = [
    "XX XX XX 1234", "****1234", "IBAN GB82 WEST 1234 5698 7654 32 AND MORE", "DE89370400440532013000", "pan AAAPL1234C", "user: foo@bar", "login = http://x", "password is hunter2)", "(password: (abc))",
    "phone: 98xxxx1234", "ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABAQ= me@host", "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "my mobile our +91 98765 43210", "customer support 080-2345 6789",
    "fe80::1:2", "1:2:3:4:5:6:7:8", "::", "a:b:c", "﷐token = \"abcdefgh1234﷑\"", "Visa 4111-1111-1111-1111 exp 12/25", "pin 123456", "mpin: 12ab", "one time otp 1234.", "mother's maiden name: Smith", "\n", "  ",
    "é日本 \U0001f600", "token", "card", "bank a/c", "aws 123456789012", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2", "request id: abc123-def456-7890", "dl no: KA01 20110012345", "EPIC ABC1234567", "ravi@okaxis.", "@handle.",
    "sha256:" + "ab12" * 16, "0x" + "0f" * 32, "deadbeef00" * 4, "00aa.11bb.22cc", "sk-" + "a1B2" * 6, "sk_live_" + "a1" * 9, "ghp_" + "a1" * 18, "AIza" + "a" * 35, "xoxb-" + "1a" * 6, "verification code is 4711",
    "aadhaar XXXX XXXX 1234", "visa card **1234", "card token: ab12cd34ef56", "MY OFFICE FAX 011 2345 6789", "AKIA" + "A1" * 8, "UPI x.y@bank", "98xxx x1234",
]


def texts(n, seed):
    rng, db = random.Random(seed), duckdb.connect()
    own = list(PIECES)
    for cases in made.DETECTED.values():
        for before, value, after, _ in cases:
            own += [before + db.execute(f"select {value} from (select {k} as n)").fetchall()[0][0] + after for k in (0, 17, 98765)]
    return [(i, "".join(rng.choice(own) + rng.choice([" ", "\n", ", ", "", ". "]) for _ in range(rng.randint(0, 14)))) for i in range(n)]


def plain(rows, only=tuple(rules.STRUCTURED)):
    out = []
    for i, t in rows:
        found = [s for d in rules.STRUCTURED if d in only for s in rules.find(d, t or "")]
        out += [(i, k, s.start, s.end, s.label, s.confidence, s.source, s.rule, s.text) for k, s in enumerate(spans.disjoint(spans.once(found)))]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_all_detectors_are_the_plain_ones(spark, seed):
    rows = texts(600, seed)
    want = plain(rows)
    assert sorted(map(tuple, structured.detections(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())) == want
    if seed == 1:  # every rule is met, alone or among others
        alone = {r[7] for d in rules.STRUCTURED for r in plain(rows, (d,))}
        assert {r.id for own in rules.STRUCTURED.values() for r in own} <= alone | {"email-business"}


def test_one_detector_needs_no_python(spark):
    df = spark.createDataFrame(texts(200, 3), "doc_id long, text string")
    for only in (("card",), ("account", "aadhaar", "phone")):
        out = detect.detections(df, only=only)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 1
        assert sorted(map(tuple, out.collect())) == plain(texts(200, 3), only)


def test_odd_rows(spark):
    many = " ".join(f"10.0.{k // 250}.{k % 250}" for k in range(20000))
    rows = [(1, None), (2, ""), (3, "10.0.0.1"), (3, "10.0.0.1"), (None, "at 10.0.0.1"), (4, many), (5, "﷐" * 3 + "10.0.0.1﷐ 10.0.0.2")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, _row int, start string")
    got = structured.detections(df).collect()
    assert [r.start for r in got if r.doc_id == 3] == [0, 0] and [r.start for r in got if r.doc_id is None] == [3]
    own = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.ord)
    assert [(r.start, r.text) for r in own] == [(s.start, s.text) for s in rules.find("address-ip", many)] and len(own) == 20000
    assert [(r.start, r.text) for r in got if r.doc_id == 5] == [(3, "10.0.0.1"), (13, "10.0.0.2")]
    assert structured.detections(df.limit(0)).count() == 0


def test_settling_long_runs(spark):
    rng = random.Random(4)
    labels = ["IP/MAC Address", "Account Number", "Card ID", "Person Name"]
    rows = []
    for d in range(30):
        for k in range(80):
            a = rng.randint(0, 300)
            rows.append((d, a, a + rng.randint(1, 12), rng.choice(labels), rng.choice([0.5, 0.7, 0.9]), k, f"r{k}", "t"))
    got = structured.settled(spark.createDataFrame(rows, "doc_id long, start int, end int, label string, confidence double, number int, rule string, text string"), ["doc_id"]).collect()
    for d in range(30):
        own = [spans.Span(r[1], r[2], r[3], r[4], "regex", r[6], "t") for r in rows if r[0] == d]
        assert sorted((r.ord, r.start, r.end, r.label, r.confidence, r.rule) for r in got if r.doc_id == d) == [(k, s.start, s.end, s.label, s.confidence, s.rule) for k, s in enumerate(spans.disjoint(spans.once(own)))]


def test_sums_by_blocks(spark):
    for n in (1, 63, 64, 65, 1000):
        values = [(k * 7) % 11 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        assert df.select(F.expr(scan.starts_of(Q.col("v")).sql).alias("s")).first().s == [sum(values[:k]) for k in range(n)]


def test_text_of_expressions(spark):
    df = spark.createDataFrame([("it's \\ a \"q\"\n", 3)], "s string, n int")
    x = Q.when(Q.col("n") > 2, Q.concat(Q.col("s"), "'\\n")).when(Q.col("n").isin(1, 2), "b").otherwise(None)
    assert df.select(F.expr(x.sql).alias("x")).first().x == "it's \\ a \"q\"\n'\\n"
    y = Q.aggregate(Q.transform(Q.array(1, 2, -3), lambda v, i: v * 2 + i), Q.lit(0), lambda a, v: a + v)
    assert df.select(F.expr(y.sql).alias("y"), F.expr((~(Q.lit(1.5) >= 2) & (-Q.col("n") == -3)).sql).alias("z")).first() == (3, True)
