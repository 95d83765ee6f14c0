import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veilspark.functions import align, replacement
from veilspark.operators import compare, verify

SCHEMA = "pair_id long, left_text string, right_text string, labels array<struct<label:string,raw_label:string,known:boolean,start:int,end:int,text:string,placeholder:boolean>>"


def mark(text, value, label, known=True, placeholder=False):
    i = text.index(value)
    return (label, label, known, i, i + len(value), value, placeholder)


def test_alignment_is_longest_and_monotone():
    a, b = "the quick brown fox jumps over".split(), "a quick red fox leaps over it".split()
    x = align.Alignment(a, b)
    pairs = [(i, j) for i, j in enumerate(x.left) if j >= 0]
    assert [a[i] for i, _ in pairs] == ["quick", "fox", "over"] == [b[j] for _, j in pairs]


def test_stage_one(spark):
    left = "Dear team, Mr. Ravi Kumar lives here. Card 4111 1111 1111 1111 and mail asha@gmail.com ok"
    right = left
    labels = [mark(right, "Ravi Kumar", "Person Name"), mark(right, "4111 1111 1111 1111", "Aadhar Card No"), mark(right, "lives here", "Business Name"), mark(right, "ok", "Whatever", known=False)]
    df = spark.createDataFrame([(1, left, right, labels)], SCHEMA)
    got = {(r.category, r.label, r.right_label) for r in compare.compare(df).collect()}
    assert got == {("CORRECT", "Person Name", "Person Name"), ("WRONG_LABEL", "Credit/Debit Card No", "Aadhar Card No"), ("OVERSCRUB", "Business Name", "Business Name"), ("NEEDS_REVIEW", "Whatever", "Whatever"), ("MISSED", "Person Email", None)}
    todo = {(r.category, r.status, r.suggest, r.group) for r in compare.identify(compare.compare(df)).collect()}
    assert ("IDENTIFIED", "labeled", "yes", "PI") in todo and ("CRED_TODO", "wrong", "yes", "CRED") in todo and ("NOT_PII", "extra", "not", None) in todo


@pytest.mark.parametrize("right,category,label", [
    ("Mr. Ravi Kumar called", "LEAKAGE", "Person Name"), ("Mr. Arun Shah called", "REDACTED_OK", "Person Name"), ("Mr. [NAME] called", "NOT_SENSIBLE", "Person Name"),
    ("Mr. Ravi Shah called", "LEAKAGE", "Person Name"), ("Mr. Arun Shah phoned", "INCOHERENT", "Person Name"), ("Mr. 12345678 called", "DATATYPE", "Person Name"), ("Mr. Arun Shah called twice", "UNKNOWN_TEXT", None),
])
def test_stage_two(spark, right, category, label):
    df = spark.createDataFrame([(1, "Mr. Ravi Kumar called", right, [])], SCHEMA)
    assert (category, label) in {(r.category, r.label) for r in verify.verify(df).collect()}


def test_quality_expressions(spark):
    rows = spark.createDataFrame([("Person Phone No", "+91 9876012345", "+91 9876010000"), ("Person Phone No", "+91 9876012345", "+91 8123498761"), ("Person Name", "Ravi", "xxxx"), ("IP/MAC Address", "1.2.3.4", "fe80::1"), ("IP/MAC Address", "1.2.3.4", "999.1.1.1")], "l string, o string, r string")
    got = rows.select(replacement.digits_kept(F.col("l"), F.col("o"), F.col("r")).alias("k"), replacement.not_sensible(F.col("r")).alias("w"), replacement.same_type(F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.k for r in got] == ["987601", None, None, None, None]
    assert got[2].w and not got[0].w and [r.s for r in got[3:]] == [True, False]


def test_entry_and_sql(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    con = duckdb.connect()
    for t in "nation customer orders lineitem events documents pages benchmark labels conversations embeddings".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    from veilspark import catalog

    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    for name, sql in catalog.SQL.items():
        want = con.sql(sql)
        got = catalog.QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        values = lambda rows, names: sorted((plain([r[names.index(c)] for c in columns]) for r in rows), key=str)
        assert values(got.collect(), got.columns) == values(want.fetchall(), want.columns), name
