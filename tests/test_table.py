"""Detectors as table functions: over relations of any columns, with and without partitions."""

import re

import pytest

from veilspark.functions.table import register_detector


@pytest.fixture(scope="module")
def docs(spark):
    spark.createDataFrame([(1, "a", "x12 345"), (2, "b", None), (3, "a", ""), (4, "b", "é345 12 12"), (5, "a", "12")], "id int, lang string, body string").createOrReplaceTempView("docs_of_table_test")


def test_over_any_relation(spark, docs):
    register_detector(spark, "find_numbers", "Number", lambda t: [(*m.span(), 2.0) for m in re.finditer("[0-9]+", t)] + [(5, 2, 0.5), (0, 10**6, 0.5)])
    got = spark.sql("select * from find_numbers(table(docs_of_table_test), text => 'body') order by id, start")
    assert got.columns == ["id", "lang", "start", "end", "label", "confidence", "found"]
    assert [(r.id, r.lang, r.start, r.end, r.label, r.confidence, r.found) for r in got.collect()] == [
        (1, "a", 1, 3, "Number", 0.99, "12"), (1, "a", 4, 7, "Number", 0.99, "345"), (4, "b", 1, 4, "Number", 0.99, "345"), (4, "b", 5, 7, "Number", 0.99, "12"), (4, "b", 8, 10, "Number", 0.99, "12"), (5, "a", 0, 2, "Number", 0.99, "12"),
    ]
    assert spark.sql("select f.found, count(*) as n from find_numbers(table(select id, upper(body) as body from docs_of_table_test), text => 'body') f group by f.found").count() == 2


def test_what_a_detector_keeps_is_of_its_partition(spark, docs):
    def once():
        seen = set()

        def find(text):
            out = [(*m.span(), 0.8) for m in re.finditer("[0-9]+", text) if m[0] not in seen and not seen.add(m[0])]
            return out

        return find

    register_detector(spark, "find_new_numbers", "Number", per_partition=once)
    got = spark.sql("select lang, id, found from find_new_numbers(table(docs_of_table_test) partition by lang order by id, text => 'body')").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "12"), ("a", 1, "345"), ("b", 4, "12"), ("b", 4, "345")]


def test_errors_are_told_when_a_query_is_analysed(spark, docs):
    register_detector(spark, "find_nothing", "Number", lambda t: [])
    for query in ("table(docs_of_table_test), text => 'text'", "table(select 1 as start, 'x' as body), text => 'body'"):
        with pytest.raises(Exception, match="find_nothing"):
            spark.sql(f"select * from find_nothing({query})").collect()
