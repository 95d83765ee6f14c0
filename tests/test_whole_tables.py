"""Queries of the catalog judge all rows of their tables."""

import numpy as np
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import rowmatch


def documents(spark, folder, *texts):
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")


def test_documents_of_any_length(spark, tmp_path):
    said = [f"row number{i} has words like word{i}x and word{i}y of its own" for i in range(300)]
    documents(spark, tmp_path, "\n".join(said), said[0], "\n".join(said[:3]), "", None, "abc " * 500)
    spark.createDataFrame([(7, "abc")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in catalog.QUERIES["similar_rows"](spark, str(tmp_path)).collect()] == [(5, 7, 1.0)]
    rows = catalog.QUERIES["reordered_rows"](spark, str(tmp_path)).groupBy("pair_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("r")).collect()
    assert {r.pair_id: r.n for r in rows} == {0: 300, 1: 1, 2: 3, 5: 1}
    assert [x.text for x in next(r.r for r in rows if r.pair_id == 0)] == said
    whole = {r.task_id: r.text for r in catalog.QUERIES["assembled_documents"](spark, str(tmp_path)).orderBy("seq").collect()}
    assert whole["0"] == "\n".join(said) and whole["1"] == said[0]


def test_partners_are_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(300):
        left, right = ([frozenset(rng.choice(list("abcdefghijklmnop"), rng.integers(0, 9))) for _ in range(12)] for _ in range(2))
        assert rowmatch.partners(left, right) == [[(s, i) for i, a in enumerate(left) if (s := rowmatch.alike(a, b))] for b in right]


def test_long_lines_count_by_the_sentence(spark, tmp_path):
    german, english = "Das ist nicht die Zeile für dich und mich.", "This is a line with the usual words for you."
    documents(spark, tmp_path, german + "\n" + english, " ".join([german] * 12 + [english] * 3), None)
    assert {r.language: r.lines for r in catalog.QUERIES["line_languages"](spark, str(tmp_path)).collect()} == {"German": 13, "English": 4}


def test_all_replacements_are_judged(spark, tmp_path):
    rows = [(0, "A", "B"), (1, "A", "B"), (2, "A", "B"), (3, "A", "BUILDING"), (4, "Customer#000000004", "B"), (8, "A", "xxxx"), (9, "[NAME]", "B"), (14, "unknown", "B")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.why for r in catalog.QUERIES["sensible_replacements"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {k for k, why in got.items() if why is None} == {3, 4}
    assert got[8] == '"xxxx" is masked, not realistic text' and got[14] == '"unknown" is not a realistic value'


def test_spans_whose_best_partners_tie_keep_a_row(spark, tmp_path):
    # of one order: line 2 from 10 to 16; lines 1, 7 and 3 begin at 10 as well and end later, two of them at once
    lines = [(1, 10, 5.0, 2), (1, 10, 20.0, 1), (1, 10, 9.0, 7), (1, 10, 9.0, 3)]
    spark.createDataFrame([(*x, 0.0) for x in lines], "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["interval_best_overlap"](spark, str(tmp_path)).select("start", "end", "b_start", "b_end", "b_label", "overlap").collect()
    assert [tuple(r) for r in got] == [(10, 16, 10, 20, "Person Email", 6)]
