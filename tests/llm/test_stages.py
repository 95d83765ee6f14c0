"""Every stage of the pipeline over nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import pytest

import corpus_pipeline

NAMES = "doc_id long, text string, n_chars long, n_words long, n_removed long, is_toxic boolean, p_toxic double, component_id long, _rest string, _part int, start int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stages"))
    known = [(1000 + i, i % 2) for i in range(40)]
    spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30))), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    copy, passage = " ".join(f"c{i}" for i in range(40)), " ".join(f"p{i}" for i in range(20))
    texts = [(1, None), (2, ""), (3, " \n"), (4, copy), (5, copy), (6, copy), (7, long), (8, "before " + passage), (9, passage + " after it"), (10, passage), (None, "no id here at all"), (11, "same row"), (11, "same row"), (12, "x " + " ".join(f"b{i}" for i in range(30)))]
    texts += [(1000 + i, f"row {i} says " + ("vile rotten things" if i % 2 else "nice warm things")) for i in range(40)]
    return spark.createDataFrame([(d, t, len(t or ""), 77, 88, True, 0.5, 99, "r", 3, 4) for d, t in texts], NAMES)


def test_each_stage(spark, docs, folder):
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {(r.n_words, r.n_removed, r.is_toxic, r.p_toxic, r.component_id, r._rest, r._part, r.start) for r in rows} == {(77, 88, True, 0.5, 99, "r", 3, 4)}, name
        kept[name] = rows
        assert stage(spark, docs.limit(0), folder).count() == 0
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    for name in ids:  # nulls, blanks, rows without an id and repeated rows stay
        assert {1, 2, 3, 7, 8, None} <= set(ids[name]) and ids[name].count(11) == 2, name
    assert not {1000 + i for i in range(1, 40, 2)} & set(ids["toxicity"]) and {1000 + i for i in range(0, 40, 2)} <= set(ids["toxicity"])
    assert 4 in ids["ngram_jaccard_join"] and not {5, 6} & set(ids["ngram_jaccard_join"])
    text = {r.doc_id: (r.text, r.n_chars) for r in kept["substring_dedup"]}
    assert 10 not in text and 5 not in text and text[9] == ("after it", 8) and text[8][0].endswith("p19") and text[1] == (None, 0)
    assert 12 not in ids["benchmark_decontamination"] and {4, 5, 6} <= set(ids["benchmark_decontamination"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    n = {}
    for r in pieces.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    assert n[1] == n[2] == 1 and set(n) == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_whole_run_on_empty_tables(spark, docs, folder, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
