"""Kernels of rows: what is told once, by batches and by sorted reads is what is told one by one."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilspark.functions import rowmatch
from veilspark.operators import colours, lexicon
from veilspark.plans import phrases
from veilspark.streaming import assemble


def test_assembled_reads_run_through_sorted_without_groups(spark):
    rows = lambda *texts: json.dumps([{"text": t, "words": [], "para": False} for t in texts])
    line = lambda k: f"line number {k} of the document, with words"
    reads = [(f"t{t}", seq, "left", "", rows(*(line(10 * t + k) for k in range(at, at + 3)))) for t in range(40) for seq, at in ((2, 3), (0, 0), (1, 1))]
    reads = spark.createDataFrame([*reads, (None, 0, "left", "", rows(line(1), line(2)))], assemble.READ)
    out = assemble.assemble_batch(reads)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    last = {r.task_id: r for r in out.orderBy("seq").collect()}
    assert len(last) == 41 and last[None].n_rows == 2
    assert all(last[f"t{t}"].text == "\n".join(line(10 * t + k) for k in range(6)) and last[f"t{t}"].pieces == 1 for t in range(40))


def test_lines_are_near_by_digits_and_pairs_of_letters():
    assert rowmatch.key("Straße_Nº 5, ½ ﬁx!") == "straßeno512fix"
    assert rowmatch.same_line("thequickbrownfoxjumps", "thequickbrownf0xjumps") is False
    assert rowmatch.same_line("thequickbrownfoxjumps", "thequickbrownfoxjumpz") and not rowmatch.same_line("thequick", "thequicc")


def test_colours_of_reads_by_arrow(spark):
    said = lambda c: f"unhex(repeat('FFFFFF', 800) || repeat(repeat('FFFFFF', 10) || repeat('{c}', 30) || repeat('FFFFFF', 40), 20) || repeat('FFFFFF', 800))"
    words = "array(named_struct('start', 0, 'end', 5, 'box', array(10, 10, 30, 20)), named_struct('start', 6, 'end', 10, 'box', array(45, 10, 30, 20)))"
    reads = spark.range(700).selectExpr("id as read_id", f"case id % 4 when 0 then {said('DCE6FC')} when 1 then {said('C8C896')} when 2 then {said('FFFFFF')} end as image", "80 as width", "40 as height", "'Alpha beta' as text", f"{words} as words")
    found = colours.label_colours(reads)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = found.groupBy(F.col("read_id") % 4, "site_label", "start", "end", "text", "hex", "count").count().collect()
    assert {tuple(r) for r in got} == {(0, "Person Name", 0, 5, "Alpha", None, 0, 175), (1, None, None, None, "Alpha", "#c8c896", 1, 175)}


def test_batches_are_taken_up_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from veilspark.operators import analyze, detect
    from veilspark.sources import html, nodes

    assert [len(x) for x in html.parts(pa.array(range(2 * html.STEP + 1)))] == [html.STEP, html.STEP, 1] and not list(html.parts(pa.array([])))
    n = 3 * html.STEP + 5
    pages = spark.range(n).coalesce(1).selectExpr("id as page_id", "case when id % 7 > 0 then concat('<p>Page <b>', id, '</b></p>') end as html")
    texts = pages.select("page_id", html.text_of(F.col("html")).alias("t"))
    assert "ArrowEvalPython" in texts._jdf.queryExecution().toString()
    assert {r.page_id: r.t for r in texts.collect()} == {k: f"Page {k}\n" if k % 7 else "" for k in range(n)}
    assert nodes.nodes(pages).groupBy("page_id").count().where("count = 2").count() == sum(k % 7 > 0 for k in range(n))
    said = spark.range(n).coalesce(1).selectExpr("id as doc_id", "concat('he works at Zentrix Technologies Pvt Ltd now, ', id) as text")
    assert {(r.doc_id, r.text) for r in detect.detections(said, only=("business",)).collect()} == {(k, "Zentrix Technologies Pvt Ltd") for k in range(n)}
    rows = spark.range(n).coalesce(1).selectExpr("id as pair_id", "array('one two', concat('row ', id, ' said')) as left_rows", "array(concat('row ', id, ' said'), 'one two') as right_rows")
    out = analyze.reorder(rows)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {x for k in range(n) for x in ((k, 0, 1, "one two", 2), (k, 1, 0, f"row {k} said", 2))}


def test_letters_are_counted_without_a_match_for_each(spark):
    from veilspark.functions import language

    said = {"": None, "a1b2c3d4e5f6g7": None, "abc defgh": "English", "la casa de los amigos": "Spanish", "अआइई उऊऋए": "Hindi/Marathi (Devanagari)", "e\u0301 1 2 abcdef": "English", "1234567 !?": None}
    docs = spark.createDataFrame(list(said), "string")
    got = docs.select("value", language.language_of(F.col("value")), language.letters(F.col("value")))
    assert "regexp_count" not in docs.select(language.letters(F.col("value")))._jdf.queryExecution().analyzed().toString().lower()
    rows = got.collect()
    assert {r[0]: r[1] for r in rows} == said and [r[2] for r in rows] == [0, 7, 8, 17, 8, 8, 0]


def test_names_are_keyed_and_places_told_by_few_steps(spark):
    names = spark.createDataFrame(["Zen  Pvt. Ltd. Group Inc", "Zen Group and Co.", "Ltd", " Ltd.", "A .", "., Inc", "", "Inc\u00a0Ltd ltd LTD Inc", "Tom\u2019s  AND Co"], "string")
    keyed = names.select("value", lexicon.name_key(F.col("value")).alias("k"))
    assert keyed._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 7
    assert [r.k for r in keyed.collect()] == ["zen", "zen group and", "ltd", "ltd", "a", ".,", "", "inc ltd", "tom's and"]
    # only what lies between candidates is measured, not each part of a text
    docs, own = spark.createDataFrame([(0, "x " * 30000 + "\u65e5 \U0001f600 ravi  kumar, " + "y " * 30000 + "ravi kumar ravi")], "row int, text string"), spark.createDataFrame([(["ravi", "kumar"],), (["ravi"],)], "toks array<string>")
    hits = phrases.found(docs, own, [])
    assert "_parts, lambdafunction(length(" not in hits._jdf.queryExecution().analyzed().toString()
    assert sorted((r.start, r.end, r.said) for r in hits.collect()) == [(60004, 60008, "ravi"), (60004, 60015, "ravi  kumar"), (120017, 120021, "ravi"), (120017, 120027, "ravi kumar"), (120028, 120032, "ravi")]


def test_selectors_read_each_page_once(spark):
    from veilspark.sources import nodes

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    said = "concat('<html><body><p name=\"a', id % 3, '\">x <b>', id, '</b></p><p class=\"note\">y</p><p class=\"note\">z</p></body></html>')"
    pages = spark.range(40).selectExpr("nullif(id, 7) as page_id", f"case when id % 5 > 0 then {said} end as html").mapInArrow(seen, "page_id long, html string")
    out = nodes.selectors(nodes.nodes(pages)).collect()
    assert read.value == 40
    got = {(r.page_id, r.node): r.selector for r in out}
    of = lambda k: ["html", "body", f'p[name="a{k % 3}"]', f'p[name="a{k % 3}"] > b', "body > p.note:nth-of-type(2)", "body > p.note:nth-of-type(3)"]
    assert len(out) == len(got) and got == {(k, n): s for k in range(40) if k % 5 and k != 7 for n, s in enumerate(of(k))}
