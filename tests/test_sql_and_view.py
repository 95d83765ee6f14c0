from pyspark.sql import functions as F

from veilspark.functions import language, register
from veilspark.operators import analyze, view
from veilspark.plans import intervals
from veilspark.sources.config import Policy, Settings, load_dictionary


def test_sql_functions(spark):
    register.register(spark)
    rows = spark.sql("select label, value from pii_detect('mail ravi@gmail.com from 10.20.30.40')").collect()
    assert {(r.label, r.value) for r in rows} == {("Person Email", "ravi@gmail.com"), ("IP/MAC Address", "10.20.30.40")}
    assert spark.sql("select iban_valid('DE89370400440532013000') a, verhoeff_valid('236') b, pii_tokens('A-b') c").first() == (True, True, ["a", "-", "b"])


def test_view_and_decisions(spark):
    left, right = "Mr. Ravi Kumar wrote on 10.20.30.40 today about Information ok", "Mr. Arun Shah wrote on 10.20.30.40 today about Helentjad ok"
    df = spark.createDataFrame([(1, left, right)], "pair_id long, left_text string, right_text string")
    got = analyze.analyze(df, labels=None)
    items = {r.site: (r.labeled, r.redaction, r.ok) for r in got["items"].collect()}
    assert items == {"Person Name": ("no", "redacted", False), "IP Address": ("no", "visible", False)}
    assert [(r.was, r.now, r.noise) for r in got["other"].collect()] == [("Information", "Helentjad", False)]
    s = got["summary"].first()
    assert (s.pii, s.labeled, s.visible, s.problems, s.done) == (2, 0, 1, 3, False)
    ids = {r.category: r.id for r in got["L2"].collect()}
    verdicts = spark.createDataFrame([(1, ids["LEAKAGE"], "redact"), (1, ids["OVER_REDACTED"], "keep")], "pair_id long, id string, verdict string")
    done = {r.category: (r.kind, r.fix) for r in view.decided(got["L2"], verdicts, "L2").collect()}
    assert done == {"LEAKAGE": ("missed", True), "OVER_REDACTED": ("over", True), "REDACTED_OK": (None, None)}
    status = {r.category: r.s for r in got["L2"].select("category", view.short_status("L2").alias("s")).collect()}
    assert status == {"LEAKAGE": "Not redacted", "OVER_REDACTED": "Changed — PII?", "REDACTED_OK": "Redacted ✓"}
    assert view.open_issues(got["L2"], verdicts).count() == 0
    boxes = spark.createDataFrame([(1, 4, 8, 0, 10, 5, 20, 8), (1, 9, 14, 0, 32, 5, 30, 9)], "pair_id long, b_start int, b_end int, row int, x int, y int, w int, h int")
    assert [tuple(r)[2:] for r in view.marks(got["items"], boxes).collect()] == [(0, 10, 5, 52, 9)]


def test_readings(spark):
    rows = spark.createDataFrame([("APIs", "APls", True), ("CAREERHIGHLIGHTS", "Career highlights", True), ("Kernel", "Colonel", False)], "a string, b string, same boolean")
    assert all(r.x == r.same for r in rows.select("same", view.same_reading(F.col("a"), F.col("b")).alias("x")).collect())


def test_language_and_structure(spark):
    text = "This is an English line with the usual words.\nDas ist nicht die Zeile für dich und mich\nयह एक हिन्दी पंक्ति है और लंबी है\nok"
    r = language.document_report(spark.createDataFrame([(1, text), (2, None), (3, "{a=1};\n" * 80)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert {x.language for x in r[0].languages} == {"English", "German", "Hindi/Marathi (Devanagari)"} and r[0].verdict in ("mixed", "other")
    assert r[1].verdict == "english" and len(r[2].reasons) >= 2
    runs = language.segments(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [(x.language, x.line, x.lines) for x in runs] == [("German", 2, 1), ("Hindi/Marathi (Devanagari)", 3, 1)]


def test_interval_edges(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 500, 900), (1, 5, 5)], "d long, start int, end int")
    b = spark.createDataFrame([(1, 10, 20), (1, 100, 600), (2, 0, 10)], "d long, b_start int, b_end int")
    assert [(r.start, r.b_start) for r in intervals.overlap_join(a, b, "d").collect()] == [(500, 100)]


def test_settings_and_dictionary(spark, tmp_path):
    from veilspark.functions import known

    assert Settings.load(f"{tmp_path}/none").stage == "L2"
    Settings().save(f"{tmp_path}/s.json", stage="L1")
    assert Settings.load(f"{tmp_path}/s.json").stage == "L1"
    p = Policy.of({"enabled": 1, "defaultStage": "L9", "extraKnownNames": [" Acme ", 3], "pageSetup": {"leftDocument": "#a"}})
    assert p == Policy(True, "L2", None, ("Acme",), "")
    (tmp_path / "names.json").write_text('{"top_mncs": {"indian_it": ["Zed Widgets"]}}')
    try:
        assert load_dictionary(spark, f"{tmp_path}/names.json", ["Acme"]) == 2
        assert known.lookup("Zed Widgets Pvt Ltd") == ("Zed Widgets", "Top MNCs · Indian IT") and known.lookup("Acme")[1] == "Organisation List"
    finally:
        known.use(known.BUILT_IN)
