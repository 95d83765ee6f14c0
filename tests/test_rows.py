import json

import numpy as np
import pytest

from veilspark.functions import colours, layout, locate, rowmatch
from veilspark.functions.assembly import Assembly
from veilspark.streaming import assemble

DOC = [f"Line number {i} of the document, with words of its own like word{i}x" for i in range(30)]


def row(text, **more):
    return {"text": text, "words": [{"start": 0, "end": 4, "box": [0, 0, 9, 9]}], "para": False, "labels": [], **more}


def view(a, z):
    return [row(t) for t in DOC[a:z]]


def texts(a):
    return [r.text for r in a.rows]


def test_scrolling_both_ways_builds_the_document_once():
    a = Assembly()
    assert [a.add(view(*x)) for x in ((5, 15), (10, 20), (15, 30), (0, 10), (5, 15))] == ["new"] + ["merged"] * 4
    assert texts(a) == DOC


def test_reads_without_overlap_are_kept_and_joined_later():
    a = Assembly()
    a.add(view(0, 8))
    a.add(view(14, 20))
    assert len({r.piece for r in a.rows}) == 2
    a.add(view(6, 16))
    assert texts(a) == DOC[:20] and len({r.piece for r in a.rows}) == 1


def test_misses_start_over_only_if_they_may():
    a = Assembly()
    a.add(view(0, 8))
    got = [a.add([row(f"Something else entirely {k} {i}") for i in range(5)], start_over=True) for k in range(3)]
    assert got == ["ignored", "ignored", "new"]


def test_tiny_and_clipped_reads():
    a = Assembly()
    assert a.add([row("short")]) == "ignored"
    a.add([row(DOC[0], clipped=True), *view(1, 5)])
    assert texts(a) == DOC[1:5]


def test_boxes_only_on_screen_and_jitter():
    a = Assembly()
    a.add(view(0, 10))
    a.add([row(t.replace("document,", "document")) for t in DOC[5:12]])
    shown = [any("box" in w for w in r["words"]) for r in a.document()]
    assert shown == [False] * 5 + [True] * 7 and len(a.rows) == 12


def test_state_survives_as_plain_data():
    a = Assembly()
    a.add(view(0, 10))
    b = Assembly.load(json.loads(json.dumps(a.dump())))
    b.add(view(8, 20))
    assert texts(b) == DOC[:20]


def test_comparable_range():
    assert rowmatch.comparable(DOC, DOC[10:20]) == {"left": (10, 19), "right": (0, 9), "matched": 10}
    assert rowmatch.comparable(["a name line"] + DOC[:5], ["Another Person"] + DOC[:5])["left"] == (0, 5)
    assert rowmatch.comparable(DOC, []) is None


def test_reorder():
    a = ["Alpha beta gamma one", "Delta epsilon zeta two", "Eta theta iota three", "Kappa lambda mu four"]
    assert rowmatch.reordered(a, a) == ([0, 1, 2, 3], 0)
    order, moved = rowmatch.reordered(a, [a[2], "no partner here", a[3], a[0], a[1]])
    assert order == [3, 4, 0, 1, 2] and moved == 5


def test_garbled_and_rows_of_a_read():
    assert layout.garbled("vulIlnly NuvIlVONIVYMIVHIUIL HVlIVIIUILU") and not layout.garbled("ordinary words in a sentence")
    line = lambda t, x, y: {"text": t, "box": [x, y, 100, 20], "words": [{"text": w, "box": [x, y, 9, 20]} for w in t.split()]}
    rows = layout.rows_of_read({"height": 1000, "lines": [line("Right part", 300, 101), line("Left part", 10, 100), line("Next paragraph", 10, 160), line("cut", 10, 1)]})
    assert [(r["text"], r["para"], r["clipped"]) for r in rows] == [("cut", False, True), ("Left part Right part", True, False), ("Next paragraph", True, False)]
    j = layout.joined(rows)
    assert j["text"] == "cut\n\nLeft part Right part\n\nNext paragraph"
    assert layout.boxes_for(j["words"], 5, 25) == [[10, 100, 299, 21]]


def test_documents_side_by_side():
    said = ["Alpha beta gamma delta", "Epsilon zeta eta theta", "Iota kappa lambda mu", "Nu xi omicron pi rho"]
    lines = [{"text": t, "box": [x, 100 + 40 * k, 300, 20], "words": []} for k, t in enumerate(said) for x in (50, 600)]
    got = locate.documents({"width": 1000, "height": 800, "lines": lines})
    assert got["score"] == 1.0 and not got["panes"] and got["left"]["x"] == 38 and got["right"]["x"] == 588
    assert locate.documents({"lines": lines[:4]}) is None
    head = [{"text": t, "box": [x, 40, 200, 20], "words": []} for t, x in (("cv.pdf", 50), ("cv-redacted.pdf", 600))]
    assert locate.documents({"width": 1000, "height": 800, "lines": lines + head})["panes"]


def test_colours():
    image = np.full((40, 80, 3), 255, np.uint8)
    image[10:30, 10:40] = (220, 230, 252)
    image[31:33, 45:75] = (22, 163, 74)
    words = [{"start": 0, "end": 5, "box": [10, 10, 30, 20]}, {"start": 6, "end": 11, "box": [45, 10, 30, 20]}]
    spans, unknown = colours.labels_in("Alpha beta,", words, image)
    assert [(s["site_label"], s["text"]) for s in spans] == [("Person Name", "Alpha"), ("Email Address", "beta")] and not unknown
    image[10:30, 10:40] = (180, 220, 190)
    assert colours.labels_in("Alpha beta,", words, image, {"#b4dcbe": "Date"})[0][0]["site_label"] == "Date"
    assert colours.blank(np.zeros((30, 30, 3), np.uint8)) and not colours.blank(image)


def test_stream_is_the_batch(spark, tmp_path):
    reads = [("t", k, "left", "", json.dumps(view(a, a + 10))) for k, a in enumerate((0, 5, 5, 12, 18))]
    df = spark.createDataFrame(reads, assemble.READ)
    batch = {(r.seq, r.result, r.n_rows) for r in assemble.assemble_batch(df).collect()}
    df.write.parquet(f"{tmp_path}/in")
    q = assemble.assemble(spark.readStream.schema(assemble.READ).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    stream = {(r.seq, r.result, r.n_rows) for r in spark.sql("select * from assembled").collect()}
    assert stream == batch == {(0, "new", 10), (1, "merged", 15), (3, "merged", 22), (4, "merged", 28)}


def test_png_round_trip():
    import struct
    import zlib

    from veilspark.sources.reads import decode_png

    image = np.random.default_rng(1).integers(0, 255, (5, 7, 3), dtype=np.uint8)
    rows, above = b"", np.zeros(21, int)
    for y in range(5):
        line = image[y].ravel().astype(int)
        left = np.concatenate([[0, 0, 0], line[:-3]])
        rows += bytes([y % 3]) + ([line, line - left, line - above][y % 3] % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (decode_png(png) == image).all()
    with pytest.raises(ValueError):
        decode_png(b"x")


def test_html_text_and_labels():
    from veilspark.sources.html import Page, label_pattern, labels_of

    p = Page('<body><script>x</script><p>Hello <b data-label="PERSON_NAME">Asha  Rao</b>,</p><table><tr><td>a</td><td>b</td></tr></table><span class="pii-email">[EMAIL]</span> and [PHONE] [1]</body>')
    assert p.text == "Hello Asha Rao,\na\tb\n[EMAIL] and [PHONE] [1]"
    got = labels_of(p)
    assert [(x["label"], x["text"], x["placeholder"]) for x in got] == [("Person Name", "Asha Rao", False), ("Person Email", "[EMAIL]", True), ("Person Phone No", "[PHONE]", True)]
    assert label_pattern(p)[1] == 1


def test_stream_from_files_to_files(spark, tmp_path):
    """Source and sink; both sides, a side that shows something else, starting over, and the last of a burst."""
    reads = [("t", 0, "left", "", json.dumps(view(0, 10))), ("t", 1, "right", "", json.dumps(view(0, 10))), ("t", 2, "right", "", json.dumps([{"text": "x"}])), ("t", 3, "left", "", json.dumps(view(5, 15)))]
    spark.createDataFrame(reads, assemble.READ).coalesce(1).write.json(f"{tmp_path}/in")
    assemble.start(assemble.assemble(assemble.snapshots(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c", every=None).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.seq, r.both) for r in out.collect()} == {(0, False), (1, True), (3, False)} and [r.seq for r in assemble.shown(out).collect()] == [1]

    other = [[{"text": f"{w} {k} something else entirely {w * 2}"} for k in range(6)] for w in ("alpha", "beta", "gamma", "delta")]
    apart = spark.createDataFrame([("t", 0, "left", "", json.dumps(view(0, 10))), *(("t", k + 1, "left", "", json.dumps(rows)) for k, rows in enumerate(other))], assemble.READ)
    results = lambda over: [r.result for r in assemble.assemble_batch(apart, over).orderBy("seq").collect()]
    assert results(False) == ["new", "merged", "merged", "merged", "merged"] and results(True).count("new") >= 2

    times = spark.sql("select id, timestamp_millis(t) as at, k from values (1, 0, 'a'), (2, 500, 'a'), (3, 900, 'a'), (4, 2000, 'a'), (5, 100, 'b') v(id, t, k)")
    assert {(r.id, r.reads) for r in assemble.debounced(times, ["k"], "at").collect()} == {(3, 3), (4, 1), (5, 1)}
