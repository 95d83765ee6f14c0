"""Everything for pairs: both stages, the view, and what rows of reads become; each a narrow kernel or a plan over its rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.functions import layout, locate, rowmatch
from veilspark.operators import compare, verify, view
from veilspark.plans.materialize import once
from veilspark.sources.html import parts


def moved(found: DataFrame, pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text") -> DataFrame:
    """found with moved: text called unknown whose letters and digits stand on the other side, or are fewer than four."""
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    texts = pairs.select(id_col, letters(F.col(left)).alias("_l"), letters(F.col(right)).alias("_r"))
    said = letters(F.coalesce("text", F.lit("")))
    there = F.when(F.col("left_start").isNotNull(), F.contains(F.col("_r"), said)).otherwise(F.contains(F.col("_l"), said))
    return found.join(texts, id_col, "left").withColumn("moved", (F.col("category") == "UNKNOWN_TEXT") & ((F.length(said) < 4) | there)).drop("_l", "_r")


def both(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text", labels: str | None = "labels") -> DataFrame:
    """(id, stage, l1, l2): compare()'s rows as l1 of stage 1, and what verify's kernel sees as l2 of stage 2."""
    kinds = T.StructType([T.StructField("stage", T.IntegerType()), T.StructField("l1", compare.FINDING), T.StructField("l2", verify.RAW)])
    named = lambda kind, row: dict(zip(kind.names, row))
    make = lambda p: [(1, named(compare.FINDING, r), None) for r in p.findings()] + [(2, None, named(verify.RAW, r)) for r in verify.Walk(p).all()]
    return compare.pair_rows(pairs, make, kinds, id_col, left, right, labels)


def analyze(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text", labels: str | None = "labels") -> dict[str, DataFrame]:
    """L1, L2, items, other and summary, as DataFrames. Both stages look at a pair that is detected and aligned once, and
    texts are read again for nothing but what L2 says of moved text."""
    rows = once(both(pairs, id_col, left, right, labels))
    l1 = compare.identify(rows.where("stage = 1").select(id_col, "l1.*"))
    l2 = once(verify.verify(pairs, id_col, left, right, labels, rows.where("stage = 2").select(id_col, "l2.*")))
    marks = None
    if labels:
        marks = pairs.select(id_col, F.explode(labels).alias("x")).select(id_col, F.col("x.start").alias("b_start"), F.col("x.end").alias("b_end"), F.col("x.raw_label").alias("raw_label"))
    found, other = view.items(l1, l2, marks, id_col), view.other_changes(l2, id_col)
    return {"L1": l1, "L2": moved(l2, pairs, id_col, left, right), "items": found, "other": other, "summary": view.summary(found, other, id_col)}


def _by_row(df: DataFrame, columns: list[str], schema: str, f: Callable[..., list[tuple]], keep: str) -> DataFrame:
    out = T.StructType([T.StructField(keep, df.schema[keep].dataType), *T.StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)
        for b in (part for batch in batches for part in parts(batch)):
            found = [(k, row) for k, given in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))) for row in f(*given)]
            columns = zip(*(row for _, row in found)) if found else [()] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in found], pa.int32())), *(pa.array(c, x.type) for c, x in zip(columns, list(kinds)[1:]))], schema=kinds)

    return df.select(keep, *columns).mapInArrow(run, out)


def read_rows(reads: DataFrame, id_col: str, read_col: str = "read") -> DataFrame:
    """Rows of reads (JSON text): (id, row_no, text, para, clipped, top, bottom, words as JSON)."""
    f = lambda r: [(k, x["text"], x["para"], x["clipped"], float(x["top"]), float(x["bottom"]), json.dumps(x["words"])) for k, x in enumerate(layout.rows_of_read(json.loads(r)))]
    return _by_row(reads, [read_col], "row_no int, text string, para boolean, clipped boolean, top double, bottom double, words string", f, id_col)


def reorder(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_rows", right: str = "right_rows") -> DataFrame:
    """(id, place, row_no, text, moved): rows of the right side in the order of the left; both are arrays of texts."""
    def f(a, b):
        order, n = rowmatch.reordered(list(a), list(b))
        return [(k, j, b[j], n) for k, j in enumerate(order)]

    return _by_row(pairs, [left, right], "place int, row_no int, text string, moved int", f, id_col)


def comparable_range(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_rows", right: str = "right_rows") -> DataFrame:
    def f(a, b):
        r = rowmatch.comparable(list(a), list(b))
        return [(*r["left"], *r["right"], r["matched"])] if r else []

    return _by_row(pairs, [left, right], "left_from int, left_to int, right_from int, right_to int, matched int", f, id_col)


def locate_documents(reads: DataFrame, id_col: str, read_col: str = "read", scale: float = 1.0) -> DataFrame:
    """(id, side, x, y, width, height, score, panes) of the two documents of each read that shows a pair."""
    def f(r):
        d = locate.documents(json.loads(r), scale)
        return [(s, *(float(d[s][c]) for c in ("x", "y", "width", "height")), d["score"], d["panes"]) for s in ("left", "right")] if d else []

    return _by_row(reads, [read_col], "side string, x double, y double, width double, height double, score double, panes boolean", f, id_col)
