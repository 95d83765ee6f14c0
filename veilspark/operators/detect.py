"""Detection as an operator on DataFrames: one Arrow kernel holds all rules, each document is read once, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import engine, known
from veilspark.operators import scan
from veilspark.sources.html import parts

DETECTION = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("text", T.StringType()),
])


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: tuple[str, ...] | None = None, overlaps: bool = False, all_dates: bool = False, strict: bool = False) -> DataFrame:
    """A row for each detection: the id and DETECTION. `only` names detectors and takes effect when the plan is built;
    the choice among overlaps is then made among theirs; if all of them are of structured rules, nothing leaves the JVM
    (operators.scan). overlaps=True leaves the choice out. strict=True ends the job where a detector fails; else it finds
    nothing in that text."""
    if scan.structured(only) and not overlaps:
        return scan.detections(docs, id_col, text_col, only)
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), *DETECTION])
    source = known.current()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        known.use(source)
        schema = to_arrow_schema(out)
        for b in (part for batch in batches for part in parts(batch)):
            place, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                found = engine.every(text or "", only, all_dates, strict) if overlaps else engine.detect(text, only, all_dates, strict)
                place += [k] * len(found)
                rows += [(n, *s) for n, s in enumerate(found)]
            n, start, end, label, sure, origin, rule, value = zip(*rows) if rows else [()] * 8
            columns = [n, start, end, label, sure, origin, rule, value]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int32())), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


def nested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with an array column of its detections."""
    found = detections(docs, id_col, text_col, **options).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(*DETECTION.names))).alias("detections"))
    return docs.join(found, id_col, "left").withColumn("detections", F.coalesce("detections", F.array().cast(T.ArrayType(DETECTION))))
