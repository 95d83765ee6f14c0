"""Detectors of one's own as table functions over relations: select * from find(table(docs) partition by lang, text => 'text').

The function takes any relation; which columns come out is settled when a query is analysed: all columns but the text, and
then those of a detection. Partitions are up to the query: without `partition by` nothing moves, with it a detector that
keeps something (per_partition) sees all rows of a key together, one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException  # noqa: F401

#: (start, end, confidence) of what a detector finds in a text.
Found = Iterable[tuple[int, int, float]]

_FIELDS = [("start", T.IntegerType()), ("end", T.IntegerType()), ("label", T.StringType()), ("confidence", T.DoubleType()), ("found", T.StringType())]


def register_detector(spark: SparkSession, name: str, label: str, find: Callable[[str], Found] | None = None, per_partition: Callable[[], Callable[[str], Found]] | None = None) -> None:
    """Makes a detector a table function. find: the detector; or per_partition, which makes a new one for each partition, so
    that what it remembers is of that partition alone. Labels and confidences follow the rules of all detections."""

    class Detector:
        def __init__(self):
            self.find = per_partition() if per_partition else find

        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(rows.dataType, T.StructType):
                raise ValueError(f"{name} takes table(...) as its first argument")
            if text.value not in rows.dataType.names:
                raise ValueError(f"{name} has no column {text.value!r}: {', '.join(rows.dataType.names)}")
            own = [f for f in rows.dataType if f.name != text.value]
            if clash := {f.name for f in own} & {k for k, _ in _FIELDS}:
                raise ValueError(f"{name} gives columns of these names itself: {', '.join(sorted(clash))}")
            return AnalyzeResult(T.StructType([*own, *(T.StructField(k, kind) for k, kind in _FIELDS)]))

        def eval(self, rows, text):
            said = rows[text]
            for start, end, sure in self.find(said) if said else ():
                if 0 <= start < end <= len(said):
                    yield (*(rows[k] for k in rows.asDict() if k != text), start, end, label, round(min(0.99, max(0.01, sure)), 2), said[start:end])

    spark.udtf.register(name, udtf(Detector))
