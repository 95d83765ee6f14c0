"""Labels that a read of a screen shows as colours behind or below words, and the colours that are no label's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.functions import colours
from veilspark.plans import intervals
from veilspark.sources.reads import decode_png

#: Colours without a label that are shown.
SHOWN = 6
#: Reads of a batch that are taken up at once.
STEP = 256
FOUND = "site_label string, start int, end int, text string, hex string, count long"


def pixels(image: bytes | pa.Buffer, width: int | None, height: int | None) -> np.ndarray:
    """A PNG, or rows of RGB or RGBA pixels of the given size."""
    if bytes(memoryview(image)[:8]) == b"\x89PNG\r\n\x1a\n":
        return decode_png(bytes(memoryview(image)))
    return np.frombuffer(image, np.uint8).reshape(int(height), int(width), -1)


def label_colours(reads: DataFrame, id_col: str = "read_id", taught: dict[str, str] | None = None) -> DataFrame:
    """reads: (id, image, width, height, text, words), words an array of (start, end, box). A row for each span of a label
    (site_label, start, end, text) and for each colour that is none (hex, count, text: an example). Blank images give none."""
    out = T.StructType([T.StructField(id_col, reads.schema[id_col].dataType), *T.StructType.fromDDL(FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            place, rows = [], []
            image_of = b.column(1)
            for first in range(0, b.num_rows, STEP):
                for k, (width, height, text, words) in enumerate(zip(*(c.slice(first, STEP).to_pylist() for c in b.columns[2:])), first):
                    at = pixels(image_of[k].as_buffer(), width, height) if image_of[k].is_valid else None
                    if at is None or text is None or colours.blank(at):
                        continue
                    spans, unknown = colours.labels_in(text, words, at, taught)
                    place += [k] * (len(spans) + len(unknown))
                    rows += [(s["site_label"], s["start"], s["end"], s["text"], None, 0) for s in spans] + [(None, None, None, u["example"], u["hex"], u["count"]) for u in unknown]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int32())), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    words = F.transform("words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["box"].alias("box")))
    return reads.select(id_col, F.col("image").cast("binary").alias("image"), "width", "height", "text", words.alias("words")).mapInArrow(run, out)


def unknown_colours(found: DataFrame, on: list[str], most: int = SHOWN) -> DataFrame:
    """(on, hex, count, example): of label_colours() the colours without a label over all reads, the most common first."""
    counted = found.where("hex is not null").groupBy(*on, "hex").agg(F.sum("count").alias("count"), F.min("text").alias("example"))
    return intervals.top_k(counted, on, [F.desc("count"), F.col("hex")], most)
