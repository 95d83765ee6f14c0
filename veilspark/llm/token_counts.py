"""Token counts with overlap resynchronisation.

A huge document is encoded in chunks that overlap. Two encodings of the overlap agree from the first boundary that is
proven stable: a place that both have as a token's start and before which the pattern of the vocabulary must end a
match (white space after another character), whatever stands further left or right. The tokens of the left chunk up to
there and those of the right one from there on are spliced. If the overlap has no such place, it is widened, at the
last to the whole chunk, which is then encoded together with what follows. A text's tokens are those of its chunks'
encodings between their splices; nothing is encoded again for the count.

Texts of up to a chunk need no splice: their distinct pieces between stable boundaries are encoded once a worker, and
counted by the piece. Those with special strings or other white space are encoded whole.

Defined cases: a null text counts as empty: no bytes, no tokens. Special strings inside texts are one token each, as
the library has it by default. Rows are counted one by one, whatever their ids, and keep all their columns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import pieces, shared, text

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 13, 256
LIMIT = 1024
_SPACE = " \t\n\v\f\r"


def stable(said: str, at: int) -> bool:
    """Whether no match of the pattern goes over at, whatever stands left or right of it."""
    return 0 < at < len(said) and said[at] in _SPACE and not said[at - 1].isspace()


def spliced(said: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, list[int]]]:
    """A text in spans [start, end) with the starts of the tokens of each, spliced from encodings of chunks that overlap.
    encode(text) gives the starts of its tokens, in characters and in order."""
    at, end, since = 0, min(chunk, len(said)), 0
    own = encode(said[:end])
    while end < len(said):
        wide = overlap
        while True:
            begin = max(at, end - wide)
            stop = min(len(said), max(end + 1, begin + chunk))
            ahead = [begin + x for x in encode(said[begin:stop])] if begin > at else None
            if ahead is None:
                break
            both = set(own[bisect_left(own, begin) :]).intersection(ahead[: bisect_left(ahead, end)])
            cut = min((p for p in both if p > since and stable(said, p)), default=None)
            if cut is not None:
                break
            wide *= 2  # no place at which both agree: more overlap
        if ahead is None:  # not even with all of the chunk: one encoding of it and as much again
            end = min(len(said), end + max(chunk, end - at))
            own = [at + x for x in encode(said[at:end])]
            continue
        yield since, cut, own[bisect_left(own, since) : bisect_left(own, cut)]
        at, end, own, since = begin, stop, ahead, cut
    yield since, len(said), own[bisect_left(own, since) :]


def _counted(path: str, chunk: int, overlap: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.Encoder(path, keep_ids=False)
        library = encoder.library

        def starts(said: str) -> list[int]:
            return [a for a, _ in library.encode(said, add_special_tokens=False).offsets]

        for b in batches:
            column = b.column(b.schema.get_field_index("_text"))
            data, bounds = text.text_buffer(column)
            size = np.diff(bounds)
            raw = data.tobytes()
            whole = (size > chunk) | pieces.texts_with(raw, bounds, path, other_space=True)
            n = np.zeros(len(size), np.int64)
            for i in np.flatnonzero(whole):
                said = raw[bounds[i] : bounds[i + 1]].decode()
                n[i] = sum(len(tokens) for _, _, tokens in spliced(said, starts, chunk, overlap))
            ends = np.unique(bounds)
            a, z, ptr = pieces.pieces(data, ends, with_space=True)
            short = ~whole[np.searchsorted(bounds, a, "right") - 1]
            place = encoder.places(data, a[short], z[short])
            each = np.zeros(len(a), np.int64)
            each[short] = encoder.counts[place]
            total = np.concatenate([[0], np.cumsum(each)])
            at = np.searchsorted(ends, bounds)
            n = np.where(whole, n, total[ptr[at[1:]]] - total[ptr[at[:-1]]])
            yield shared.batch(schema, [*b.columns, size, n])

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes and n_tokens by a byte-level vocabulary of the tokenizers library; these replace columns of such names."""
    shared.prepared(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    packed = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in kept if c != text_col), F.lit(0).alias("_pad")).alias("_rest"))
    out = T.StructType([*packed.schema, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = packed.mapInArrow(_counted(path, chunk, overlap, out), out)
    return counted.select(*(F.col("_text").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in kept), "n_bytes", "n_tokens")
