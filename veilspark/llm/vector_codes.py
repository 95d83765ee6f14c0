"""Vector code compression: product quantisation in whole numbers, exact on every machine and in any order.

A component x becomes floor(256 x). Vectors are cut into 16 parts, each with a codebook of 64 entries that starts as
this part of the rows of the smallest ids. The codebooks are broadcast; an Arrow batch finds all squared distances of a
part as |x|² - 2 x·c + |c|² with an int64 matrix product and takes the first smallest; a task adds up what each entry
got, and one grouped shuffle merges these sums, from which the driver makes the next entries: floor(sum / count). What
goes to the driver are the sums of the codebooks alone, whatever the number of rows.

Defined cases: rows whose vector is null or holds a null or a component that isn't finite are dropped; ids may repeat
(rows of one id are ordered by their vector) or be null (last); with fewer than 64 rows a codebook has as many entries;
vectors of another length have codebooks of their own; where the length is no multiple of 16, the first parts have one
component more (the last none, if there are under 16); a vector with a component so large that distances might leave 64
bits (beyond 400,000 at 64 dimensions) is in no codebook, and its code and error are null, as are sums beyond 64 bits;
other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import shared, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def bounds_of(d: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [0, *np.cumsum([d // parts + (p < d % parts) for p in range(parts)]).tolist()]


def reach(d: int, parts: int = PARTS) -> int:
    """The largest component for which the squared distances of all parts together fit 63 bits."""
    return isqrt((1 << 61) // max(1, parts * -(-d // parts))) - 1


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(x * scale).astype(np.int64)


def assigned(x: np.ndarray, codebooks: list[np.ndarray], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole numbers the code of each part, and the squared distance of the whole row."""
    codes, error = np.zeros((len(x), len(codebooks)), np.uint8), np.zeros(len(x), np.int64)
    for p, book in enumerate(codebooks):
        part = x[:, bounds[p] : bounds[p + 1]]
        far = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)[None, :]
        codes[:, p] = far.argmin(1)  # the first of equal ones
        error += far[np.arange(len(x)), codes[:, p]]
    return codes, error


def _summed(broadcast, bounds: list[int], scale: int):
    """For each slot (a component of an entry of a part, or an entry's count at the end) what a task's rows add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, d = broadcast.value, bounds[-1]
        k, parts = len(books[0]), len(books)
        sums, counts = np.zeros((k, d), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            x = whole_numbers(vectors.matrix(b.column(0), d), scale)
            codes, _ = assigned(x, books, bounds)
            for p in range(parts):
                np.add.at(sums[:, bounds[p] : bounds[p + 1]], codes[:, p], x[:, bounds[p] : bounds[p + 1]])
                counts[p] += np.bincount(codes[:, p], minlength=k)
        every = np.concatenate([sums.ravel(), counts.ravel()])
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some])], names=["slot", "s"])

    return run


def train(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebook of each part, from (id, v) of one length."""
    spark, bounds = rows.sparkSession, bounds_of(d, parts)
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = whole_numbers(np.array([r.v for r in first], np.float64).reshape(len(first), d), scale)
    books = [x[:, a:b].copy() for a, b in zip(bounds, bounds[1:])]
    for _ in range(rounds):
        broadcast = spark.sparkContext.broadcast(books)
        slots = rows.select("v").mapInArrow(_summed(broadcast, bounds, scale), "slot long, s long").groupBy("slot").agg(F.sum("s").alias("s"))
        k = len(first)
        every = np.zeros(k * d + parts * k, np.int64)
        for r in slots.collect():
            every[r.slot] = r.s
        sums, counts = every[: k * d].reshape(k, d), every[k * d :].reshape(parts, k)
        for p, book in enumerate(books):
            used = np.flatnonzero(counts[p])
            book[used] = sums[used, bounds[p] : bounds[p + 1]] // counts[p][used, None]
    return books


def sha256_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def _coded(broadcast, bounds: list[int], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = assigned(whole_numbers(vectors.matrix(b.column(2), bounds[-1]), scale), broadcast.value, bounds)
            text, n = codes.tobytes().hex(), 2 * len(bounds) - 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text[k : k + n] for k in range(0, n * len(b), n)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def decoded(code: str, books: list[np.ndarray]) -> list[int]:
    """The whole numbers that a code stands for."""
    return [int(v) for p, k in enumerate(bytes.fromhex(code)) for v in books[p][k]]


def compressed(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row with a whole vector."""
    spark = shared.prepared(table.sparkSession)
    rows = vectors.whole(table, id_col, vector_col, label_col)
    kind = dict(rows.dtypes)["label"]
    out = rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    for d in vectors.lengths(rows):
        same, most = vectors.of_length(rows, d), reach(d, parts)
        small = F.forall("v", lambda x: F.abs(x) * scale < F.lit(float(most)))  # noqa: B023
        able = same.where(small)
        books = train(able, d, parts, entries, rounds, scale)
        if books[0].shape[0]:
            coded = able.select("id", "label", "v").mapInArrow(_coded(spark.sparkContext.broadcast(books), bounds_of(d, parts), scale), f"id long, label {kind}, code string, error long")
            out = out.union(coded.withColumn("codebooks_sha256", F.lit(sha256_of(books))))
        out = out.union(same.where(~small).select("id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(sha256_of(books))))
    # null is a label of its own
    marked = out.select("*", F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")).checkpoint()
    sums = marked.groupBy("_none", "_label").agg(F.count("*").alias("_n"), F.expr("try_cast(sum(cast(error as decimal(19, 0))) as bigint)").alias("label_error")).checkpoint()
    there = shared.joined_spread(marked, sums, ["_none", "_label"], "_n")
    return there.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
