"""What the operators on vectors share: the rows that are whole, tables by length, and a batch as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v, more): rows whose vector is not null and holds neither nulls nor components that aren't finite."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), *(F.col(f"`{c}`").alias(k) for k, c in zip(("label",), more)))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of vectors that occur, of which a table has few."""
    return sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())


def of_length(rows: DataFrame, d: int) -> DataFrame:
    return rows.where(F.size("v") == d)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of vectors of length d as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
