"""Joins and windows over half-open intervals [start, end) of documents.

Spark has no range join: intervals are cut at multiples of a width, equal pieces are joined by hash, and a pair is kept
only in the piece in which it begins to overlap, so that each comes out once. The work follows the overlaps, not the
product, and a document with many spans spreads over its pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 256


def overlap_join(a: DataFrame, b: DataFrame, on: str, how: str = "inner", width: int = WIDTH) -> DataFrame:
    """Rows of a (start, end) with those of b (b_start, b_end) that overlap, in the same `on`; how: inner, left_semi, left_anti."""
    pieces = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    x = a.where("end > start").withColumn("_piece", pieces("start", "end"))
    y = b.where("b_end > b_start").withColumn("_piece", pieces("b_start", "b_end"))
    met = x.join(y, [on, "_piece"]).where("start < b_end and b_start < end")
    met = met.where(F.col("_piece") == F.floor(F.greatest("start", "b_start") / width)).drop("_piece")
    if how == "inner":
        return met
    return a.join(met.select(on, "start", "end").distinct(), [on, "start", "end"], how)


def best_overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """For each row of a (start, end, label) the row of b (b_start, b_end, b_label) of the most overlap; of equals the last of the same label, else the first; then the one that ends first, then by b_label."""
    met = overlap_join(a, b, on).withColumn("overlap", F.least("end", "b_end") - F.greatest("start", "b_start"))
    same = F.col("label") == F.col("b_label")
    w = Window.partitionBy(on, "start", "end", "label").orderBy(F.desc("overlap"), F.desc(same), F.when(same, -F.col("b_start")).otherwise(F.col("b_start")), "b_end", "b_label")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def islands(rows: DataFrame, on: list[str], start: str, end: str, gap: int, name: str = "island") -> DataFrame:
    """Numbers clusters of rows of which each begins at most gap after all before it have ended."""
    w = Window.partitionBy(*on).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def surest(rows: DataFrame, on: list[str]) -> DataFrame:
    """Of rows of one place and label the surest, of equals the first by ord."""
    w = Window.partitionBy(*on, "start", "end", "label").orderBy(F.desc("confidence"), "ord")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def disjoint(spans: Column, rank: Column) -> Column:
    """Greedy choice inside an array of structs (start, end, label, confidence): the longest first, then by rank of the
    label (a map), confidence and start; a fold in the JVM."""
    keyed = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("a"), F.coalesce(F.try_element_at(rank, s["label"]), F.lit(99)).alias("b"), (-s["confidence"]).alias("c"), s["start"].alias("d"), s.alias("s")))
    return F.aggregate(F.array_sort(keyed), F.slice(spans, 1, 0), lambda kept, k: F.when(F.exists(kept, lambda o: (o["start"] < k["s"]["end"]) & (o["end"] > k["s"]["start"])), kept).otherwise(F.concat(kept, F.array(k["s"]))))


def nearest_before(rows: DataFrame, on: str, order: str, value: str, name: str) -> DataFrame:
    """The last value that isn't null before each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(on).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def filled(rows: DataFrame, on: str, order: str, value: str, name: str) -> DataFrame:
    """Rows without a value take the last one before; those before the first take half less than the first, or -1."""
    w = Window.partitionBy(on).orderBy(order)
    last = F.last(value, ignorenulls=True).over(w)
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(name, F.coalesce(last, first - 0.5, F.lit(-1.0)))


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted values, the upper of two."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def upper_medians(rows: DataFrame, on: list[str], value: str, name: str = "median") -> DataFrame:
    """(on, name): the upper median of each group. Equal values are counted before anything moves, and the median is the
    first value at which the counts pass half: a group costs its distinct values, however many rows it has."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*on, F.col(value).alias(name)).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*on)
    so_far = F.sum("_n").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    passed = counts.withColumn("_c", so_far).withColumn("_all", F.sum("_n").over(w)).where("_c >= floor(_all / 2) + 1")
    return passed.groupBy(*on).agg(F.min(name).alias(name))


def top_k(rows: DataFrame, on: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(0.0)
