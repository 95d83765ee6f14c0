"""The two documents of a page: elements that stand side by side, are not nested, and say mostly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.plans import intervals

# FIXED VALUES: elements of a page and words of an element that are looked at, the least size and text, and limits of pairs
ELEMENTS, WORDS = 1500, 4000
WIDTH, HEIGHT, TEXT, WIDEST = 160, 40, 80, 0.8
OVERLAP, LENGTHS, ALIKE, MOST_TEXT = 0.4, 0.4, 0.35, 0.85


def words(text: Column) -> Column:
    """The different words among the first WORDS of a text."""
    return F.array_distinct(F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1), 1, WORDS), lambda w: F.lower(w)))


def candidates(elements: DataFrame, page_col: str = "page_id") -> DataFrame:
    """elements: (page, ord, path, x, y, width, height, viewport, text); path names an element below its parents', by '/'.
    Those large enough that hold enough text, the first ELEMENTS of a page."""
    able = elements.where((F.col("width") >= WIDTH) & (F.col("height") >= HEIGHT) & (F.col("width") <= WIDEST * F.col("viewport")) & (F.length("text") >= TEXT))
    kept = intervals.top_k(able, [page_col], [F.col("ord")], ELEMENTS)
    return kept.select(page_col, "path", "x", "y", "width", "height", F.length("text").alias("size"), words(F.col("text")).alias("words"))


def best_pairs(elements: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, left_path, right_path, similarity), at most a row for each page: of the pairs that cover nearly the most text
    the most alike, of equals the tightest. Pairs are formed within a page, of at most ELEMENTS elements."""
    c = candidates(elements, page_col)
    side = lambda p: c.select(page_col, *(F.col(n).alias(p + n) for n in c.columns if n != page_col))
    a = lambda n: F.col("a_" + n)
    b = lambda n: F.col("b_" + n)
    beside = F.least(a("y") + a("height"), b("y") + b("height")) - F.greatest(a("y"), b("y"))
    nested = F.startswith(b("path"), F.concat(a("path"), F.lit("/"))) | F.startswith(a("path"), F.concat(b("path"), F.lit("/")))
    met = side("a_").join(side("b_"), page_col).where((a("x") + a("width") <= b("x") + 8) & (beside >= OVERLAP * F.least(a("height"), b("height"))) & ~nested & (F.least(a("size"), b("size")) >= LENGTHS * F.greatest(a("size"), b("size"))))
    alike = met.withColumn("similarity", intervals.jaccard(a("words"), b("words"))).where(F.col("similarity") >= ALIKE)
    least, area = F.least(a("size"), b("size")), a("width") * a("height") + b("width") * b("height")
    page = Window.partitionBy(page_col)
    full = alike.withColumn("_least", least).withColumn("_most", F.max("_least").over(page)).where(F.col("_least") >= MOST_TEXT * F.col("_most"))
    order = [F.desc(F.floor(F.col("similarity") * 50 + 0.5)), area, a("path"), b("path")]
    return intervals.top_k(full, [page_col], order, 1).select(page_col, a("path").alias("left_path"), b("path").alias("right_path"), F.round("similarity", 2).alias("similarity"))
