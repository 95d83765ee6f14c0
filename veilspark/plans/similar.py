"""Similarity join of sets by prefixes: no pair of rows is met over a common word that tells nothing.

Sets of n and m words whose Jaccard is at least t share a word among the rarest n - ceil(t n) + 1 of the one and m -
ceil(t m) + 1 of the other, by any order that both keep: here by how many rows of the second have a word. Only these words
are joined; ids that meet are told once and verified with their sets. A row more words of which than may differ are in no
row of the other side meets nothing, and one that is too short or too long for all of them isn't taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def similar(a: DataFrame, b: DataFrame, a_id: str, b_id: str, words: str, least: float) -> DataFrame:
    """(a_id, b_id, similarity) of rows of a (a_id, words) and b (b_id, words) whose sets have a Jaccard of `least` or more.
    words: an array without repeats; ids are unique; empty sets are like nothing. Rows of equal sets are each paired: where
    they are many, a and b should hold one of each."""
    # sizes of what is alike lie within a factor, and so do candidates; rows beyond all sizes of the other side go at once
    x, y = (df.select(F.col(i).alias(k), F.col(words).alias(f"{k}_words")).where(F.size(words) > 0) for df, i, k in ((a, a_id, "_a"), (b, b_id, "_b")))
    reach = lambda df, k: F.broadcast(df.agg(F.min(F.size(f"{k}_words")).alias("_least"), F.max(F.size(f"{k}_words")).alias("_most")))
    within = lambda df, k, by: df.join(by, (F.size(f"{k}_words") >= F.col("_least") * least) & (F.size(f"{k}_words") * least <= F.col("_most"))).drop("_least", "_most")
    x = within(x, "_a", reach(y, "_b"))
    each = lambda df, k: df.select(k, F.size(f"{k}_words").alias("_n"), F.explode(f"{k}_words").alias("w"))
    # the order: by how many rows of b have a word. Those of a's words that none has come first and meet nothing: counted, not joined
    often = each(y, "_b").groupBy("w").agg(F.count("*").alias("c"))

    def rarest(df: DataFrame, k: str) -> DataFrame:
        w = Window.partitionBy(k)
        known = each(df, k).join(often, "w").withColumn("_known", F.count("*").over(w)).where(F.col("_known") >= F.ceil(F.col("_n") * least - 1e-9))
        place = F.row_number().over(w.orderBy("c", "w")) + F.col("_n") - F.col("_known")
        return known.withColumn("_place", place).where(F.col("_place") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).select("w", k, F.col("_n").alias(f"{k}_n"))

    met = rarest(x, "_a").join(rarest(y, "_b"), "w").where((F.col("_a_n") >= F.col("_b_n") * least) & (F.col("_b_n") >= F.col("_a_n") * least)).select("_a", "_b").distinct()
    both = F.size(F.array_intersect("_a_words", "_b_words"))
    likeness: Column = both / (F.size("_a_words") + F.size("_b_words") - both)
    there = met.join(x, "_a").join(y, "_b").withColumn("similarity", likeness).where(F.col("similarity") >= least)
    return there.select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), "similarity")
