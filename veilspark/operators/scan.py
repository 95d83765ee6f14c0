"""Detection by the structured rules without leaving the JVM.

A row's matches are found in one projection, beside each other for all rules, and only they are shuffled, by a number of
their row: equal places of one label keep the surest, and runs of overlapping spans, which are short, are settled one by
one, longest first. Rows that share an id are rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns, rules, scan
from veilspark.plans import intervals


def rank() -> Column:
    """Labels by how specific they are."""
    return F.create_map(*(F.lit(x) for k, name in enumerate(patterns.SPECIFICITY) for x in (name, k)))


def structured(only: tuple[str, ...] | None) -> bool:
    """Whether the detectors named are all of structured rules."""
    return only is not None and set(only) <= set(rules.STRUCTURED)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """(_row, id, start, end, label, confidence, number, rule, text) for all matches, overlapping ones too; number is the rule's place in the registry."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), text.alias("_text"))
    out = rows.select("_row", id_col, "_text", F.expr(f"inline_outer({scan.every(scan.F.col('_text'), only).sql})")).where("start is not null")  # outer: else a filter would be inferred that scans twice more
    # a text that has the marks of the scan was read with others in their place
    own = F.when(F.col("text").contains(scan._OTHER), F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("text"))
    return out.withColumn("text", own).drop("_text")


def settled(spans: DataFrame, on: list[str]) -> DataFrame:
    """Of overlapping spans (start, end, label, confidence, number, rule, text) of each `on` those that stay, numbered by place (ord).

    Greedy choice looks at spans that overlap, so each run of overlapping spans is settled by itself; `on` stays the one key
    of all steps, which share an exchange."""
    place = F.struct((-F.col("confidence")).alias("c"), "number", "rule", "text")
    best = spans.repartition(*on).groupBy(*on, "start", "end", "label").agg(F.min(place).alias("p"))
    rows = best.select(*on, "start", "end", "label", (-F.col("p.c")).alias("confidence"), F.col("p.rule").alias("rule"), F.col("p.text").alias("text"))
    w = Window.partitionBy(*on).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy(*on, "_run").agg(F.collect_list(F.struct("start", "end", "label", "confidence", "rule", "text")).alias("s"))
    kept = runs.select(*on, F.inline(F.when(F.size("s") == 1, F.col("s")).otherwise(intervals.disjoint(F.col("s"), rank()))))
    return kept.withColumn("ord", (F.row_number().over(Window.partitionBy(*on).orderBy("start")) - 1).cast("int"))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each detection of the structured rules, overlaps resolved: the id and the fields of detect.DETECTION."""
    kept = settled(candidates(docs, id_col, text_col, only), ["_row", id_col])
    return kept.select(id_col, "ord", "start", "end", "label", "confidence", F.lit("regex").alias("source"), "rule", "text")
