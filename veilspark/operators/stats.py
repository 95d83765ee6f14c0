"""Figures of pairs: findings by category, values by group and label, values replaced and leaked, and ways through issues.

Categories, groups and labels are small fixed dimensions: a pair's counts are conditional sums of one aggregate, spread
into rows afterwards, so that there is no join with a dimension and one shuffle by pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators.compare import Pair, pair_rows
from veilspark.operators.verify import Walk

PAGE = 100
_TODO = ("PI_TODO", "BI_TODO", "CRED_TODO", "IDENTIFIED")


def _spread(pairs: DataFrame, rows: DataFrame, column: str, values: Sequence[str], id_col: str, when: Column | None = None) -> DataFrame:
    """(id, place, column, n) for every pair and value; ids of pairs are distinct."""
    count = [F.sum((F.col(column) == v).cast("long") if when is None else (when & (F.col(column) == v)).cast("long")).alias(f"_{k}") for k, v in enumerate(values)]
    counted = rows.groupBy(id_col).agg(*count)
    each = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(v).alias(column), F.coalesce(f"_{k}", F.lit(0)).alias("n")) for k, v in enumerate(values)))
    return pairs.select(id_col).join(counted, id_col, "left").select(id_col, F.inline(each))


def category_counts(pairs: DataFrame, found: DataFrame, categories: Sequence[str], id_col: str = "pair_id") -> DataFrame:
    """(id, place, category, n): the findings of each pair."""
    return _spread(pairs, found, "category", categories, id_col)


def group_counts(pairs: DataFrame, identified: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, group, n): values that are labelled or to be labelled."""
    return _spread(pairs, identified, "group", ("PI", "BI", "CRED"), id_col, F.col("category").isin(*_TODO)).drop("place")


def label_counts(pairs: DataFrame, detections: DataFrame, labels: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, label, detected, labeled) of the labels that a pair has on either side; both inputs have id and label."""
    from veilspark.functions.patterns import LABELS

    both = detections.select(id_col, "label", F.lit(1).alias("d")).union(labels.select(id_col, "label", F.lit(0))).where(F.col("label").isin(*(n for n, _ in LABELS)))
    counted = both.groupBy(id_col, "label").agg(F.sum("d").alias("detected"), F.sum(1 - F.col("d")).alias("labeled"))
    return counted.join(pairs.select(id_col), id_col, "left_semi")


def redaction_counts(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text") -> DataFrame:
    """(id, replaced, leaked, detections): of the values that count as sure, a row for each pair."""

    def counted(p: Pair) -> list[tuple]:
        walk = Walk(p)
        walk.all()
        return [(len({id(d) for d, _, _ in walk.replaced}), len(walk.leaked), len(walk.sure))]

    return pair_rows(pairs, counted, T.StructType([T.StructField(c, T.LongType()) for c in ("replaced", "leaked", "detections")]), id_col, left, right, None)


def navigation(issues: DataFrame, id_col: str = "pair_id", page: int = PAGE) -> DataFrame:
    """issues (id_col, id, ord) with next_id and previous_id, round the ends, and the page each is on."""
    w = Window.partitionBy(id_col).orderBy("ord", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return issues.select(
        "*", F.coalesce(F.lead("id").over(w), F.first("id").over(whole)).alias("next_id"), F.coalesce(F.lag("id").over(w), F.last("id").over(whole)).alias("previous_id"),
        (F.floor((F.row_number().over(w) - 1) / page) + 1).cast("int").alias("page"),
    )


def coverage(rows: DataFrame, ranges: DataFrame, moved: DataFrame, id_col: str = "pair_id", left: str = "left_rows", right: str = "right_rows") -> DataFrame:
    """Rows of each pair that were compared, not compared and moved. rows: arrays of both sides; ranges: comparable_range();
    moved: (id, moved). Where nothing is comparable, all rows are."""
    n, m = F.size(left), F.size(right)
    both = rows.join(ranges, id_col, "left").join(moved, id_col, "left")
    own = lambda side, size: F.coalesce(F.col(f"{side}_to") - F.col(f"{side}_from") + 1, size)
    return both.select(
        id_col, n.alias("left_rows"), m.alias("right_rows"), own("left", n).alias("compared_left"), own("right", m).alias("compared_right"),
        (n - own("left", n)).alias("not_compared_left"), (m - own("right", m)).alias("not_compared_right"), F.coalesce("moved", F.lit(0)).alias("moved_rows"),
    )
