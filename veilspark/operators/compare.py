"""Stage one: is everything personal in the original labelled on the right?

Both texts of a pair lie in one row, so alignment and matching are a narrow kernel; categories, statistics and decisions
are projections and aggregates over its rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import align, engine, known
from veilspark.functions.patterns import LABELS, REVIEW_THRESHOLD
from veilspark.functions.spans import Span
from veilspark.sources.html import parts

CATEGORIES = ("MISSED", "WRONG_LABEL", "OVERSCRUB", "NEEDS_REVIEW", "CORRECT")
IDENTIFY = ("PI_TODO", "BI_TODO", "CRED_TODO", "NOT_PII", "CHECK", "IDENTIFIED")
#: Agreement of two ranges, as overlap by hull, from which a label is right.
AGREE = 0.8

LABEL = T.StructType([T.StructField("label", T.StringType()), T.StructField("raw_label", T.StringType()), T.StructField("known", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("placeholder", T.BooleanType())])
FINDING = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("label", T.StringType()), T.StructField("right_label", T.StringType()),
    T.StructField("left_start", T.IntegerType()), T.StructField("left_end", T.IntegerType()), T.StructField("right_start", T.IntegerType()), T.StructField("right_end", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("note", T.StringType()),
])

Range = tuple[int, int]


def percent(x: float) -> int:
    return int(x * 100 + 0.5)


class Pair:
    """A pair of texts, its labels, its detections and the alignment of its words."""

    def __init__(self, left: str, right: str, labels: list[dict], found: list[Span] | None = None):
        self.left, self.right, self.labels = left, right, sorted(labels, key=lambda x: x["start"])
        self.found = engine.detect(left) if found is None else found
        self._order = sorted(range(len(self.found)), key=lambda k: self.found[k].start)
        self._starts = [self.found[k].start for k in self._order]
        self._reach = list(accumulate((self.found[k].end for k in self._order), max))

    # words are told and aligned when they are asked for: a pair without labels and detections has nothing to place
    @cached_property
    def lt(self) -> list[align.Token]:
        return align.tokens(self.left)

    @cached_property
    def rt(self) -> list[align.Token]:
        return self.lt if self.right == self.left else align.tokens(self.right)

    @cached_property
    def spans(self) -> list[Range | None]:
        return [align.touched(self.rt, x["start"], x["end"]) for x in self.labels]

    @cached_property
    def a(self) -> align.Alignment:
        words = [t.low for t in self.rt]
        for k, (x, s) in enumerate(zip(self.labels, self.spans)):
            if s and x["placeholder"]:  # stands for other words and matches none
                for i in range(s[0], s[1] + 1):
                    words[i] = f"\0{k}:{i}"
        return align.Alignment([t.low for t in self.lt], words)

    def overlapping(self, start: int, end: int) -> list[int]:
        """The detections that overlap a range, from the last that begins before its end back to where none reaches into it."""
        i, out = bisect_left(self._starts, end), []
        while i and self._reach[i - 1] > start:
            i -= 1
            if self.found[self._order[i]].end > start:
                out.append(self._order[i])
        return sorted(out)

    def findings(self) -> list[tuple]:
        """FINDING rows, sorted, ids made unique."""
        out: list[dict] = []
        matches: dict[int, list] = {}

        def add(category: str, label: str, right_label: str | None, left: Range | None, right: Range | None, text: str, note: str, d: Span | None = None) -> None:
            place = f"{left[0]}-{left[1]}" if left else "r" + (f"{right[0]}-{right[1]}" if right else "")
            out.append({"id": f"{category}|{label}|{right_label or ''}|{place}", "category": category, "label": label, "right_label": right_label, "left": left, "right": right, "text": text, "confidence": d.confidence if d else None, "source": d.source if d else "right", "rule": d.rule if d else None, "note": note})

        for x, span in zip(self.labels, self.spans):
            name, right = x["label"], (x["start"], x["end"])
            at = align.mapped(*span, self.a.right, self.lt) if span else None
            left = at[:2] if at else None
            said = self.left[slice(*left)] if left else x["text"]
            if not x["known"]:
                add("NEEDS_REVIEW", name, name, left, right, said, f'Unrecognised label name "{x["raw_label"] or name}" on the right. Add it to labelAliases in selectors.js.')
                continue
            if not left:
                add("NEEDS_REVIEW", name, name, None, right, said, "Couldn't line this label up with the left document. Check it by hand.")
                continue
            over = [(min(self.found[k].end, left[1]) - max(self.found[k].start, left[0]), self.found[k].label == name, k) for k in self.overlapping(*left)]
            best = max(over)[2] if over else None
            if over:  # the most overlap; of equals the last of the same label, else the first
                most = max(o for o, _, _ in over)
                equal = [(same, k) for o, same, k in over if o == most]
                best = max((k for same, k in equal if same), default=equal[0][1])
            d = self.found[best] if best is not None else None
            if name == "Overscrubbed":
                if best is not None:
                    matches.setdefault(best, []).append(None)
                if d and d.confidence >= REVIEW_THRESHOLD:
                    add("NEEDS_REVIEW", d.label, name, left, right, said, f"Marked Overscrubbed, but this looks like {d.label}.", d)
                else:
                    add("CORRECT", name, name, left, right, said, "Overscrubbed label agrees: no PII detected here.")
            elif d is None:
                hit = next(iter(known.find(said)), None)
                if hit:
                    note = f"“{hit.text}” is on the business names list ({hit.category}): a well-known name, not PII. Labeling it {name} is over-scrubbing — mark it Overscrubbed."
                elif name == "Person DOB":
                    note = "Labeled Person DOB on the right, but this is not a date of birth. Only dates of birth count as PII — mark it Overscrubbed if so."
                else:
                    note = f"Labeled {name} on the right, but no PII was detected here. If it is not PII, mark it Overscrubbed."
                add("OVERSCRUB", name, name, left, right, said, note)
            else:
                matches.setdefault(best, []).append((name, left, right))

        hull = lambda rs: (min(r[0] for r in rs), max(r[1] for r in rs))
        for k, d in enumerate(self.found):
            own, low, place = matches.get(k, []), d.confidence < REVIEW_THRESHOLD, (d.start, d.end)
            if None in own:
                continue
            if not own:
                span = align.touched(self.lt, *place)
                at = align.mapped(*span, self.a.left, self.rt) if span else None
                note = f"Possibly {d.label} (low confidence, {percent(d.confidence)}%). Not labeled on the right." if low else f"{d.label} found on the left but not labeled on the right."
                add("NEEDS_REVIEW" if low else "MISSED", d.label, None, place, at[:2] if at else None, d.text, note, d)
            by: dict[str, list] = {}
            for m in own:
                by.setdefault(m[0], []).append(m)
            if same := by.pop(d.label, None):
                a, right = hull([m[1] for m in same]), hull([m[2] for m in same])
                agree = max(0, min(a[1], d.end) - max(a[0], d.start)) / (max(a[1], d.end) - min(a[0], d.start))
                if agree >= AGREE:
                    add("CORRECT", d.label, d.label, place, right, d.text, "Label matches.", d)
                else:
                    add("NEEDS_REVIEW", d.label, d.label, place, right, d.text, f'Boundary mismatch: the right labels "{self.left[slice(*a)]}", the detector found "{d.text}".', d)
            for name, ms in by.items():
                note = f"Labeled {name} on the right; the detector suggests {d.label} with low confidence ({percent(d.confidence)}%)." if low else f"Labeled {name} on the right, but this looks like {d.label}."
                add("NEEDS_REVIEW" if low else "WRONG_LABEL", d.label, name, place, hull([m[2] for m in ms]), d.text, note, d)

        out.sort(key=lambda f: (f["left"][0] if f["left"] else float("inf"), f["right"][0] if f["right"] else 0))
        return rows_of(out)


def rows_of(findings: list[dict]) -> list[tuple]:
    seen: dict[str, int] = {}
    rows = []
    for k, f in enumerate(findings):
        n = seen[f["id"]] = seen.get(f["id"], -1) + 1
        left, right = f["left"] or (None, None), f["right"] or (None, None)
        rows.append((k, f["id"] + (f"#{n}" if n else ""), f["category"], f["label"], f["right_label"], *left, *right, f["text"], f["confidence"], f["source"], f["rule"], f["note"]))
    return rows


def pair_rows(pairs: DataFrame, make, schema: T.StructType, id_col: str, left: str, right: str, labels: str | None) -> DataFrame:
    """Runs make(Pair) for every row; schema is of its rows."""
    out = T.StructType([T.StructField(id_col, pairs.schema[id_col].dataType), *schema])
    source = known.current()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        known.use(source)
        arrow = to_arrow_schema(out)
        for b in (part for batch in batches for part in parts(batch)):
            place, rows = [], []
            for k, r in enumerate(b.to_pylist()):
                made = make(Pair(r["_left"] or "", r["_right"] or "", r["_labels"] or []))
                place += [k] * len(made)
                rows += made
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int32())), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    marks = F.col(labels) if labels else F.lit(None)
    return pairs.select(id_col, F.col(left).cast("string").alias("_left"), F.col(right).cast("string").alias("_right"), marks.cast(T.ArrayType(LABEL)).alias("_labels")).mapInArrow(run, out)


def compare(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text", labels: str | None = "labels") -> DataFrame:
    """FINDING rows of every pair."""
    return pair_rows(pairs, Pair.findings, FINDING, id_col, left, right, labels)


def group_of(label: Column) -> Column:
    names = {g: [n for n, x in LABELS if x == g] for g in ("PI", "BI", "CRED")}
    return F.when(label.isin(names["PI"]), "PI").when(label.isin(names["BI"]), "BI").when(label.isin(names["CRED"]), "CRED")


def identify(found: DataFrame) -> DataFrame:
    """compare()'s rows with what is to be done: category, group, status, suggest, note and id."""
    c, group = F.col("category"), group_of(F.col("label"))
    todo = F.coalesce(F.concat(group, F.lit("_TODO")), F.lit("PI_TODO"))
    over = (c == "CORRECT") & (F.col("label") == "Overscrubbed")
    unsure = (c == "NEEDS_REVIEW") & (group.isNull() | (F.col("source") == "right"))
    return found.select(
        *(F.col(x) for x in found.columns if x not in ("category", "note", "id")), F.concat(F.lit("L1|"), "id").alias("id"),
        F.when(over | (c == "OVERSCRUB"), "NOT_PII").when(c == "CORRECT", "IDENTIFIED").when(unsure, "CHECK").otherwise(todo).alias("category"),
        F.when(c == "OVERSCRUB", None).otherwise(group).alias("group"),
        F.when(over | (c == "OVERSCRUB"), "extra").when(c == "CORRECT", "labeled").when(c == "MISSED", "unlabeled").when(c == "WRONG_LABEL", "wrong").when(unsure | F.col("right_label").isNotNull(), "check").otherwise("unlabeled").alias("status"),
        F.when(over | (c == "OVERSCRUB"), "not").when(c == "NEEDS_REVIEW", "unsure").otherwise("yes").alias("suggest"),
        F.when(over, F.lit("Marked Overscrubbed; no PII found here.")).when(c == "CORRECT", F.concat(F.lit("Labeled "), "label", F.lit(".")))
        .when(c == "MISSED", F.concat(F.lit("Not labeled yet — label it as "), "label", F.lit("."))).when(c == "WRONG_LABEL", F.concat(F.lit("Labeled "), "right_label", F.lit(" — it looks like "), "label", F.lit("."))).otherwise(F.col("note")).alias("note"),
    )


def filled_counts(rows: DataFrame, column: str, values: tuple[str, ...], name: str = "n") -> DataFrame:
    """Counts of a column's values, 0 for those that don't occur; values is a small fixed dimension."""
    spark = rows.sparkSession
    dimension = spark.sql("select * from values " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(values)) + f" as t(place, {column})")
    return F.broadcast(dimension).join(rows.groupBy(column).agg(F.count("*").alias(name)), column, "left").select(column, "place", F.coalesce(name, F.lit(0)).alias(name))
