"""What a reviewer sees of the findings of both stages, and what their decisions mean; projections, interval joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import extract
from veilspark.plans import intervals

# FIXED VALUES: the labels of the review site, in its order, and which of them stand for ours
SITE_LABELS = ("Account Number", "Address", "Business Name", "Contact Number", "Credentials", "Date", "Email Address", "IP Address", "Overscrubbed", "Person Name", "URL/Link", "Person Username", "Vehicle Number Plate")
TO_SITE = {
    "Person Name": "Person Name", "Person Email": "Email Address", "Business Email": "Email Address", "Person Phone No": "Contact Number", "Business Phone No": "Contact Number",
    "Person DOB": "Date", "Person Address": "Address", "Business Address": "Address", "Person Username": "Person Username", "Business Username": "Person Username",
    "Business Name": "Business Name", "Account Number": "Account Number", "Account ID": "Account Number", "IFSC Code": "Account Number", "Credit/Debit Card No": "Account Number",
    "Card ID": "Account Number", "UPI ID": "Account Number", "Transaction ID": "Account Number", "IP/MAC Address": "IP Address", "Password": "Credentials",
    "API/Private Keys": "Credentials", "SHA/SSH/Hash Key": "Credentials", "VPC ID": "Credentials", "Invocation ID": "Credentials", "Aadhar Card No": "Credentials",
    "PAN Card Number": "Credentials", "Driving License No": "Credentials", "Voter ID": "Credentials", "Overscrubbed": "Overscrubbed",
}
EXTRAS = (
    ("URL/Link", r"(?i)(?:https?:\/\/|www\.)[^\s<>\"')]+|(?:[a-z0-9-]+\.)+(?:com|in|io|org|net|co|ai|dev|me)\/[^\s<>\"')]+"),
    ("Vehicle Number Plate", r"(?<![A-Za-z0-9_])[A-Z]{2}[ -]?\d{1,2}[ -]?[A-Z]{1,3}[ -]?\d{4}(?![A-Za-z0-9_])"),
)


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def site_label(label: Column) -> Column:
    return F.when(label.isin(*SITE_LABELS), label).otherwise(F.try_element_at(_map(TO_SITE), label))


def reading(t: Column) -> Column:
    """Text as a misreading eye sees it."""
    for pattern, to in (("rn", "m"), (r"[il1|!]", "l"), ("0", "o"), (r"[^\p{L}\p{N}]+", "")):
        t = F.regexp_replace(t if pattern != "rn" else F.lower(t), pattern, to)
    return t


def same_reading(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (reading(a) == reading(b)), F.lit(False))


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def extras(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, site, text): links and number plates, which have a site label but no rule."""
    found = [docs.select(id_col, F.lit(site).alias("site"), F.explode(F.transform(extract.values(F.col(text_col), p), lambda v: F.regexp_replace(v, r"[.,;:]+\z", ""))).alias("text")) for site, p in EXTRAS]
    return found[0].union(found[1])


def placed_extras(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, site, text, start, end): extras with their places, from the texts between the matches."""
    out = []
    for site, p in EXTRAS:
        hits, gaps = F.regexp_extract_all(text_col, F.lit(p), F.lit(0)), F.split(text_col, p, -1)
        each = docs.where(F.col(text_col).rlike(p)).select(id_col, gaps.alias("g"), hits.alias("h")).select(id_col, "g", "h", F.posexplode("h").alias("k", "v"))
        size = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
        start = size(F.col("g"), F.col("k") + 1) + size(F.col("h"), F.col("k"))
        out.append(each.select(id_col, F.lit(site).alias("site"), F.regexp_replace("v", r"[.,;:]+\z", "").alias("text"), start.alias("start")))
    return out[0].union(out[1]).withColumn("end", F.col("start") + F.length("text"))


def extras_beside(extras: DataFrame, found: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Extras that no item (id, b_start, b_end) overlaps."""
    return intervals.overlap_join(extras, found, id_col, "left_anti").select(*extras.columns)


def items(l1: DataFrame, l2: DataFrame, labels: DataFrame | None = None, id_col: str = "pair_id") -> DataFrame:
    """A row for each value found in the original: its site label, whether it is labelled (yes, no, other), how it is redacted, ok.

    l1: identify()'s rows; l2: verify()'s; labels: (id, b_start, b_end, raw_label) on the right."""
    site = site_label(F.col("label"))
    rows = l1.where("category in ('PI_TODO', 'BI_TODO', 'CRED_TODO', 'IDENTIFIED') and left_start is not null").withColumn("site", site).where("site is not null")
    rows = rows.withColumn("right_site", F.coalesce(site_label(F.col("right_label")), "right_label"))
    rows = rows.withColumn("labeled", F.when(F.col("status") == "labeled", "yes").when(F.col("right_site").isNull(), "no").when(F.col("right_site") == F.col("site"), "yes").otherwise("other"))
    rows = rows.withColumnsRenamed({"left_start": "start", "left_end": "end"})
    other = l2.where("left_start is not null and category not in ('UNKNOWN_TEXT', 'TASK')").select(id_col, F.col("left_start").alias("b_start"), F.col("left_end").alias("b_end"), F.col("ord").alias("b_ord"), F.col("category").alias("b_category"), F.col("note").alias("b_note"), F.col("right_start").alias("b_right_start"), F.col("right_end").alias("b_right_end"))
    met = intervals.overlap_join(rows.select(id_col, "id", "start", "end"), other, id_col)
    first = met.groupBy(id_col, "id").agg(F.min_by(F.struct("b_category", "b_note", "b_right_start", "b_right_end"), "b_ord").alias("m")).select(id_col, "id", "m.*")
    c = F.col("b_category")
    redaction = F.when(c == "LEAKAGE", F.when(F.col("b_note").contains("partly"), "partly").otherwise("visible")).when(c == "UNSURE", "visible").when(c.isin("INCOHERENT", "DATATYPE", "NOT_SENSIBLE"), "replacement").when(c.isNotNull(), "redacted")
    out = rows.drop("note").join(first, [id_col, "id"], "left").withColumn("redaction", redaction)
    out = out.withColumn("right_end", F.coalesce(F.when(F.col("right_start").isNotNull(), F.col("right_end")), "b_right_end")).withColumn("right_start", F.coalesce("right_start", "b_right_start"))
    if labels is not None:
        ranges = out.where("labeled = 'no' and right_start is not null").select(id_col, "id", "site", F.col("right_start").alias("start"), F.col("right_end").alias("end"))
        on = intervals.overlap_join(ranges, labels, id_col).withColumn("s", F.coalesce(site_label(F.col("raw_label")), "raw_label"))
        on = on.groupBy(id_col, "id").agg(F.min_by("s", "b_start").alias("on_site"), F.max(F.col("s") == F.col("site")).alias("on_own"))
        out = out.join(on, [id_col, "id"], "left").withColumn("right_site", F.coalesce("on_site", "right_site")).withColumn("labeled", F.when(F.col("on_site").isNull(), F.col("labeled")).when(F.col("on_own"), "yes").otherwise("other")).drop("on_site", "on_own")
    ok = (F.col("labeled") == "yes") & F.coalesce(F.col("redaction") == "redacted", F.lit(True))
    return out.select(id_col, "id", "site", "text", "labeled", "right_site", "start", "end", "right_start", "right_end", "confidence", "redaction", F.col("b_note").alias("note"), ok.alias("ok"))


def other_changes(l2: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Short swaps of words that are nothing personal; noise: moved text, misreadings and long stretches, and why they are none."""
    changes = l2.where("category in ('OVER_REDACTED', 'UNKNOWN_TEXT')")
    placed = changes.where("left_start is not null").withColumn("w", word_count(F.col("text")))
    before = F.lag("left_end").over(Window.partitionBy(id_col).orderBy("left_start", "ord"))
    new = F.when(before.isNull() | (F.col("left_start") - before > 12), 1).otherwise(0)
    groups = placed.withColumn("_new", new).withColumn("g", F.sum("_new").over(Window.partitionBy(id_col).orderBy("left_start", "ord")))
    sized = groups.withColumn("cluster_words", F.sum("w").over(Window.partitionBy(id_col, "g"))).select(id_col, "id", "cluster_words")
    swap = r"“([^”]*)” → “([^”]*)”"
    rows = changes.join(sized, [id_col, "id"], "left")
    swapped = F.col("note").rlike(swap)
    was, now = F.when(swapped, F.regexp_extract("note", swap, 1)).otherwise(F.col("text")), F.when(swapped, F.regexp_extract("note", swap, 2)).otherwise("")
    noise = (F.col("category") == "UNKNOWN_TEXT") | same_reading(was, now) | (word_count(was) > 3) | (word_count(now) > 4) | (F.coalesce("cluster_words", F.lit(0)) > 3)
    return rows.select(id_col, "id", F.lit("overscrub").alias("kind"), "text", "note", "known_name", was.alias("was"), now.alias("now"), noise.alias("noise"), "right_start", "right_end")


def summary(found: DataFrame, other: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, pii, labeled, visible, problems, layout_noise, done)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = found.groupBy(id_col).agg(F.count("*").alias("pii"), count(F.col("labeled") == "yes").alias("labeled"), count(F.coalesce(F.col("redaction").isin("visible", "partly"), F.lit(False))).alias("visible"), count(~F.col("ok")).alias("p"))
    b = other.groupBy(id_col).agg(count(~F.col("noise")).alias("q"), count(F.col("noise")).alias("layout_noise"))
    out = a.join(b, id_col, "full").na.fill(0)
    return out.select(id_col, "pii", "labeled", "visible", (F.col("p") + F.col("q")).alias("problems"), "layout_noise", ((F.col("p") + F.col("q")) == 0).alias("done"))


def outcome(stage: str, verdict: Column | str = "verdict") -> tuple[Column, Column, Column]:
    """(fix, kind, text) of a decision on a finding; null without one. verdict: yes or no in stage L1, redact or keep in L2."""
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    text, status, c = F.lit, F.col("status") if stage == "L1" else None, F.col("category")
    if stage == "L1":
        marked = status.isin("labeled", "wrong", "extra") | ((status == "check") & F.col("right_label").isNotNull())
        kind = F.when((v == "yes") & (status == "unlabeled"), "label").when((v == "yes") & (status == "wrong"), "relabel").when((v != "yes") & marked, "remove")
        said = (
            F.when((v == "yes") & (status == "unlabeled"), F.concat(text("To do: label it as "), "label", text(" on the site.")))
            .when((v == "yes") & (status == "wrong"), F.concat(text("To do: change the label from "), "right_label", text(" to "), "label", text(".")))
            .when((v == "yes") & (status == "extra"), "Keep the label.").when(v == "yes", "Identified.")
            .when(marked, "To do: remove this label (or mark it Overscrubbed).").otherwise("Correctly left unlabeled.")
        )
    else:
        done, bad = c.isin("OVER_REDACTED", "REDACTED_OK", "INCOHERENT", "DATATYPE", "NOT_SENSIBLE"), c.isin("INCOHERENT", "DATATYPE", "NOT_SENSIBLE")
        kind = F.when((v == "redact") & ~done, "missed").when((v == "keep") & done, "over").when((v == "redact") & bad, "quality")
        said = F.when(kind == "missed", "Missed redaction — the right side must redact this.").when(kind == "over", "Over-redaction — the right side must keep the original words.").when(kind == "quality", "Correct to redact, but the replacement must be fixed.").when(v == "redact", "Correctly redacted.").otherwise("Correctly kept as is.")
    given = v.isNotNull()
    return F.when(given, kind.isNotNull()), F.when(given, kind), F.when(given, said)


def suggested(stage: str) -> Column:
    s = F.col("suggest")
    return F.when(s == "yes", "yes").when(s == "not", "no") if stage == "L1" else F.when(s.isin("redact", "keep"), s)


def decided(findings: DataFrame, verdicts: DataFrame, stage: str, id_col: str = "pair_id") -> DataFrame:
    """findings with the verdicts (id, verdict) on them and what these mean."""
    fix, kind, text = outcome(stage)
    return findings.join(verdicts, [id_col, "id"], "left").withColumns({"fix": fix, "kind": kind, "outcome": text})


def decision_summary(rows: DataFrame, id_col: str = "pair_id") -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(id_col).agg(count(F.col("verdict").isNull()).alias("open"), count(F.col("fix") == F.lit(False)).alias("ok"), count(F.col("fix")).alias("fix"))


def question(stage: str) -> tuple[Column, Column, Column]:
    """(ask, suggestion, tone) of a finding."""
    s = F.col("suggest")
    tone = {"yes": "redact", "not": "keep"} if stage == "L1" else {"redact": "redact", "keep": "keep"}
    toned = F.coalesce(F.try_element_at(_map(tone), s), F.lit("unsure"))
    if stage == "L1":
        group = F.coalesce(F.try_element_at(_map({"PI": "Personal PII", "BI": "Business PII", "CRED": "a Credential"}), F.col("group")), F.lit("PII"))
        said = F.when(s == "yes", F.concat(F.lit("Assistant: "), group, F.lit(" — label it as "), "label")).when(s == "not", "Assistant: no PII found here").otherwise("Assistant: not sure — your call")
        return F.lit("Is it PII?"), said, toned
    said = F.when(s == "redact", "Assistant: PII — should be redacted").when(s == "keep", "Assistant: not PII — keep the original").otherwise("Assistant: not sure — your call")
    return F.lit("Should it be redacted?"), said, toned


def short_status(stage: str) -> Column:
    """Two or three words on a finding."""
    c, note = F.col("category"), F.coalesce("note", F.lit(""))
    if stage == "L1":
        s = F.col("status")
        known = note.contains("is on the business names list")
        return F.when(known, "Over-scrubbing").when(s == "unlabeled", "Not labeled").when(s == "wrong", F.concat(F.lit("Labeled "), F.coalesce("right_label", F.lit("differently")))).when(s == "extra", "Extra label").when(s == "labeled", "Labeled ✓").otherwise("Check it")
    plain = {"UNSURE": "Possible PII", "INCOHERENT": "Inconsistent", "DATATYPE": "Wrong data type", "NOT_SENSIBLE": "Not realistic", "REDACTED_OK": "Redacted ✓", "TASK": "Whole task"}
    leak = F.when(note.contains("partly"), "Partly redacted").when(note.contains("another"), "Leaked elsewhere").otherwise("Not redacted")
    return (
        F.when(c == "LEAKAGE", leak).when(c == "OVER_REDACTED", F.when(F.col("known_name").isNotNull(), "Over-scrubbing").otherwise("Changed — PII?"))
        .when(c == "UNKNOWN_TEXT", F.when(note.contains("not in the original"), "Text added").otherwise("Words missing")).otherwise(F.coalesce(F.try_element_at(_map(plain), c), F.lit("")))
    )


def open_issues(findings: DataFrame, verdicts: DataFrame, search: str = "", id_col: str = "pair_id") -> DataFrame:
    """Findings that are issues, have no verdict, and hold the search text in what they say."""
    said = F.lower(F.concat_ws(" ", "text", "label", "note"))
    issues = findings.where(~F.col("category").isin("REDACTED_OK", "IDENTIFIED", "CORRECT"))
    return issues.where(said.contains(search.lower())).join(verdicts.select(id_col, "id"), [id_col, "id"], "left_anti")


def marks(found: DataFrame, boxes: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """A rectangle for each row of words that an item covers: the hull of its words. boxes: (id, b_start, b_end, row, x, y, w, h)."""
    met = intervals.overlap_join(found.select(id_col, "id", "start", "end"), boxes, id_col)
    x2, y2 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return met.groupBy(id_col, "id", "row").agg(F.min("x").alias("x"), F.min("y").alias("y"), (x2 - F.min("x")).alias("w"), (y2 - F.min("y")).alias("h"))


def tags() -> Column:
    """What an item's mark says: its site label, whether that is missing or another, how it is redacted."""
    return F.concat_ws(" · ", "site", F.when(F.col("labeled") == "no", "not labeled").when(F.col("labeled") == "other", F.concat(F.lit("labeled "), "right_site")), F.when(F.col("redaction").isin("visible", "partly", "replacement"), F.col("redaction")))
