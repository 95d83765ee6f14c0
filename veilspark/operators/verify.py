"""Stage two: is everything personal redacted, and redacted well?

A narrow kernel walks the aligned words of a pair and returns leaks, changed words and replacements. Whether a
replacement is of the right kind, reads like real text and is used coherently is decided by expressions and windows over
its rows, all partitioned by the pair."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import align, known, replacement
from veilspark.functions.language import document_report, structure_reasons
from veilspark.functions.patterns import REVIEW_THRESHOLD
from veilspark.functions.spans import Span
from veilspark.plans.materialize import once
from veilspark.operators.compare import Pair, pair_rows, percent

CATEGORIES = ("LEAKAGE", "INCOHERENT", "DATATYPE", "NOT_SENSIBLE", "OVER_REDACTED", "UNKNOWN_TEXT", "UNSURE", "REDACTED_OK", "TASK")
SUGGEST = {"LEAKAGE": "redact", "REDACTED_OK": "redact", "INCOHERENT": "redact", "DATATYPE": "redact", "NOT_SENSIBLE": "redact", "OVER_REDACTED": "keep", "UNSURE": "unsure"}

# FIXED VALUES: words that addresses and companies share
ADDRESS_COMMON = (
    "flat no house plot door road rd street st main cross nagar layout sector block lane colony apartment apartments apts apt floor tower society marg "
    "avenue ave phase stage near opp behind city district state pin pincode india bengaluru bangalore mumbai delhi chennai hyderabad pune kolkata noida "
    "gurugram karnataka maharashtra tamil nadu kerala telangana st nd rd th"
)
BUSINESS_COMMON = "pvt private ltd limited inc llc llp corp corporation co company group technologies technology tech solutions services systems industries enterprises the and of bank"
_ADDRESS, _BUSINESS = set(ADDRESS_COMMON.split()), set(BUSINESS_COMMON.split())
_NUMBERS = ("Person Phone No", "Business Phone No", "Account Number", "Credit/Debit Card No", "Aadhar Card No", "Account ID")

RAW = T.StructType([
    T.StructField("phase", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("category", T.StringType()), T.StructField("label", T.StringType()),
    *(T.StructField(c, T.IntegerType()) for c in ("left_start", "left_end", "right_start", "right_end")), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()), T.StructField("note", T.StringType()), T.StructField("known_name", T.StringType()),
    T.StructField("replacement", T.StringType()), T.StructField("leaked", T.BooleanType()), T.StructField("right_text", T.StringType()),
])
_COLUMNS = ("category", "label", "left_start", "left_end", "right_start", "right_end", "text", "confidence", "source", "note", "known_name")


def one_line(s: str) -> str:
    s = " ".join(s.split())
    return s[:79] + "…" if len(s) > 80 else s


def _figures(words: list[str], least: int) -> list[str]:
    return [w for w in words if w.isascii() and w.isdigit() and len(w) >= least]


def _of_numbers(words: list[str], d: Span, kept: list, every: list) -> str:
    return " ".join(_figures(words, 4))


def _of_dates(words: list[str], d: Span, kept: list, every: list) -> str:
    return " ".join(words) if len(_figures(words, 1)) >= 2 else ""


def _of_hosts(words: list[str], d: Span, kept: list, every: list) -> str:
    return ".".join(words) if sum(set(w) <= set("0123456789abcdef") for w in words) >= 3 else ""


def _of_mails(words: list[str], d: Span, kept: list, every: list) -> str:
    """The part before the sign, if all of it stayed."""
    sign = d.start + d.text.find("@")
    local = [t.low for t in kept if t.start < sign]
    return ".".join(local) if len(local) == sum(t.start < sign for t in every) else ""


def _of_places(words: list[str], d: Span, kept: list, every: list) -> str:
    own = [w for w in words if w not in _ADDRESS and not (w in _figures(words, 1) and len(w) <= 2)]
    return " ".join(own + _figures(words, 3)) if _figures(words, 3) or len(own) >= 2 else ""


def _of_companies(words: list[str], d: Span, kept: list, every: list) -> str:
    return " ".join(w for w in words if w not in _BUSINESS)


def _of_others(words: list[str], d: Span, kept: list, every: list) -> str:
    return " ".join(w for w in words if len(w) >= 2)


#: What kept words give away, by label.
_GIVEN_AWAY = {
    **dict.fromkeys(_NUMBERS, _of_numbers), "Person DOB": _of_dates, "IP/MAC Address": _of_hosts, "Person Email": _of_mails, "Business Email": _of_mails,
    "Person Address": _of_places, "Business Address": _of_places, "Business Name": _of_companies,
}


def partial_leak(d: Span, kept: list[align.Token], every: list[align.Token]) -> str | None:
    """What words of a value, kept on the right, give away; None for what such values share."""
    return _GIVEN_AWAY.get(d.label, _of_others)([t.low for t in kept], d, kept, every) or None


class Walk:
    def __init__(self, p: Pair):
        self.p, self.rows, self.leaked, self.replaced = p, [], set(), []
        self.sure = [k for k, d in enumerate(p.found) if d.confidence >= REVIEW_THRESHOLD]

    @cached_property
    def known(self) -> list[known.Known]:
        """Public names, asked for where words changed that no detection holds."""
        return [k for k in known.find(self.p.left) if not any(self.p.found[i].label == "Person Name" for i in self.p.overlapping(k.start, k.end))]

    def add(self, phase: int, category: str, label: str | None, left, right, text: str, note: str | None, d: Span | None = None, source: str = "L2", name: str | None = None, replaced: str | None = None, leaked: bool = False) -> None:
        said = self.p.right[slice(*right)] if right else None
        self.rows.append((phase, len(self.rows), category, label, *(left or (None, None)), *(right or (None, None)), text, d.confidence if d else None, d.source if d else source, note, name, replaced, leaked, said))

    def words(self, d: Span) -> list[int]:
        at = align.touched(self.p.lt, d.start, d.end)
        return list(range(at[0], at[1] + 1)) if at else []

    def between(self, first: int, last: int) -> tuple[int, int] | None:
        low, high = align.neighbours(self.p.a.left, first, last, len(self.p.rt))
        return (self.p.rt[low + 1].start, self.p.rt[high - 1].end) if low + 1 <= high - 1 else None

    def replacement(self, d: Span, first: int, last: int, keep_empty: bool) -> None:
        right = self.between(first, last)
        if right or keep_empty:
            self.replaced.append([d, self.p.right[slice(*right)].strip() if right else "", right or (0, 0)])

    def partly(self) -> set[int]:
        """Values of which some words stayed."""
        p, out, shared = self.p, set(), []
        for k in self.sure:
            d, idx = p.found[k], [i for i in self.words(p.found[k]) if align.wordy(p.lt[i].low)]
            kept = [i for i in idx if p.a.left[i] >= 0]
            if not kept or len(kept) == len(idx):
                continue
            out.add(k)
            part = partial_leak(d, [p.lt[i] for i in kept], [p.lt[i] for i in idx])
            if part is None:
                shared.append((d, self.words(d)[0], idx[-1]))
                continue
            self.leaked.add(k)
            place = p.rt[p.a.left[kept[0]]].start, p.rt[p.a.left[kept[-1]]].end
            self.add(0, "LEAKAGE", d.label, (d.start, d.end), place, d.text, f"{d.label} only partly redacted: “{part}” from “{d.text}” is still visible on the right.", d)
        self.shared = shared
        return out

    def changes(self, partly: set[int]) -> None:
        p, whole = self.p, {}
        edge = lambda ts, a, b, n: (ts[a].start, ts[b - 1].end) if b > a else ((ts[a].start if a < len(ts) else n),) * 2
        for i0, i1, j0, j1 in () if p.left == p.right and not p.labels else align.hunks(p.a):
            left, right = edge(p.lt, i0, i1, len(p.left)), edge(p.rt, j0, j1, len(p.right))
            said, now = p.left[slice(*left)], p.right[slice(*right)]
            ks = p.overlapping(*left)
            if not ks:
                lw, rw = any(align.wordy(t.low) for t in p.lt[i0:i1]), any(align.wordy(t.low) for t in p.rt[j0:j1])
                hit = next((k for k in self.known if k.start < left[1] and k.end > left[0]), None) if lw else None
                more = f" “{hit.text}” is on the business names list ({hit.category}): a well-known name that must stay as it is." if hit else ""
                at, text = ((hit.start, hit.end), hit.text) if hit else (left, said)
                if lw and rw:
                    note = f"Over-scrubbing: “{one_line(said)}” was replaced with “{one_line(now)}”.{more}" if hit else f"Redacted on the right (“{one_line(said)}” → “{one_line(now)}”), but no PII was found here. If it is not PII, the original words must be kept."
                    self.add(1, "OVER_REDACTED", None, at, right, text, note, name=hit and hit.name)
                elif rw:
                    self.add(1, "UNKNOWN_TEXT", None, None, right, now, f"Text on the right that is not in the original: “{one_line(now)}”.")
                elif lw:
                    note = f"Over-scrubbing: “{one_line(said)}” was removed on the right.{more}" if hit else f"Original words are missing on the right: “{one_line(said)}”."
                    self.add(1, "OVER_REDACTED" if hit else "UNKNOWN_TEXT", None, at, None, text, note, name=hit and hit.name)
                continue
            outside = [t for t in p.lt[i0:i1] if align.wordy(t.low) and not any(t.start < p.found[k].end and t.end > p.found[k].start for k in ks)]
            if outside:
                self.add(1, "OVER_REDACTED", None, left, right, said, f"More than the PII was redacted: “{one_line(said)}” became “{one_line(now)}”. Words that are not PII ({one_line(' '.join(t.low for t in outside))}) should be kept.")
            if len(ks) > 1:
                self.add(1, "SEVERAL", p.found[ks[0]].label, left, right, said, None, replaced=now)
            elif ks[0] not in partly:
                whole[ks[0]] = None
        for k in whole:
            at = self.words(p.found[k])
            if at:
                self.replacement(p.found[k], at[0], at[-1], True)
        for d, a, b in self.shared:
            self.replacement(d, a, b, False)

    def leaks(self) -> None:
        """Values that are on the right as whole words; each token sequence is looked for once, from its first token on."""
        p, by = self.p, {}
        seen = set()
        for k in self.sure:
            key = tuple(t.low for t in align.tokens(p.found[k].text))
            if key and key not in seen and len(re.findall("[A-Za-z0-9_]", p.found[k].text)) >= 3:
                seen.add(key)
                by.setdefault(key[0], []).append((key, k))
        same = lambda a, b: " ".join(a.lower().split()) == " ".join(b.lower().split())
        j = 0
        while by and j < len(p.rt):
            for key, k in by.get(p.rt[j].low, ()):
                n = len(key)
                place = (p.rt[j].start, p.rt[min(j + n, len(p.rt)) - 1].end)
                around = p.right[max(0, place[0] - 1) : place[0]] + p.right[place[1] : place[1] + 1]
                if tuple(t.low for t in p.rt[j : j + n]) != key or align.wordy(around):
                    continue
                i, own = p.a.right[j], None
                if i >= 0:
                    own = next((c for c, d in enumerate(p.found) if d.start <= p.lt[i].start < d.end and same(d.text, p.found[k].text)), None)
                d = p.found[k if own is None else own]
                if own is not None:
                    self.leaked.add(own)
                note = f"{d.label} “{d.text}” from the original appears on the right (redacted in one place, leaked in another)." if own is None else f"{d.label} was not redacted: “{d.text}” appears unchanged on the right."
                self.add(2, "LEAKAGE", d.label, (d.start, d.end), place, d.text, note, d)
                j += n - 1
                break
            j += 1

    def unsure(self) -> None:
        p = self.p
        for k, d in enumerate(p.found):
            at = self.words(d)
            if d.confidence < REVIEW_THRESHOLD and k not in self.leaked and at and all(p.a.left[i] >= 0 for i in at):
                place = p.rt[p.a.left[at[0]]].start, p.rt[p.a.left[at[-1]]].end
                self.add(3, "UNSURE", d.label, (d.start, d.end), place, d.text, f"Not redacted on the right. Possibly {d.label} ({percent(d.confidence)}% sure) — decide whether it should be redacted.", d)

    def glued(self) -> None:
        """A sentence behind a replacement is text of its own."""
        for r in self.replaced:
            m = None if re.search(r"[.!?]\s", r[0].text) else re.search(r"[.!?]\s+(?=\S)", r[1])
            at = self.p.right.find(r[1], r[2][0]) if m else -1
            if at >= 0:
                rest, r[1:] = r[1][m.end() :], [r[1][: m.start()].strip(), (at, at + m.start())]
                self.add(4, "UNKNOWN_TEXT", None, None, (at + m.end(), at + m.end() + len(rest)), rest, f"Text on the right that is not in the original: “{one_line(rest)}”.")

    def all(self) -> list[tuple]:
        partly = self.partly()
        self.changes(partly)
        self.leaks()
        self.unsure()
        self.glued()
        number = {id(d): k for k, d in enumerate(self.p.found)}
        for d, now, right in self.replaced:
            self.add(5, "REPLACED", d.label, (d.start, d.end), right, d.text, None, d, replaced=now, leaked=number[id(d)] in self.leaked)
        return self.rows


def raw(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text", labels: str | None = None) -> DataFrame:
    """What the kernel sees: findings, and REPLACED and SEVERAL rows that are still to be judged."""
    return pair_rows(pairs, lambda p: Walk(p).all(), RAW, id_col, left, right, labels)


def _ranked(rows: DataFrame, id_col: str, group: list[Column | str], variant: str) -> DataFrame:
    """rows with the size of their variant within a group, how many variants there are, and the variant's place: the
    largest first, of equals the one that comes first. rows has n and ord."""
    own = Window.partitionBy(id_col, *group, variant)
    whole = Window.partitionBy(id_col, *group)
    sized = rows.withColumn("v_n", F.count("*").over(own)).withColumn("v_first", F.min("ord").over(own))
    order = whole.orderBy(F.desc("v_n"), "v_first")
    return sized.withColumn("v_rank", F.dense_rank().over(order)).withColumn("v_all", F.max("v_rank").over(whole))


def coherent(ok: DataFrame, id_col: str) -> DataFrame:
    """ok, rows of good replacements, with incoherent: why they don't go with the others; null if they do."""
    n = replacement.normalized
    q = lambda c: F.concat(F.lit("“"), c, F.lit("”"))
    r = ok.withColumn("n_text", n(F.col("text"))).withColumn("n_now", n(F.col("replacement")))
    one = _ranked(r, id_col, ["label", "n_text"], "n_now")
    whole = Window.partitionBy(id_col, "label", "n_text").orderBy("v_rank", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumn("main", F.first("replacement").over(whole))
    a = F.when(F.col("v_rank") > 1, F.concat(q(F.col("text")), F.lit(" is replaced with "), q(replacement.short(F.col("replacement"))), F.lit(" here, but with "), q(replacement.short(F.col("main"))), F.lit(" elsewhere. The same value must get the same replacement everywhere.")))
    one = one.withColumn("why_a", a).drop("v_n", "v_first", "v_rank", "v_all", "main")
    two = _ranked(one, id_col, ["label", "n_now"], "n_text")
    b = F.when(F.col("v_rank") > 1, F.concat(F.lit("Different values were all replaced with "), q(replacement.short(F.col("replacement"))), F.lit(". Different values need different replacements.")))
    two = two.withColumn("why_b", b).drop("v_n", "v_first", "v_rank", "v_all")
    words = two.where("label = 'Person Name' and size(split(text, '\\\\s+')) = size(split(replacement, '\\\\s+'))")
    parts = words.select(id_col, "ord", F.explode(F.arrays_zip(F.split("text", r"\s+").alias("w"), F.split("replacement", r"\s+").alias("x"))).alias("z")).select(id_col, "ord", n(F.col("z.w")).alias("w"), n(F.col("z.x")).alias("x")).where("length(w) >= 3")
    ranked = _ranked(parts, id_col, ["w"], "x")
    top = F.first("x").over(Window.partitionBy(id_col, "w").orderBy("v_rank", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = F.concat(F.lit("The name part "), q(F.col("w")), F.lit(" is replaced with "), q(F.col("x")), F.lit(" here but "), q(F.col("top")), F.lit(" elsewhere. Use the same replacement for every mention of the person."))
    off = ranked.withColumn("top", top).where("v_rank > 1").groupBy(id_col, "ord").agg(F.min_by(c, "w").alias("why_c"))
    return two.join(off, [id_col, "ord"], "left").withColumn("incoherent", F.coalesce("why_a", "why_b", "why_c")).drop("why_a", "why_b", "why_c")


def verify(pairs: DataFrame, id_col: str = "pair_id", left: str = "left_text", right: str = "right_text", labels: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Findings of every pair: category, label, ranges, text, note, suggest and an id that is unique in the pair. rows: what
    the kernel saw (raw), where that is at hand."""
    q = lambda c: F.concat(F.lit("“"), c, F.lit("”"))
    rows = once(raw(pairs, id_col, left, right, labels)) if rows is None else rows
    why, kept = replacement.not_sensible(F.col("replacement")), replacement.digits_kept(F.col("label"), F.col("text"), F.col("replacement"))
    cols = [F.col(id_col), "phase", "ord", *_COLUMNS]
    several = rows.where("category = 'SEVERAL'").withColumn("note", F.concat(F.lit("Replacement is not sensible: "), why, F.lit("."))).where("note is not null").withColumn("category", F.lit("NOT_SENSIBLE"))
    judged = rows.where("category = 'REPLACED' and not (leaked and replacement = '')").withColumn("kept", kept).withColumn("why", why).withColumn("same", replacement.same_type(F.col("label"), F.col("replacement")))
    bad = judged.where("kept is not null or why is not null or not same")
    bad = bad.withColumn("category", F.expr("case when kept is not null then 'LEAKAGE' when why is not null then 'NOT_SENSIBLE' else 'DATATYPE' end")).withColumn("note", F.when(F.col("kept").isNotNull(), F.concat("label", F.lit(" only partly redacted: the digits "), q(F.col("kept")), F.lit(" from "), q(F.col("text")), F.lit(" are still visible on the right."))).when(F.col("why").isNotNull(), F.concat(F.lit("Replacement is not sensible: "), "why", F.lit("."))).otherwise(F.concat(q(F.col("text")), F.lit(" was replaced with "), q(replacement.short(F.col("replacement"))), F.lit(", which is not a "), "label", F.lit(". The replacement should be the same kind of data."))))
    good = once(coherent(judged.where("kept is null and why is null and same"), id_col))
    done = good.where("incoherent is not null or not leaked").withColumn("category", F.when(F.col("incoherent").isNotNull(), "INCOHERENT").otherwise("REDACTED_OK")).withColumn("note", F.coalesce("incoherent", F.concat(F.lit("Replaced with "), q(replacement.short(F.col("replacement"))), F.lit(".")))).withColumn("phase", F.when(F.col("incoherent").isNotNull(), 6).otherwise(7))
    # words that were changed into another value's replacement
    used = good.groupBy(id_col, F.col("n_now").alias("n_right")).agg(F.max_by(F.struct("label", "text", "replacement"), "ord").alias("u"))
    direct = rows.where("category not in ('REPLACED', 'SEVERAL')").withColumn("n_right", F.when((F.col("category") == "OVER_REDACTED") & F.col("left_start").isNotNull() & F.col("right_start").isNotNull(), replacement.normalized(F.col("right_text"))))
    taken = direct.join(used, [id_col, "n_right"], "left").withColumn("again", F.col("u").isNotNull() & (replacement.normalized(F.col("u.text")) != replacement.normalized(F.col("text"))))
    reused = F.concat(q(replacement.short(F.col("text"))), F.lit(" was changed to "), q(replacement.short(F.col("u.replacement"))), F.lit(", which is already the replacement for "), q(F.col("u.text")), F.lit(". Two different values must not get the same replacement."))
    direct = taken.withColumn("note", F.when(F.col("again"), reused).otherwise(F.col("note"))).withColumn("category", F.when(F.col("again"), "INCOHERENT").otherwise(F.col("category"))).withColumn("label", F.when(F.col("again"), F.col("u.label")).otherwise(F.col("label")))
    report = once(document_report(pairs.select(F.col(id_col), F.col(left).alias("text")), id_col).where("verdict != 'english' or size(reasons) >= 2"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("label", "string"), ("left_start", "int"), ("left_end", "int"), ("right_start", "int"), ("right_end", "int"), ("confidence", "double"), ("known_name", "string"))}
    task = lambda text, note, where: report.where(where).select(id_col, F.lit(8).alias("phase"), F.lit(0).alias("ord"), F.lit("TASK").alias("category"), *(nothing[c].alias(c) for c in ("label", "left_start", "left_end", "right_start", "right_end")), text.alias("text"), nothing["confidence"].alias("confidence"), F.lit("L2").alias("source"), note.alias("note"), nothing["known_name"].alias("known_name"))
    tasks = task(F.concat(F.lit("Language: "), "main_language"), F.concat(F.lit("Other language — sampling imperfection. "), "summary", F.lit(" Flag this task.")), "verdict != 'english'").union(task(F.lit("Unstructured text"), F.concat(F.lit("The document looks unstructured ("), F.array_join("reasons", "; "), F.lit("). Flag this task.")), "size(reasons) >= 2"))
    out = direct.select(*cols).union(several.select(*cols)).union(bad.select(*cols)).union(done.select(*cols)).union(tasks.select(*cols))
    key = F.concat_ws("|", F.lit("L2"), "category", F.coalesce("label", F.lit("")), F.coalesce(F.concat_ws("-", "left_start", "left_end"), F.lit("")), F.coalesce(F.concat_ws("-", "right_start", "right_end"), F.lit("")))
    place = F.coalesce("left_start", "right_start", F.lit(-1))
    order = Window.partitionBy(id_col).orderBy(place, "phase", "ord")
    out = out.withColumn("id", key).withColumn("ord", F.row_number().over(order) - 1)
    again = F.row_number().over(Window.partitionBy(id_col, "id").orderBy("ord")) - 1
    suggest = F.create_map(*(F.lit(x) for kv in SUGGEST.items() for x in kv))
    return out.withColumn("again", again).select(id_col, "ord", F.when(F.col("again") > 0, F.concat("id", F.lit("#"), "again")).otherwise(F.col("id")).alias("id"), *_COLUMNS, F.try_element_at(suggest, F.col("category")).alias("suggest"))
