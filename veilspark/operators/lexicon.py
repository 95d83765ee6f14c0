"""Names and values looked up in texts by joins: public names of a dictionary, values that leaked, repeats of names.

All three are phrases found by plans.phrases: no text is scanned once for each name, a dictionary may have millions of
entries, and what is shuffled are the places found. Rows that share an id are rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import wordlists as W
from veilspark.functions.patterns import REVIEW_THRESHOLD
from veilspark.plans import intervals, phrases
from veilspark.plans.materialize import dealt, once

_LEGAL = W.LEGAL_END


def name_key(name: Column) -> Column:
    """A name without up to three legal endings, in lower case, "and" as "&": names of one key are one."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.coalesce(name, F.lit("")), F.lit("’"), F.lit("'")), r"[\s\x{a0}]+", " ")), r"[.,]+\z", "")
    for _ in range(3):  # t begins with no blank, so that nothing but an ending goes; each step stands in the expression once
        t = F.trim(F.regexp_replace(t, rf"(?i)[\s\x{{a0}}]+{_LEGAL}\z", ""))
    return F.regexp_replace(F.lower(t), r"\s+and\s+", " & ")


def dictionary_of(names: DataFrame) -> DataFrame:
    """(key, name, category) from (name, category, place): of names of one key the last."""
    own = names.withColumn("key", name_key(F.col("name"))).where("key != ''")
    return own.groupBy("key").agg(F.max_by(F.struct("name", "category"), F.struct("place", "name")).alias("e")).select("key", "e.name", "e.category")


def lookup(values: DataFrame, dictionary: DataFrame, value_col: str = "text") -> DataFrame:
    """values with the name and category of the dictionary's entry that they are, whole; null where they are none. An
    equi-join on keys: broadcast if the dictionary is small, shuffled if it is not."""
    keyed = values.withColumn("_key", name_key(F.col(value_col)))
    entries = dictionary.select(F.col("key").alias("_key"), F.col("name").alias("known_name"), F.col("category").alias("known_category"))
    return keyed.join(entries, "_key", "left").drop("_key")


def _sign(token: Column) -> Column:
    """Tokens of names: both apostrophes are one, and "and" is "&"."""
    return F.when(token == "’", "'").when(token == "and", "&").otherwise(token)


def _surname(before: Column, name: Column) -> Column:
    """One word behind another capitalised one is rather a person's, unless that one opens a phrase."""
    word = F.regexp_extract(before, r"(\p{L}+)\s+\z", 1)
    tail = F.lower(F.regexp_extract(word, r"[A-ZÀ-ÖØ-Þ][\p{L}&&[^A-ZÀ-ÖØ-Þ]]+\z", 0))
    return ~name.contains(" ") & (tail != "") & ~tail.isin(*W.OPENERS.split())


def known_names(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, text, name, category): the names of a dictionary (name, category, place) in texts, as they are
    written or in capitals, with legal endings behind them; the longest first, none inside another."""
    names = dealt(names)
    entries = dictionary_of(names)
    forms = names.select(F.explode(F.array(F.trim("name"), F.upper(F.trim("name")))).alias("form")).where("form != ''").distinct()
    own = forms.withColumns({"toks": phrases.sequence("form", normal=_sign), "key": name_key(F.col("form"))})
    own = once(own.groupBy("toks", "key").agg(F.max(F.length("form")).alias("length")).join(entries, "key"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = phrases.found(rows.withColumnRenamed(id_col, "_id"), own, [], normal=_sign, keep=["_id"])
    more = F.regexp_extract("after", rf"^((?:\s+{_LEGAL})+)(?![\p{{L}}\p{{N}}])", 1)
    hits = hits.where((name_key(F.col("said")) == F.col("key")) & ~F.col("before").rlike(r"[\p{L}\p{N}]\z")).withColumn("_more", more)
    hits = hits.where((F.col("_more") != "") | ~F.col("after").rlike(r"^[\p{L}\p{N}]"))
    hits = hits.select("row", "_id", "start", (F.col("end") + F.length("_more")).alias("end"), F.concat("said", "_more").alias("text"), "before", "length", "name", "category")
    taken = phrases.cover(hits, ["row", "_id"], [-F.col("length"), F.col("name")])
    return taken.where(~_surname(F.col("before"), F.col("name"))).select(F.col("_id").alias(id_col), "start", "end", "text", "name", "category")


def leaks(values: DataFrame, rights: DataFrame, id_col: str = "pair_id", text_col: str = "right_text") -> DataFrame:
    """(id, label, value, left_start, left_end, start, end, text): where values found on the left (id, ord, start, end, label,
    confidence, text) stand on the right (id, right_text) as whole words. Each sequence of tokens is looked for once, as
    its first sure detection, from left to right. Ids tell pairs apart."""
    sure = values.where((F.col("confidence") >= REVIEW_THRESHOLD) & (F.regexp_count("text", F.lit("[A-Za-z0-9_]")) >= 3)).withColumn("toks", phrases.sequence("text"))
    first = sure.where("size(toks) > 0").groupBy(F.col(id_col).alias("_id"), "toks").agg(F.min(F.struct("ord", "label", F.col("text").alias("value"), F.col("start").alias("left_start"), F.col("end").alias("left_end"))).alias("v")).select("_id", "toks", "v.*")
    first = once(first)  # looked at for lengths, for the hashes of each pair, and in the join
    rows = rights.select(F.col(id_col).alias("_id"), F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = phrases.found(rows, first, ["_id"])
    hits = hits.where(~F.col("before").rlike(r"[\p{L}\p{N}]\z") & ~F.col("after").rlike(r"^[\p{L}\p{N}]"))
    taken = phrases.cover(hits.select("_id", "start", "end", "said", "ord", "label", "value", "left_start", "left_end"), ["_id"], [F.col("ord")])
    return taken.select(F.col("_id").alias(id_col), "label", "value", "left_start", "left_end", "start", "end", F.col("said").alias("text"))


#: Letters in a row, or any one other character: names repeat as they are written, blanks included.
_LETTERS = "[A-Za-z]+|(?s:[^A-Za-z])"


def repeated_names(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, confidence, rule, text): other places of the names found (id, start, end, confidence, text) in their
    documents: whole names of two long words at least, and their parts, which say less. At each place the longest whole
    name, else the longest part; none over a name found. Ids tell documents apart."""
    sure = found.where("confidence >= 0.75").select(F.col(id_col).alias("_id"), F.col("text").alias("name"))
    long = F.filter(F.split("name", r"[ \t]+"), lambda w: (F.length(w) >= 3) & ~w.endswith("."))
    words = sure.withColumn("_long", long)
    whole = words.where("size(_long) >= 2").select("_id", "name", F.lit(True).alias("whole"))
    parts = words.select("_id", F.explode("_long").alias("name"), F.lit(False).alias("whole")).where(~F.lower("name").isin(*W.NAME_STOP.split()))
    needles = whole.union(parts).where(F.col("name").rlike("^[A-Za-z]")).groupBy("_id", "name").agg(F.max("whole").alias("whole")).withColumn("toks", phrases.sequence("name", _LETTERS, lambda t: t))
    needles = once(needles)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = phrases.found(rows, needles, ["_id"], pattern=_LETTERS, normal=lambda t: t).where(~F.col("after").rlike("^[A-Za-z]"))
    taken = phrases.cover(hits.select("_id", "start", "end", "name", "whole"), ["_id"], [~F.col("whole"), -F.length("name")])
    spans = found.select(F.col(id_col).alias("_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    free = intervals.overlap_join(taken, spans, "_id", "left_anti")
    return free.select(F.col("_id").alias(id_col), "start", "end", F.when(F.col("whole"), 0.8).otherwise(0.65).alias("confidence"), F.when(F.col("whole"), "name-repeat-full").otherwise("name-repeat-part").alias("rule"), F.col("name").alias("text"))
