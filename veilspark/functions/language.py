"""Languages of a document, line by line, and whether it is prose at all; in DataFrame functions.

FIXED VALUES: scripts, stop words and limits are given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCRIPTS = ("Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Hebrew")
SCRIPT_NAMES = {"Devanagari": "Hindi/Marathi (Devanagari)", "Oriya": "Odia", "Han": "Chinese", "Hiragana": "Japanese", "Katakana": "Japanese", "Hangul": "Korean"}
STOP_WORDS = {
    "English": "the and of to in is for on with that this be are as at by from it or was an your you we will have has not our please",
    "Hinglish": "hai hain ka ki ke ko aur mein main nahi kya kar karo kiya tha thi bhi se par ap aap hum tum yeh woh ho raha rahe",
    "Spanish": "el la de que y en los del las por con para una es su al lo como más pero sus le ya",
    "French": "le la les de des et est une pour dans que qui sur pas au avec vous nous ce il",
    "German": "der die das und ist nicht mit von zu den sie ein eine auf für ich sich",
    "Portuguese": "de que do da em não para os com uma no na por mais você ele ela muito",
    "Indonesian": "yang dan di ke dari untuk dengan ini itu tidak ada akan pada juga",
}
LONG_LINE = 400
#: At least eight letters.
EIGHT = r"(?:[\p{L}\p{M}][^\p{L}\p{M}]*+){8}"


def letters(u: Column) -> Column:
    """How many letters and marks: the length without the runs of all else, fewer than letters."""
    return F.length(F.regexp_replace(u, r"[^\p{L}\p{M}]+", ""))


def _let(value: Column, f) -> Column:
    """f(value), with value computed once: a lambda over an array of it alone."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def language_of(u: Column, script_only: Column | None = None, counted: Column | None = None) -> Column:
    """English unless letters of another script are 30 %, or there are at least two different stop words of another
    language and more than English ones; null for fewer than eight letters. counted: letters(u), where it is told anyway."""
    n = letters(u) if counted is None else counted
    few = ~u.rlike(EIGHT) if counted is None else counted < 8
    script = {s: F.regexp_count(u, F.lit(rf"[\p{{Is{s}}}&&[\p{{L}}\p{{M}}]&&[^\u0000-ɏ]]")) for s in SCRIPTS}
    other = reduce(lambda a, b: a + b, script.values())
    most = F.greatest(*(F.struct(c.alias("n"), F.lit(-k).alias("k"), F.lit(SCRIPT_NAMES.get(s, s)).alias("name")) for k, (s, c) in enumerate(script.items())))
    listed = tuple(dict.fromkeys(" ".join(STOP_WORDS.values()).split()))

    def vote(words: Column) -> Column:
        def of(known: Column) -> Column:  # the different stop words of any language, few, so that each language looks at these alone
            hits = {lang: F.size(F.array_intersect(known, F.array(*(F.lit(w) for w in dict.fromkeys(s.split()))))) for lang, s in STOP_WORDS.items()}
            best = F.greatest(*(F.struct(c.alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("name")) for k, (lang, c) in enumerate(hits.items()) if lang != "English"))
            return F.when((best["n"] >= 2) & (best["n"] > hits["English"]), best["name"]).otherwise("English")

        return F.when(F.size(words) >= 3, _let(F.array_distinct(F.filter(words, lambda w: w.isin(*listed))), of)).otherwise("English")

    voted = _let(F.regexp_extract_all(F.lower(u), F.lit(r"\p{L}{2,}"), F.lit(0)), vote)
    if script_only is not None:
        voted = F.when(script_only, "English").otherwise(voted)
    # letters are counted only of units that have some of another script than Latin
    return F.when(few, None).when(u.rlike(r"[\p{L}\p{M}&&[^\u0000-ɏ]]") & (other / n >= 0.3), most["name"]).otherwise(voted)


def units(docs: DataFrame, id_col: str, text_col: str = "text", firsts: bool = False) -> DataFrame:
    """(id, line, unit): lines, and the sentences of long ones; other columns stay. Blank units go, but with firsts the
    first one of each text stays, whatever it is, and first tells it."""
    lines = docs.select("*", F.posexplode(F.split(text_col, "\n", -1)).alias("line", "_raw")).withColumn("line", F.col("line") + 1)
    parts = F.when(F.length("_raw") > LONG_LINE, F.regexp_extract_all("_raw", F.lit(r"([^.!?।]+[.!?।]*\s*)"), 1)).otherwise(F.array("_raw"))
    kept = [c for c in lines.columns if c != "_raw"]
    if not firsts:
        return lines.select(*kept, F.posexplode(parts).alias("part", "unit")).where("trim(unit) != ''")
    each = lines.select(*kept, F.posexplode_outer(parts).alias("part", "unit")).withColumns({"first": F.expr("line = 1 and coalesce(part, 0) = 0"), "unit": F.coalesce("unit", F.lit(""))})
    return each.where("first or trim(unit) != ''")


def structure_reasons(t: Column) -> Column:
    """Signs that a text is no prose and no form; two of them make it unstructured. None for under 300 characters."""
    t = F.trim(t)
    n = F.length(t)
    figures = F.struct(
        (F.regexp_count(t, F.lit(r"\s+")) + 1).alias("count"),
        F.length(F.regexp_replace(t, r"[\p{L}\p{N}.,:;'\"()?!\s-]+", "")).alias("signs"), F.regexp_count(t, F.lit(r"(?<!\S)\S{41,}+")).alias("long"),
        F.when(t.rlike("[0-9]"), F.regexp_extract_all(t, F.lit(r"(?<!\S)\S*[0-9]\S*"), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("numbered"),
        F.when(t.rlike(r"[{}<>;=\[]|\(\)"), F.regexp_count(t, F.lit(r"(?m)[{}<>;=]|=>|\(\)|</?\w+>|^\s*[\w$]+\s*[:=]\s*[\[{]"))).otherwise(0).alias("code"),
    )

    def signs(f: Column) -> Column:
        count, long = f["count"], f["long"]
        # all but white space is counted where it can matter: it is no less than the words, but for an empty one at each end
        symbols = F.when(f["signs"] * 6 + 2 > count, f["signs"] / F.greatest(F.length(F.regexp_replace(t, r"\s+", "")), F.lit(1))).otherwise(0.0)
        code = f["code"] / count
        mixed = F.size(F.filter(f["numbered"], lambda w: (F.length(w) >= 5) & w.rlike(r"\p{L}") & F.regexp_replace(w, r"[.,;:]\z", "").rlike(r"[^\p{L}\p{N}]")))
        ends = F.regexp_count(t, F.lit(r"[.!?](?:\s|\z)"))
        lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
        fields = lambda own: F.size(F.filter(own, lambda x: x.rlike(r"^[^:]{1,40}:\s*\S"))) < F.size(own) * 0.3
        return F.array(
            F.when(symbols > 0.18, F.concat(F.floor(symbols * 100 + 0.5).cast("string"), F.lit("% symbols"))),
            F.when((long >= 3) | (long / count > 0.02), F.lit("long runs of characters without spaces")),
            F.when(mixed / count > 0.12, F.lit("many garbled words mixing letters, digits and symbols")),
            F.when(code > 0.15, F.lit("looks like code, markup or a data dump")),
            F.when((count > 120) & (ends < n / 600) & _let(lines, fields), F.lit("almost no sentences or form fields")),
        )

    return F.when(n < 300, F.array().cast("array<string>")).otherwise(F.filter(_let(figures, signs), lambda r: r.isNotNull()))


def document_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, reasons, verdict, share, total_letters, languages, main_language, summary), a row for each id. A text is read
    once: what is said of it as a whole goes with its first unit, and units are told without a filter on what they are told."""
    with_reasons = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("reasons", structure_reasons(F.col("_t")))
    each = units(with_reasons, id_col, "_t", firsts=True)
    n = letters(F.col("unit"))
    each = each.select(id_col, "line", language_of(F.col("unit"), F.size("reasons") >= 2, n).alias("language"), n.alias("letters"), F.when(F.col("first"), F.struct("reasons")).alias("head"))
    langs = each.groupBy(id_col, "language").agg(F.sum("letters").alias("letters"), F.count_distinct("line").alias("lines"), F.collect_list("head").alias("heads"))
    told, other = F.col("language").isNotNull(), F.col("language") != "English"
    one = F.struct((-F.col("letters")).alias("o"), "language", "letters", "lines")
    out = langs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(told, one))).alias("_l"), F.sum(F.when(told, F.col("letters"))).alias("total_letters"), F.sum(F.when(other, F.col("letters")).otherwise(0)).alias("other_letters"), F.flatten(F.collect_list("heads")).alias("_heads"))
    percent = lambda x: F.when((x > 0) & (x < 0.01), F.lit("<1")).otherwise(F.floor(x * 100 + 0.5).cast("string"))
    said = lambda x: F.concat(x["language"], F.lit(" "), percent(x["letters"] / F.col("total_letters")), F.lit("% of the text ("), x["lines"], F.lit(" line"), F.when(x["lines"] > 1, "s").otherwise(""), F.lit(")"))
    others = F.filter("_l", lambda x: x["language"] != "English")
    verdict = F.when(F.size("_l") == 0, None).when(F.size(others) == 0, "english").when(F.col("other_letters") / F.col("total_letters") >= 0.5, "other").otherwise("mixed")
    languages = F.when(F.size("_l") > 0, F.transform("_l", lambda x: F.struct(x["language"].alias("language"), x["letters"].alias("letters"), x["lines"].alias("lines"))))
    out = out.select(id_col, F.explode("_heads").alias("_head"), verdict.alias("verdict"), (F.col("other_letters") / F.col("total_letters")).alias("share"), "total_letters", languages.alias("languages"), F.get(others, F.lit(0))["language"].alias("main_language"), F.array_join(F.transform(others, said), "; ").alias("_names"))
    summary = F.when(F.col("verdict") == "english", "The document is in English.").when(F.col("verdict") == "other", F.concat(F.lit("The document is mostly not in English: "), "_names", F.lit("."))).when(F.col("verdict") == "mixed", F.concat(F.lit("The document is mostly English but contains other language: "), "_names", F.lit(".")))
    whole = out.select(id_col, F.col("_head.reasons").alias("reasons"), "verdict", "share", "total_letters", "languages", "main_language", summary.alias("summary"))
    return whole.fillna({"verdict": "english", "share": 0.0, "total_letters": 0, "summary": "The document is in English."})


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, line, lines): runs of lines of one language other than English, at most a line apart."""
    each = units(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")), id_col, "_t").withColumn("language", language_of(F.col("unit"))).where("language is not null and language != 'English'")
    w = Window.partitionBy(id_col).orderBy("line", "part")
    new = (F.lag("language").over(w).isNull() | (F.lag("language").over(w) != F.col("language")) | (F.col("line") - F.lag("line").over(w) > 1)).cast("int")
    runs = each.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(id_col, "run", "language").agg(F.min("line").alias("line"), (F.max("line") - F.min("line") + 1).alias("lines")).drop("run")
