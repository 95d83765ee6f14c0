"""Queries for the operators outside llm, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import lookups, made, pages, planted, readings
from veilspark.functions import extract, language, patterns, replacement
from veilspark.operators import compare, detect, scan, stats, verify
from veilspark.plans import intervals
from veilspark.plans.materialize import dealt
from veilspark.plans.similar import similar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


# DuckDB has no lookaround: a match captures what stands before and after it
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"(?:^|[^\w.])((?:{_OCTET}\.){{3}}{_OCTET})(?:$|[^\w.]|\.$|\.[^\d])"
_PHONE = r"(?:^|[^\w+])(\+(?:[0-8]|9[02-9]|9\s)\d{0,2}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4})(?:$|[^\d])"
_HEX = r"(?:^|[^0-9a-zA-Z_])([0-9a-f]{128}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40})(?:$|[^0-9a-zA-Z_])"
_CARD = r"(?:^|[^\w-])(\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?:$|[^\w-])"
_EMAIL = r"(?:^|[^\w.%+-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24})(?:$|[^\w.-]|\.$|\.[^A-Za-z0-9])"


def _each(pattern: str, columns: str = "doc_id, source") -> str:
    return f"select {columns}, unnest(regexp_extract_all(text, '{pattern}', 1)) as value from documents"


@query()
def pii_label_counts(spark, sf_dir):
    """Detections by label and source, overlaps resolved."""
    docs = documents(spark, sf_dir)
    found = detect.detections(docs.withColumn("key", F.struct("doc_id", "source")), "key")
    return found.groupBy(F.col("key.source").alias("source"), "label").agg(F.count("*").alias("n"), F.count_distinct("key.doc_id").alias("documents"))


@query()
def pii_detections(spark, sf_dir):
    return detect.detections(documents(spark, sf_dir))


@query(f"select source, count(*) as n, count(distinct doc_id) as documents, count(distinct value) as distinct_values from ({_each(_IPV4)}) group by source")
def ipv4_by_source(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", "source", F.explode(extract.ipv4(F.col("text"))).alias("value"))
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("value").alias("distinct_values"))


@query(f"select doc_id, value, regexp_matches(lower(split_part(value, '@', 2)), '(?:^|\\.)example\\.[a-z.]{{2,}}$|\\.(?:example|test|invalid|localhost)$|^localhost$') as dummy, count(*) as n from ({_each(_EMAIL)}) where value not like '%..%' group by all")
def emails_with_dummy_flag(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", F.explode(extract.emails(F.col("text"))).alias("e"))
    return found.groupBy("doc_id", F.col("e.value").alias("value"), F.col("e.dummy").alias("dummy")).agg(F.count("*").alias("n"))


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: case when (length(d) - i) % 2 = 0 then d[i]::int else case when d[i]::int * 2 > 9 then d[i]::int * 2 - 9 else d[i]::int * 2 end end)) % 10 = 0"


@query(f"select distinct doc_id, value, {_LUHN} as luhn from (select doc_id, value, regexp_replace(value, '[^0-9]', '', 'g') as d from ({_each(_CARD)})) where length(d) between 13 and 19 and length(regexp_replace(d, d[1], '', 'g')) > 0")
def card_numbers_luhn(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", F.explode(extract.cards(F.col("text"))).alias("c"))
    return found.select("doc_id", F.col("c.value").alias("value"), F.col("c.luhn").alias("luhn")).distinct()


@query(f"select doc_id, value from ({_each(_PHONE)}) where length(regexp_replace(value, '[^0-9]', '', 'g')) between 8 and 15 and value not like '+91%'")
def phones_international(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(extract.phones(F.col("text"))).alias("value"))


@query(f"select source, length(value)::int as digits, count(*) as n from ({_each(_HEX)}) where regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-fA-F]') group by all")
def hex_digests(spark, sf_dir):
    found = documents(spark, sf_dir).select("source", F.explode(extract.digests(F.col("text"))).alias("value"))
    return found.groupBy("source", F.length("value").alias("digits")).agg(F.count("*").alias("n"))


@query("""select lang, count(*) as documents, sum(len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{L}\\p{M}\\p{N}]')))::bigint as tokens from documents group by lang""")
def token_counts_by_language(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.size(extract.tokens(F.col("text")))).alias("tokens"))


@query("""with u as (select page_id, unnest(regexp_extract_all(html, '(?:https?://|www\\.)[^\\s<>"'']+')) as v from pages)
select page_id, regexp_replace(v, '[.,;:]+$', '') as value, count(*) as n from u group by all""")
def urls_in_pages(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(extract.urls(F.col("html"))).alias("value"))
    return found.groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query(f"""with f as (select doc_id, 'IP/MAC Address' as label from ({_each(_IPV4)}) union all select doc_id, 'SHA/SSH/Hash Key' from ({_each(_HEX)}) where regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-fA-F]')
union all select doc_id, 'Person Phone No' from ({_each(_PHONE)}) where length(regexp_replace(value, '[^0-9]', '', 'g')) between 8 and 15 and value not like '+91%')
select label, place, coalesce(n, 0) as n from (values {', '.join(f"('{n}', {k})" for k, (n, _) in enumerate(patterns.LABELS))}) t(label, place) left join (select label, count(*) as n from f group by label) using (label)""")
def zero_filled_label_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = docs.select(F.explode(F.concat(F.transform(extract.ipv4(F.col("text")), lambda _: F.lit("IP/MAC Address")), F.transform(extract.digests(F.col("text")), lambda _: F.lit("SHA/SSH/Hash Key")), F.transform(extract.phones(F.col("text")), lambda _: F.lit("Person Phone No")))).alias("label"))
    return compare.filled_counts(found, "label", tuple(n for n, _ in patterns.LABELS)).select("label", "place", "n")


@query(f"select role, count(*) as turns, sum(len(regexp_extract_all(text, '{_IPV4}', 1)))::bigint as addresses, sum(len(regexp_extract_all(text, '\\d{{4,}}')))::bigint as numbers from conversations group by role")
def pii_in_conversations_by_role(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size(extract.ipv4(F.col("text")))).alias("addresses"), F.sum(F.regexp_count("text", F.lit(r"[0-9]{4,}"))).cast("long").alias("numbers"))


@query(f"""select quality, toxic, count(*) as documents, sum(n)::bigint as addresses from (select doc_id, len(regexp_extract_all(text, '{_IPV4}', 1)) as n from documents) join labels using (doc_id) group by all""")
def pii_density_by_label(spark, sf_dir):
    n = documents(spark, sf_dir).select("doc_id", F.size(extract.ipv4(F.col("text"))).alias("n"))
    return n.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.sum("n").alias("addresses"))


_SPANS = """spans as (select l_orderkey as doc, (l_partkey % 400)::int as start, (l_partkey % 400 + 1 + l_quantity)::int as "end", case l_linenumber % 3 when 0 then 'Person Name' when 1 then 'Person Email' else 'Account Number' end as label,
 round(0.5 + l_discount * 4, 2) as confidence, l_linenumber as ord, l_linenumber % 2 as side from lineitem)"""


def _spans(spark, sf_dir) -> DataFrame:
    """Spans of made-up documents, one for each order; lines are spans."""
    li = table(spark, sf_dir, "lineitem")
    label = F.expr("case l_linenumber % 3 when 0 then 'Person Name' when 1 then 'Person Email' else 'Account Number' end")
    return li.select(F.col("l_orderkey").alias("doc"), F.expr("cast(l_partkey % 400 as int)").alias("start"), F.expr("cast(l_partkey % 400 + 1 + l_quantity as int)").alias("end"), label.alias("label"), F.expr("round(0.5 + l_discount * 4, 2)").alias("confidence"), F.col("l_linenumber").alias("ord"), F.expr("l_linenumber % 2").alias("side"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = _spans(spark, sf_dir)
    return s.where("side = 0").drop("side", "ord", "confidence").distinct(), s.where("side = 1").select("doc", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("label").alias("b_label")).distinct()


_SIDES = _SPANS + """, a as (select distinct doc, start, "end", label from spans where side = 0), b as (select distinct doc, start as b_start, "end" as b_end, label as b_label from spans where side = 1)"""


@query(f"""with {_SIDES} select a.doc, start, "end", label, b_start, b_end, b_label from a join b on a.doc = b.doc and start < b_end and b_start < "end" """)
def interval_overlap_join(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return intervals.overlap_join(a, b, "doc")


@query(f"""with {_SIDES} select * from a where not exists (select 1 from b where a.doc = b.doc and start < b_end and b_start < "end")""")
def interval_anti_join(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return intervals.overlap_join(a, b, "doc", "left_anti").select("doc", "start", "end", "label")


@query(f"""with {_SIDES}, m as (select a.*, b_start, b_end, b_label, least("end", b_end) - greatest(start, b_start) as overlap from a join b on a.doc = b.doc and start < b_end and b_start < "end"),
r as (select *, row_number() over (partition by doc, start, "end", label order by overlap desc, (label = b_label) desc, case when label = b_label then -b_start else b_start end, b_end, b_label) as n from m) select * exclude (n) from r where n = 1""")
def interval_best_overlap(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return intervals.best_overlap(a, b, "doc")


@query(f"""with {_SPANS}, r as (select *, row_number() over (partition by doc, start, "end", label order by confidence desc, ord) as n from spans) select doc, start, "end", label, confidence from r where n = 1""")
def same_span_dedupe(spark, sf_dir):
    return intervals.surest(_spans(spark, sf_dir), ["doc"]).select("doc", "start", "end", "label", "confidence")


@query(f"""with {_SPANS}, w as (select doc, start, "end", max("end") over (partition by doc order by start, "end" rows between unbounded preceding and 1 preceding) as b from spans),
g as (select *, sum(case when b is null or start - b > 12 then 1 else 0 end) over (partition by doc order by start, "end" rows unbounded preceding) as island from w)
select doc, island::bigint as island, min(start) as start, max("end") as "end", count(*) as n from g group by doc, island""")
def change_clusters(spark, sf_dir):
    rows = intervals.islands(_spans(spark, sf_dir), ["doc"], "start", "end", 12)
    return rows.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


@query(f"""with {_SPANS}, r as (select label, doc, start, "end", confidence, row_number() over (partition by label order by confidence desc, doc, start, "end") as n from spans) select label, doc, start, "end", confidence from r where n <= 100""")
def page_of_each_label(spark, sf_dir):
    """The first 100 of each label, a report."""
    rows = _spans(spark, sf_dir).select("label", "doc", "start", "end", "confidence")
    return intervals.top_k(rows, ["label"], [F.desc("confidence"), F.col("doc"), F.col("start"), F.col("end")], 100)


_RANK = "case label " + " ".join(f"when '{n}' then {k}" for k, n in enumerate(patterns.SPECIFICITY)) + " else 99 end"


@query(f"""with recursive {_SPANS}, s as (select distinct doc, start, "end", label, confidence from spans),
o as (select *, row_number() over (partition by doc order by start - "end", {_RANK}, -confidence, start, "end", label) as n from s),
r as (select doc, n, [{{'a': start, 'z': "end", 'l': label, 'c': confidence}}] as kept from o where n = 1
 union all select o.doc, o.n, case when len(list_filter(r.kept, lambda k: k.a < o."end" and k.z > o.start)) > 0 then r.kept else list_append(r.kept, {{'a': o.start, 'z': o."end", 'l': o.label, 'c': o.confidence}}) end from r join o on o.doc = r.doc and o.n = r.n + 1),
f as (select doc, unnest(kept) as k from r where n = (select max(n) from o where o.doc = r.doc)) select doc, k.a as start, k.z as "end", k.l as label, k.c as confidence from f""")
def greedy_disjoint_spans(spark, sf_dir):
    rank = F.create_map(*(F.lit(x) for k, n in enumerate(patterns.SPECIFICITY) for x in (n, k)))
    each = _spans(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end", "label", "confidence"))).alias("s"))
    return each.select("doc", F.explode(intervals.disjoint(F.col("s"), rank)).alias("s")).select("doc", "s.*")


@query("""select l_linestatus, l_returnflag, list_sort(list(l_quantity::double))[(count(*) // 2 + 1)::int] as median from lineitem group by all""")
def upper_medians(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return intervals.upper_medians(rows, ["l_linestatus", "l_returnflag"], "q")


@query("""with e as (select user_id, event_id, ts, case when event_type = 'purchase' then value end as v from events)
select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from e""")
def nearest_before_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return intervals.nearest_before(e, "user_id", "o", "v", "before").select("event_id", "before")


@query("""with d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from documents), b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from benchmark),
c as (select d.doc_id, b.item_id, count(*) as common from (select doc_id, unnest(w) as x from d) d join (select item_id, unnest(w) as x from b) b using (x) group by all)
select doc_id, item_id, round(common / (len(d.w) + len(b.w) - common), 6) as similarity from c join d using (doc_id) join b using (item_id) where common >= 0.5 * (len(d.w) + len(b.w) - common)""")
def similar_rows(spark, sf_dir):
    """Documents and benchmark items that are alike in their words: a join by the rarest words of each."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z]{3,})"), 1))
    d = documents(spark, sf_dir).select("doc_id", words(F.col("text")).alias("w"))
    b = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    return similar(d, b, "doc_id", "item_id", "w", 0.5).withColumn("similarity", F.round("similarity", 6))


_REPLACED = """r as (select c_nationkey as pair, c_custkey as ord, 'Person Name' as label, lower('N' || (c_custkey % 37)) as n_text, lower('R' || ((c_custkey % 37) * (1 + c_custkey % 2) % 31)) as n_now from customer)"""


@query(f"""with {_REPLACED}, v as (select pair, n_text, n_now, count(*) as n, min(ord) as f from r group by all),
k as (select *, row_number() over (partition by pair, n_text order by n desc, f) as place, count(*) over (partition by pair, n_text) as variants from v)
select pair, n_text, n_now, n, place, variants from k where variants >= 2""")
def coherence_variants(spark, sf_dir):
    """Replacements of one value that differ, by how common they are."""
    r = table(spark, sf_dir, "customer").selectExpr("c_nationkey as pair", "c_custkey as ord", "lower(concat('N', c_custkey % 37)) as n_text", "lower(concat('R', (c_custkey % 37) * (1 + c_custkey % 2) % 31)) as n_now")
    v = verify._ranked(r, "pair", ["n_text"], "n_now").where("v_all >= 2")
    return v.groupBy("pair", "n_text", "n_now").agg(F.max("v_n").alias("n"), F.max("v_rank").cast("long").alias("place"), F.max("v_all").cast("long").alias("variants"))


@query("""select c_custkey, case when t = '' then 'the PII was deleted instead of being replaced' when regexp_matches(t, '^[\\[<{(].*[\\]>})]$') then '"' || t || '" is a placeholder, not realistic text'
 when regexp_matches(t, '^[xX*#•_?\\-]{2,}$|^(?:[xX*#•]{2,}[\\s-]?)+\\d{0,4}$') then '"' || t || '" is masked, not realistic text' end as why
 from (select c_custkey, case c_custkey % 5 when 0 then '' when 1 then '[' || c_name || ']' when 2 then 'XXXX-' || lpad((c_custkey % 10000)::varchar, 4, '0') when 3 then c_mktsegment else c_name end as t from customer)""")
def sensible_replacements(spark, sf_dir):
    """Why each customer's replacement isn't sensible, null where it is."""
    t = F.expr("case c_custkey % 5 when 0 then '' when 1 then concat('[', c_name, ']') when 2 then concat('XXXX-', lpad(cast(c_custkey % 10000 as string), 4, '0')) when 3 then c_mktsegment else c_name end")
    return table(spark, sf_dir, "customer").select("c_custkey", replacement.not_sensible(t).alias("why"))


@query("""with raw as (select doc_id, unnest(string_split(text, chr(10))) as v from documents), l as (select doc_id, unnest(case when length(v) > 400 then regexp_extract_all(v, '[^.!?।]+[.!?।]*\\s*') else [v] end) as u from raw), x as (select doc_id, u, list_distinct(regexp_extract_all(lower(u), '\\p{L}{2,}')) as w, len(regexp_extract_all(lower(u), '\\p{L}{2,}')) as c from l where trim(u) != '' and len(regexp_extract_all(u, '[\\p{L}\\p{M}]')) >= 8),
h as (select *, """ + ", ".join(f"len(list_intersect(w, [{', '.join(chr(39) + x + chr(39) for x in dict.fromkeys(s.split()))}])) as {k}" for k, s in language.STOP_WORDS.items()) + """ from x)
select language, count(*) as lines from (select case when c >= 3 and greatest(Hinglish, Spanish, French, German, Portuguese, Indonesian) >= 2 and greatest(Hinglish, Spanish, French, German, Portuguese, Indonesian) > English then
 case greatest(Hinglish, Spanish, French, German, Portuguese, Indonesian) when Hinglish then 'Hinglish' when Spanish then 'Spanish' when French then 'French' when German then 'German' when Portuguese then 'Portuguese' else 'Indonesian' end else 'English' end as language from h) group by language""")
def line_languages(spark, sf_dir):
    """Lines by language; of lines over 400 characters each sentence counts."""
    units = language.units(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return units.select(language.language_of(F.col("unit")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("lines"))


@query()
def language_reports(spark, sf_dir):
    return language.document_report(documents(spark, sf_dir)).select("doc_id", "verdict", "share", "total_letters", "main_language", "summary", "reasons")


def _pairs(spark, sf_dir) -> DataFrame:
    """Documents with a redacted version of their own: addresses and long numbers rewritten."""
    right = F.regexp_replace(F.regexp_replace("text", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "10.0.0.9"), r"\+\d[\d ().-]{8,}\d", "[PHONE]")
    return documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("left_text"), right.alias("right_text"))


@query()
def compare_pairs(spark, sf_dir):
    return compare.compare(_pairs(spark, sf_dir), labels=None)


@query()
def identify_pairs(spark, sf_dir):
    return compare.identify(compare.compare(_pairs(spark, sf_dir), labels=None))


@query()
def verify_pairs(spark, sf_dir):
    return verify.verify(_pairs(spark, sf_dir))


@query()
def review_summary(spark, sf_dir):
    """The view of all pairs: values found, labelled, visible, problems."""
    from veilspark.operators import analyze

    return analyze.analyze(_pairs(spark, sf_dir), labels=None)["summary"]


_EXTRA_URL = r"(?i)((?:https?://|www\.)[^\s<>\"'')]+|(?:[A-Za-z0-9-]+\.)+(?:com|in|io|org|net|co|ai|dev|me)/[^\s<>\"'')]+)"


@query(f"""with t as (select page_id, unnest(regexp_extract_all(html, '{_EXTRA_URL}', 1)) as v from pages) select page_id, 'URL/Link' as site, regexp_replace(v, '[.,;:]+$', '') as text from t
union all select page_id, 'Vehicle Number Plate', unnest(regexp_extract_all(html, '(?:^|[^A-Za-z0-9_])([A-Z]{{2}}[ -]?\\d{{1,2}}[ -]?[A-Z]{{1,3}}[ -]?\\d{{4}})(?:$|[^A-Za-z0-9_])', 1)) from pages""")
def site_extras(spark, sf_dir):
    from veilspark.operators import view

    return view.extras(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


@query()
def page_texts(spark, sf_dir):
    from veilspark.sources.html import text_of

    return table(spark, sf_dir, "pages").select("page_id", text_of(F.col("html")).alias("text"))


@query("""with f as (select c_custkey, c_nationkey as pair_id, case c_custkey % 4 when 0 then 'LEAKAGE' when 1 then 'REDACTED_OK' when 2 then 'OVER_REDACTED' else 'NOT_SENSIBLE' end as category, case c_custkey % 3 when 0 then 'redact' when 1 then 'keep' end as verdict from customer),
o as (select *, category in ('OVER_REDACTED', 'REDACTED_OK', 'NOT_SENSIBLE') as done from f),
k as (select *, case when verdict = 'redact' and not done then 'missed' when verdict = 'keep' and done then 'over' when verdict = 'redact' and category = 'NOT_SENSIBLE' then 'quality' end as kind from o)
select pair_id, sum((verdict is null)::int)::bigint as open, sum((verdict is not null and kind is null)::int)::bigint as ok, sum((verdict is not null and kind is not null)::int)::bigint as fix from k group by pair_id""")
def reviewer_decisions(spark, sf_dir):
    from veilspark.operators import view

    f = table(spark, sf_dir, "customer").selectExpr("c_nationkey as pair_id", "case c_custkey % 4 when 0 then 'LEAKAGE' when 1 then 'REDACTED_OK' when 2 then 'OVER_REDACTED' else 'NOT_SENSIBLE' end as category", "case c_custkey % 3 when 0 then 'redact' when 1 then 'keep' end as verdict")
    fix, kind, text = view.outcome("L2")
    return view.decision_summary(f.withColumns({"fix": fix, "kind": kind, "outcome": text}))


@query("select o_custkey, o_orderkey, coalesce(v, case when f is null then -1.0 else f - 0.5 end) as filled from (select *, last_value(x ignore nulls) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as v, first_value(x ignore nulls) over (partition by o_custkey order by o_orderkey rows between current row and unbounded following) as f from (select o_custkey, o_orderkey, case when o_orderstatus = 'F' then o_orderkey::double end as x from orders))")
def filled_row_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("double")).alias("x"))
    return intervals.filled(o, "o_custkey", "o_orderkey", "x", "filled").select("o_custkey", "o_orderkey", "filled")


@query("""with d as (select doc_id, string_split(text, chr(10)) as l from documents) select doc_id, len(l) as rows, len(list_distinct(l)) as distinct_rows from d""")
def row_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", F.size("l").alias("rows"), F.size(F.array_distinct("l")).alias("distinct_rows"))


@query()
def reordered_rows(spark, sf_dir):
    """Rows of documents against the same rows turned round by their middle."""
    from veilspark.operators import analyze

    rows = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), rows.alias("left_rows"))
    half = (F.size("left_rows") / 2).cast("int")
    d = d.withColumn("right_rows", F.concat(F.slice("left_rows", half + 1, F.size("left_rows")), F.slice("left_rows", F.lit(1), half)))
    return analyze.reorder(d)


@query()
def assembled_documents(spark, sf_dir):
    """Documents put together again from overlapping reads of ten rows."""
    from veilspark.streaming import assemble

    row = lambda x: F.struct(x.alias("text"), F.array().cast("array<int>").alias("words"), F.lit(False).alias("para"))
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("task_id"), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("l"))
    reads = d.select("task_id", "l", F.explode(F.expr("sequence(0, greatest(size(l) - 1, 0), 6)")).alias("at"))
    return assemble.assemble_batch(reads.select("task_id", F.col("at").cast("long").alias("seq"), F.lit("left").alias("side"), F.lit("").alias("header"), F.to_json(F.transform(F.slice("l", F.col("at") + 1, F.lit(10)), row)).alias("rows")))


# texts made by rule, with what is to be found in them --------------------------------------------------------------


def _made(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer").selectExpr("c_custkey as n"))


def _planted(spark, sf_dir, said: str) -> DataFrame:
    """Documents with a planted sentence, and where it stands."""
    d = dealt(table(spark, sf_dir, "documents").selectExpr("doc_id as n", "coalesce(text, '') as t")).selectExpr("n", "t", f"{said} as said")
    return d.selectExpr("n", f"{planted.around('said')} as text", f"cast(case when {planted.FIRST} then 0 else length(t) + 120 end as int) as said_at", "length(said) as said_length")


@query(planted.all_sql())
def structured_detections(spark, sf_dir):
    """All structured rules at once over documents with planted values, in the JVM."""
    return scan.detections(_planted(spark, sf_dir, planted.sentence()), "n").select(F.col("n").alias("doc_id"), "start", "end", "label", "confidence", "rule", "text")


@query(planted.all_sql(planted.EVERYTHING, planted.ALL_KINDS, planted.CONVERSATIONS, "turn_id"))
def conversation_detections(spark, sf_dir):
    """All detectors at once, with the choice among what overlaps, over conversations with planted values."""
    t = dealt(table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn as n", "coalesce(text, '') as t")).selectExpr("n", "t", f"{planted.sentence(planted.EVERYTHING)} as said")
    out = detect.detections(t.selectExpr("n", f"{planted.around('said')} as text"), "n")
    return out.select(F.col("n").alias("turn_id"), "start", "end", "label", "confidence", "rule", "text")


def _detects(name: str):
    def found(spark, sf_dir):
        docs = _planted(spark, sf_dir, made.text_of(name))
        out = detect.detections(docs, "n", only=(name,)).select("n", "start", "end", "label", "text")
        if name in planted.PARTLY:
            # what the sentence holds; what texts have of their own can't be said in SQL
            out = out.join(docs.select("n", "said_at", "said_length"), "n").where("start >= said_at and start < said_at + said_length")
        return out.select(F.col("n").alias("doc"), "start", "end", "label", "text")

    found.__name__ = "detects_" + name.replace("-", "_")
    return query(planted.one_sql(name))(found)


for _name in made.DETECTED:
    _detects(_name)


def _turns(spark, sf_dir, **said: str) -> DataFrame:
    """Turns of conversations by a number of their own: text t and sentences to plant."""
    return dealt(table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn as n", "coalesce(text, '') as t")).selectExpr("n", "t", *(f"{sql} as {name}" for name, sql in said.items()))


def _labelled(spark, sf_dir) -> DataFrame:
    """Turns with a planted sentence, the same on both sides, which has a label on the right."""
    name, known, start, end = made.compared_label()
    p = _turns(spark, sf_dir, said=made.compared_text(), l=name, k=known, s=f"cast({start} as int)", e=f"cast({end} as int)")
    p = p.selectExpr("n as pair_id", f"{planted.around('said')} as left_text", "l", "k", *(f"cast(case when {planted.FIRST} then 0 else length(t) + 120 end as int) + {c} as {c}" for c in "se"))
    mark = F.struct(F.col("l").alias("label"), F.col("l").alias("raw_label"), F.col("k").alias("known"), F.col("s").alias("start"), F.col("e").alias("end"), F.expr("substring(left_text, s + 1, e - s)").alias("text"), F.lit(False).alias("placeholder"))
    return p.select("pair_id", "left_text", F.col("left_text").alias("right_text"), F.when(F.col("l").isNotNull(), F.array(mark)).alias("labels"))


@query(planted.compared_sql())
def labelled_comparison(spark, sf_dir):
    """Stage one over pairs with labels, right, wrong, missing, unknown and misplaced."""
    return compare.compare(_labelled(spark, sf_dir)).select("pair_id", "category", "label", "right_label", "left_start", "left_end", "right_start", "right_end")


@query(planted.asked_sql())
def labelled_identification(spark, sf_dir):
    return compare.identify(compare.compare(_labelled(spark, sf_dir))).select("pair_id", "category", "group", "status", "suggest")


def _redacted(spark, sf_dir) -> DataFrame:
    """Turns with a planted sentence on the left and its redaction on the right; all else is the same on both."""
    p = _turns(spark, sf_dir, a=planted.LEFT_SAID, b=planted.RIGHT_SAID)
    return p.selectExpr("n as pair_id", f"{planted.around('a')} as left_text", f"{planted.around('b')} as right_text")


@query(planted.verified_sql())
def redaction_findings(spark, sf_dir):
    """Stage two over pairs that leak, mask, mistype, swap or keep values."""
    return verify.verify(_redacted(spark, sf_dir)).select("pair_id", "category", "label")


def _counted(sql: str, key: str, values) -> str:
    rows = ", ".join(f"('{v}', {k})" for k, v in enumerate(values))
    return f"with f as ({sql}), v as (select * from (values {rows}) t({key}, place)), p as (select n as pair_id from ({planted.PAIRS})) select p.pair_id, v.{key}, v.place, coalesce(c.n, 0) as n from p cross join v left join (select pair_id, {key}, count(*) as n from f group by all) c on c.pair_id = p.pair_id and c.{key} = v.{key}"


@query(_counted(planted.compared_sql(), "category", compare.CATEGORIES))
def stage_one_counts(spark, sf_dir):
    """Findings of each pair by category, 0 where there are none."""
    p = _labelled(spark, sf_dir)
    return stats.category_counts(p.select("pair_id"), compare.compare(p), compare.CATEGORIES)


@query(f"""with a as ({planted.asked_sql()}), p as (select n as pair_id from ({planted.PAIRS})) select p.pair_id, g.gr as "group", count(a.pair_id) as n from p cross join (values ('PI'), ('BI'), ('CRED')) g(gr)
left join a on a.pair_id = p.pair_id and a."group" = g.gr and a.category in ('PI_TODO', 'BI_TODO', 'CRED_TODO', 'IDENTIFIED') group by all""")
def stage_one_groups(spark, sf_dir):
    """Values to label or labelled, of each pair by group."""
    p = _labelled(spark, sf_dir)
    return stats.group_counts(p.select("pair_id"), compare.identify(compare.compare(p)))


@query(planted.label_counts_sql([n for n, _ in patterns.LABELS]))
def stage_one_labels(spark, sf_dir):
    """How often each label was detected on the left and given on the right, by pair."""
    p = _labelled(spark, sf_dir)
    return stats.label_counts(p.select("pair_id"), detect.detections(p, "pair_id", "left_text"), p.select("pair_id", F.explode("labels").alias("x")).select("pair_id", "x.label"))


@query(_counted(planted.verified_sql(), "category", verify.CATEGORIES))
def stage_two_counts(spark, sf_dir):
    p = _redacted(spark, sf_dir)
    return stats.category_counts(p.select("pair_id"), verify.verify(p), verify.CATEGORIES)


@query(planted.redaction_counts_sql())
def redaction_counts(spark, sf_dir):
    """Of each pair the values replaced, leaked and detected."""
    return stats.redaction_counts(_redacted(spark, sf_dir))


@query("""with f as (select o_custkey as pair_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as m, first_value(o_orderkey) over (partition by o_custkey order by o_orderkey) as a,
 first_value(o_orderkey) over (partition by o_custkey order by o_orderkey desc) as z, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as x, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as y from orders)
select pair_id, id, coalesce(x, a) as next_id, coalesce(y, z) as previous_id, ((k - 1) // 100 + 1)::int as page from f""")
def issue_navigation(spark, sf_dir):
    """From each issue of a pair to the next and the one before, round the ends, and the page it is on."""
    f = table(spark, sf_dir, "orders").selectExpr("o_custkey as pair_id", "o_orderkey as id", "o_orderkey as ord")
    return stats.navigation(f).select("pair_id", "id", "next_id", "previous_id", "page")


@query("""select n_nationkey, list_reduce(list_concat([2166136261::ubigint], list_transform(string_split(n_name, ''), lambda c: unicode(c)::ubigint), [1::ubigint], list_transform(string_split('of ' || n_regionkey, ''), lambda c: unicode(c)::ubigint), [1::ubigint]),
 lambda h, c: (xor(h, c) * 16777619) % 4294967296)::bigint as hash from nation""")
def token_hashes(spark, sf_dir):
    """The FNV-1a hash of a list of tokens, which is their cache key."""
    return table(spark, sf_dir, "nation").select("n_nationkey", extract.token_hash(F.array(F.col("n_name"), F.concat(F.lit("of "), "n_regionkey"))).alias("hash"))


@query("""with x as (select c_custkey as doc_id, 'see https://site' || c_custkey || '.org/a, plate KA ' || lpad((c_custkey % 100)::varchar, 2, '0') || ' AB ' || lpad((c_custkey % 10000)::varchar, 4, '0') || ' there' as text from customer),
u as (select doc_id, 'URL/Link' as site, 'https://site' || doc_id || '.org/a' as v, 4 as start from x union all select doc_id, 'Vehicle Number Plate', 'KA ' || lpad((doc_id % 100)::varchar, 2, '0') || ' AB ' || lpad((doc_id % 10000)::varchar, 4, '0'), 4 + length('https://site' || doc_id || '.org/a') + 8 from x)
select doc_id, site, v as text, start::int as start, (start + length(v))::int as "end" from u where not (doc_id % 3 = 0 and site = 'URL/Link')""")
def extras_without_items(spark, sf_dir):
    """Links and plates, but for those that an item covers: here a third of the links."""
    from veilspark.operators import view

    docs = table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "concat('see https://site', c_custkey, '.org/a, plate KA ', lpad(cast(c_custkey % 100 as string), 2, '0'), ' AB ', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' there') as text")
    found = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("b_start"), F.lit(10).alias("b_end"))
    return view.extras_beside(view.placed_extras(docs), found, "doc_id")


@query(f"select n as doc_id, {made.cases([made.quoted(v) for _, v, _ in made.SPOKEN])} as verdict, {made.cases([made.quoted(m) if m else 'null' for _, _, m in made.SPOKEN])} as main_language from ({made.ROWS})")
def spoken_languages(spark, sf_dir):
    """Reports on texts of one language, and of English with a line of another."""
    docs = _made(spark, sf_dir).selectExpr("n as doc_id", made.cases([t for t, _, _ in made.SPOKEN]) + " as text")
    return language.document_report(docs).select("doc_id", "verdict", "main_language")


@query(f"select n as id, {made.cases([made.quoted(w) for w, _ in made.WRITTEN])} as written, {made.cases([made.quoted(x) if x else 'null' for _, x in made.WRITTEN])} as label from ({made.ROWS})")
def resolved_labels(spark, sf_dir):
    from veilspark.functions.labels import resolve_column

    rows = _made(spark, sf_dir).selectExpr("n as id", made.cases([made.quoted(w) for w, _ in made.WRITTEN]) + " as written")
    return rows.select("id", "written", resolve_column(F.col("written")).alias("label"))


def _line_arrays(spark, sf_dir, right: str) -> DataFrame:
    each = lambda ks: "array(" + ", ".join(made.line(str(k)) for k in ks) + ")"
    return _made(spark, sf_dir).selectExpr("n as pair_id", each(range(8)) + " as left_rows", each({"turned": [4, 5, 6, 7, 0, 1, 2, 3], "part": [2, 3, 4, 5]}[right]) + " as right_rows")


@query(f"select n as pair_id, k::int as place, ((k + 4) % 8)::int as row_no, {made.line('k')} as text, 8 as moved from ({made.ROWS}), range(8) t(k)")
def restored_order(spark, sf_dir):
    """Rows that were turned round come back in the order of the left."""
    from veilspark.operators import analyze

    return analyze.reorder(_line_arrays(spark, sf_dir, "turned"))


@query(f"select n as pair_id, 2 as left_from, 5 as left_to, 0 as right_from, 3 as right_to, 4 as matched from ({made.ROWS})")
def comparable_ranges(spark, sf_dir):
    from veilspark.operators import analyze

    return analyze.comparable_range(_line_arrays(spark, sf_dir, "part"))


@query(f"select n as pair_id, 8 as left_rows, 4 as right_rows, 4 as compared_left, 4 as compared_right, 4 as not_compared_left, 0 as not_compared_right, 0 as moved_rows from ({made.ROWS})")
def coverage_of_pairs(spark, sf_dir):
    """Rows compared, not compared and moved."""
    from veilspark.operators import analyze

    rows = _line_arrays(spark, sf_dir, "part")
    return stats.coverage(rows, analyze.comparable_range(rows), analyze.reorder(rows).groupBy("pair_id").agg(F.max("moved").alias("moved")))


@query(f"select n::varchar as task_id, 12::bigint as n_rows, 1::bigint as pieces, {made.lines(0, 11)} as text from ({made.ROWS})")
def assembled_reads(spark, sf_dir):
    """Twelve rows put together again from reads of five, the second half of which come in another order."""
    from veilspark.streaming import assemble

    row = lambda x: F.struct(x.alias("text"), F.array().cast("array<int>").alias("words"), F.lit(False).alias("para"))
    d = _made(spark, sf_dir).selectExpr("n", "array(" + ", ".join(made.line(str(k)) for k in range(12)) + ") as l")
    at = d.select("n", "l", F.posexplode(F.expr("array(0, 3, 2, 6, 5, 7)")).alias("seq", "at"))
    reads = at.select(F.col("n").cast("string").alias("task_id"), F.col("seq").cast("long").alias("seq"), F.lit("left").alias("side"), F.lit("").alias("header"), F.to_json(F.transform(F.slice("l", F.col("at") + 1, F.lit(5)), row)).alias("rows"))
    last = assemble.assemble_batch(reads).groupBy("task_id").agg(F.max_by(F.struct("n_rows", "pieces", "text"), "seq").alias("d"))
    return last.select("task_id", "d.*")


_PAGE = "'<html><head><style>x</style></head><body><h1>Case ' || cast(n as string) || '</h1><p>Write  to <span data-label=\"Person Email\">user' || cast(n as string) || '@gmail.com</span> now</p><script>var a = 1;</script><ul><li>one</li><li>two<br>three</li></ul></body></html>'"


@query(f"select n as page_id, 'Case ' || n || chr(10) || 'Write to user' || n || '@gmail.com now' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'three' || chr(10) as text from ({made.ROWS})")
def made_page_texts(spark, sf_dir):
    from veilspark.sources.html import text_of

    return _made(spark, sf_dir).selectExpr("n as page_id", f"{_PAGE} as html").select("page_id", text_of(F.col("html")).alias("text"))


@query(f"select n as page_id, 'Person Email' as label, true as known, (5 + length(n::varchar) + 1 + 9)::int as start, (5 + length(n::varchar) + 1 + 9 + 14 + length(n::varchar))::int as \"end\", 'user' || n || '@gmail.com' as text, false as placeholder from ({made.ROWS})")
def made_page_labels(spark, sf_dir):
    from veilspark.sources.html import page_labels

    return page_labels(_made(spark, sf_dir).selectExpr("n as page_id", f"{_PAGE} as html")).drop("raw_label")


_BBAN = "lpad(cast(n as string), 18, '7')"


@query(f"select n, 'DE' || lpad(((98 - ({_BBAN} || '131400')::hugeint % 97 + n % 2) % 100)::varchar, 2, '0') || {_BBAN} as value, n % 2 = 0 as valid from ({made.ROWS})")
def iban_checks(spark, sf_dir):
    """Account numbers with their own check digits, and with others."""
    from veilspark.functions.checksums import iban_column

    digits = f"lpad(cast(cast((98 - cast({_BBAN} || '131400' as decimal(38, 0)) % 97 + n % 2) % 100 as int) as string), 2, '0')"
    rows = _made(spark, sf_dir).selectExpr("n", f"'DE' || {digits} || {_BBAN} as value")
    return rows.select("n", "value", iban_column(F.col("value")).alias("valid"))


@query("""with f as (select c_nationkey as pair_id, case c_custkey % 5 when 0 then 'unlabeled' when 1 then 'wrong' when 2 then 'extra' when 3 then 'labeled' else 'check' end as status, case when c_custkey % 5 in (1, 2, 3) then 'Person Name' end as right_label, case c_custkey % 3 when 0 then 'yes' when 1 then 'no' end as verdict from customer),
k as (select *, case when verdict = 'yes' and status = 'unlabeled' then 'label' when verdict = 'yes' and status = 'wrong' then 'relabel' when verdict = 'no' and status in ('labeled', 'wrong', 'extra') then 'remove' end as kind from f)
select pair_id, sum((verdict is null)::int)::bigint as open, sum((verdict is not null and kind is null)::int)::bigint as ok, sum((verdict is not null and kind is not null)::int)::bigint as fix from k group by pair_id""")
def reviewer_decisions_on_labels(spark, sf_dir):
    from veilspark.operators import view

    f = table(spark, sf_dir, "customer").selectExpr("c_nationkey as pair_id", "'Person Email' as label", "'x' as category", "case c_custkey % 5 when 0 then 'unlabeled' when 1 then 'wrong' when 2 then 'extra' when 3 then 'labeled' else 'check' end as status", "case when c_custkey % 5 in (1, 2, 3) then 'Person Name' end as right_label", "case c_custkey % 3 when 0 then 'yes' when 1 then 'no' end as verdict")
    fix, kind, text = view.outcome("L1")
    return view.decision_summary(f.withColumns({"fix": fix, "kind": kind, "outcome": text}))


@query(f"""select n as read_id, k::int as row_no, case k when 0 then 'left ' || n || ' right' when 1 then 'below ' || n else 'far ' || n end as text, k = 2 as para from ({made.ROWS}), range(3) t(k)""")
def rows_of_reads(spark, sf_dir):
    """Lines with boxes as rows: two of one height are one row, and a gap begins a paragraph."""
    from veilspark.operators import analyze

    said = lambda text, x, y: f"named_struct('text', {text}, 'box', array({x}, {y}, 100, 20), 'words', cast(array() as array<struct<text: string, box: array<int>>>))"
    read = f"to_json(named_struct('width', 1000, 'height', 1000, 'lines', array({said(chr(39) + 'right' + chr(39), 400, 101)}, {said(chr(39) + 'left ' + chr(39) + ' || n', 100, 100)}, {said(chr(39) + 'far ' + chr(39) + ' || n', 100, 200)}, {said(chr(39) + 'below ' + chr(39) + ' || n', 100, 130)})))"
    return analyze.read_rows(_made(spark, sf_dir).selectExpr("n as read_id", f"{read} as read"), "read_id").select("read_id", "row_no", "text", "para")


@query("""with e as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as burst from e)
select user_id, max(ts) as ts, count(*) as reads from g group by user_id, burst""")
def bursts_of_events(spark, sf_dir):
    """The last event of each burst of a user's events less than six hours apart."""
    from veilspark.streaming import assemble

    return assemble.debounced(table(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts", "6 hours")


def _check_digits_sql() -> str:
    from veilspark.functions.checksums import turns

    table = ", ".join(f"[{', '.join(map(str, row))}]" for row in turns())
    product = "case when c < 5 then (c + x) % 5 + case when x < 5 then 0 else 5 end when x < 5 then (c - x) % 5 + 5 else (c - x + 5) % 5 end"
    return f"""with v as (select n, '2345' || lpad(n::varchar, 8, '0') as value from ({made.ROWS})), t as (select [{table}] as p)
select n, value, list_reduce(list_concat([0], list_transform(range(12), lambda i: p[i % 8 + 1][substring(reverse(value), i::int + 1, 1)::int + 1])), lambda c, x: {product}) = 0 as valid from v, t"""


@query(_check_digits_sql())
def check_digits(spark, sf_dir):
    """Numbers of twelve digits by Verhoeff's scheme."""
    from veilspark.functions.checksums import verhoeff_column

    rows = _made(spark, sf_dir).selectExpr("n", "concat('2345', lpad(cast(n as string), 8, '0')) as value")
    return rows.select("n", "value", verhoeff_column(F.col("value")).alias("valid"))


@query(f"select n as page_id, 'body/main/left/text' as left_path, 'body/main/right' as right_path, 0.78::double as similarity from ({made.ROWS})")
def page_panels(spark, sf_dir):
    """The two documents of each page, among its frame, a menu, a header, and a box inside the left one."""
    from veilspark.operators import panels

    eight, other = made.lines(0, 7), made.lines(0, 6) + " || chr(10) || " + f"({made.line('90')})"
    each = [
        ("body/main", 0, 100, 900, 800, f"{eight} || chr(10) || {other}"), ("body/main/left", 0, 100, 400, 800, eight), ("body/main/left/text", 10, 110, 380, 780, eight), ("body/main/right", 420, 100, 400, 800, other),
        ("body/menu", 1000, 100, 180, 800, made.lines(20, 27)), ("body/head", 0, 0, 400, 30, eight), ("body/foot", 0, 950, 400, 200, eight),
    ]
    rows = ", ".join(f"named_struct('ord', {k}, 'path', '{p}', 'x', {x}, 'y', {y}, 'width', {w}, 'height', {h}, 'viewport', 1200, 'text', {t})" for k, (p, x, y, w, h, t) in enumerate(each))
    return panels.best_pairs(_made(spark, sf_dir).selectExpr("n as page_id", f"inline(array({rows}))"))


def _coloured(spark, sf_dir) -> DataFrame:
    """Reads of two words, the first on a label's colour, on one that is none's, or on white."""
    rows = lambda colour: f"repeat('FFFFFF', 800) || repeat(repeat('FFFFFF', 10) || repeat('{colour}', 30) || repeat('FFFFFF', 40), 20) || repeat('FFFFFF', 800)"
    image = made.cases([rows(c) for c in ("DCE6FC", "C8C896", "FFFFFF")])
    words = "array(named_struct('start', 0, 'end', 5, 'box', array(10, 10, 30, 20)), named_struct('start', 6, 'end', 10, 'box', array(45, 10, 30, 20)))"
    return _made(spark, sf_dir).selectExpr("n as read_id", f"unhex({image}) as image", "80 as width", "40 as height", "'Alpha beta' as text", f"{words} as words")


@query(f"select n as read_id, case n % 3 when 0 then 'Person Name' end as site_label, case n % 3 when 0 then 0 end::int as start, case n % 3 when 0 then 5 end::int as \"end\", 'Alpha' as text, case n % 3 when 1 then '#c8c896' end as hex, (n % 3)::bigint as count from ({made.ROWS}) where n % 3 < 2")
def colours_behind_words(spark, sf_dir):
    from veilspark.operators import colours

    return colours.label_colours(_coloured(spark, sf_dir))


@query(f"select n % 2 as side, '#c8c896' as hex, count(*) as count, 'Alpha' as example from ({made.ROWS}) where n % 3 = 1 group by 1")
def colours_without_label(spark, sf_dir):
    from veilspark.operators import colours

    return colours.unknown_colours(colours.label_colours(_coloured(spark, sf_dir)).withColumn("side", F.col("read_id") % 2), ["side"])

QUERIES |= pages.QUERIES
SQL |= pages.SQL
QUERIES |= lookups.QUERIES
SQL |= lookups.SQL
QUERIES |= readings.QUERIES
SQL |= readings.SQL
