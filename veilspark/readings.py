"""Queries over lines of documents as reads of a screen have them, some misread, with their SQL, which compares all lines of
a document with all of its reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import rows
from veilspark.plans.materialize import dealt, once

#: A read shows ten lines; every sixth line begins one. Every third line is misread: its eighth character.
_MISREAD = "case when (j + floor(j / 6)) % 3 = 1 and length(line) >= 20 then substring(line, 1, 7) || 'q' || substring(line, 9) else line end"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    out = d.select("doc_id", F.posexplode(lines).alias("j", "line")).selectExpr("doc_id", "j", "line", f"{_MISREAD} as seen")
    return once(out.select("doc_id", "j", rows.row_key(F.col("line")).alias("key"), rows.row_key(F.col("seen")).alias("seen")))


def _reads(lines: DataFrame) -> DataFrame:
    shown = lines.withColumn("read", F.explode(F.expr("filter(array(floor(j / 6), floor(j / 6) - 1), r -> r >= 0 and j - 6 * r < 10)")))
    return shown.select("doc_id", "read", (F.col("j") - 6 * F.col("read")).cast("int").alias("i"), F.col("seen").alias("key"))


def near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents and their misread forms: which lines of the document each may be, how many."""
    lines = _lines(spark, sf_dir)
    pairs = rows.near_keys(lines, lines.select("doc_id", F.col("seen").alias("key")), ["doc_id"])
    return pairs.groupBy("doc_id", F.col("b_key").alias("key")).agg(F.count("*").alias("near"), F.min("a_key").alias("first"))


def placed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each read lies in its document."""
    lines = _lines(spark, sf_dir)
    return rows.offsets(lines.select("doc_id", "j", "key"), _reads(lines), ["doc_id"]).select("doc_id", "read", "offset", F.round("votes", 6).alias("votes"), "hits")


_KEY = r"regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_LINES = f"""raw as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') != '') as l from documents),
line as (select doc_id, j - 1 as j, l[j] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as j from raw)),
lines as (select doc_id, j, {_KEY.format('line')} as key, {_KEY.format(_MISREAD)} as seen from line),
keys as (select k, regexp_replace(k, '[^0-9]', '', 'g') as digits, case when length(k) < 2 then [] else list_transform(range(1, length(k)), lambda i: k[i:i + 1]) end as pairs from (select distinct key as k from lines union select distinct seen from lines)),
counted as (select k, any_value(digits) as digits, map_from_entries(list((p, c))) as m from (select k, digits, p, count(*) as c from (select k, digits, unnest(pairs) as p from keys) group by all) group by k),
near as (select distinct a.doc_id, a.key as a_key, b.seen as b_key from (select distinct doc_id, key from lines) a join (select distinct doc_id, seen from lines) b on a.doc_id = b.doc_id left join counted x on x.k = a.key left join counted y on y.k = b.seen
 where a.key = b.seen or (x.digits = y.digits and length(a.key) >= 12 and length(b.seen) >= 12 and abs(length(a.key) - length(b.seen)) <= greatest(3, 0.08 * length(a.key))
  and 2 * list_sum(list_transform(map_keys(x.m), lambda p: least(x.m[p], coalesce(y.m[p], 0)))) / (length(a.key) + length(b.seen) - 2) >= 0.9))"""
NEAR_SQL = f"with {_LINES} select doc_id, b_key as key, count(*) as near, min(a_key) as first from near group by all"
PLACED_SQL = f"""with {_LINES},
reads as (select doc_id, r as read, j - 6 * r as i, seen as key from (select doc_id, j, seen, unnest([j // 6, j // 6 - 1]) as r from lines) where r >= 0 and j - 6 * r < 10),
met as (select r.doc_id, read, i, r.key, l.j, r.key = l.key and length(r.key) >= 4 as same from reads r join near n on n.doc_id = r.doc_id and n.b_key = r.key join lines l on l.doc_id = r.doc_id and l.key = n.a_key),
could as (select * from (select *, bool_or(same) over w as exact, count(*) over w as n from met window w as (partition by doc_id, read, i)) where case when exact then same else n = 1 end),
vote as (select doc_id, read, j - i as d, sum(1 + length(key) / 40) as v, count(*) as hits, max(length(key)) as longest, min((i, j)) as f from could group by all),
best as (select doc_id, read, arg_min((d, v, hits, longest), (-round(v, 9), f)) as b from vote group by all)
select doc_id, read, case when ok then b[1] end::int as "offset", case when ok then round(b[2], 6) end as votes, case when ok then b[3] end as hits
from (select r.doc_id, r.read, b, b[3] >= 2 or b[4] >= 25 as ok from (select distinct doc_id, read from reads) r left join best using (doc_id, read))"""

QUERIES = {f.__name__: f for f in (near_lines, placed_reads)}
SQL = {"near_lines": NEAR_SQL, "placed_reads": PLACED_SQL}
