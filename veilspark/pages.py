"""Queries over pages as tables of elements, with their SQL: a parser of its own that walks the tokens of all pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import scan
from veilspark.functions import sqltext as Q
from veilspark.made import cases
from veilspark.sources import html, nodes

#: Marked-up passages that follow each page by its number n, with what has to be read from them: (way, name, label, badges).
_N = "cast(n as string)"
MARKED: list[tuple[str, list[tuple[str, str, str, str]]]] = [
    (
        f"'<p>Write to <span data-pii=\"Person Email\">user' || {_N} || '@gmail.com</span> or <span data-pii=\"dob\">today</span> now</p>'",
        [("'attr:data-pii'", "'Person Email'", "Person Email", ""), ("'attr:data-pii'", "'dob'", "Person DOB", "")],
    ),
    (
        f"'<p>It is <em class=\"x pii-person-name\">Ravi ' || {_N} || '</em> or <span class=\"mark\">Zen ' || {_N} || ' <sup class=\"tag\">Business Name</sup></span></p>'",
        [("'class:pii-'", "'person-name'", "Person Name", ""), ("'badge:span.mark>sup.tag'", "'Business Name'", "Business Name", "sup.tag")],
    ),
    (
        f"'<p><span class=\"mark\">Ravi ' || {_N} || ' <sup class=\"tag\">Person Name</sup></span> and <b class=\"mark\">Zen ' || {_N} || ' <sup class=\"tag\">company</sup></b> but <i>not <u>[PERSON_NAME]</u></i></p>'",
        [("'badge:span.mark>sup.tag'", "'Person Name'", "Person Name", "sup.tag"), ("'badge:b.mark>sup.tag'", "'company'", "Business Name", "sup.tag")],
    ),
    (
        f"'<section id=\"extra\"><p name=\"lead\">One <span data-pii=\"pan\">P' || {_N} || ' <sub>PAN</sub></span></p><p>Two</p><p class=\"note\">Three<br>Four</p></section>'",
        [("'attr:data-pii'", "'pan'", "PAN Card Number", "sub")],
    ),
]
PASSAGE = cases([m for m, _ in MARKED])
#: How most labels of each passage are carried, how many, and the badges.
VOTED = [("attr:data-pii", 2, ""), ("class:pii-", 1, "sup.tag"), ("badge:span.mark>sup.tag", 1, "sup.tag"), ("attr:data-pii", 1, "sub")]


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "page_id as n", "html").selectExpr("page_id", f"html || {PASSAGE} as html")


#: w: a row for each element of each page (kind 'e'), each stretch of text ('t') and each line break ('n').
WALK = r"""
source as (select page_id, regexp_replace(html || """ + PASSAGE.replace(" n % ", " page_id % ").replace("cast(n as", "cast(page_id as") + r""", '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>|<!doctype[^>]*>', '', 'g') as h from pages),
token as (select page_id, unnest(list_filter(regexp_extract_all(h, '<[^>]*>|[^<]+'), lambda x: true)) as t, unnest(range(1, len(regexp_extract_all(h, '<[^>]*>|[^<]+')) + 1)) as k from source),
kinds as (select page_id, k, t, case when t like '</%' then 'z' when t like '<%' then 'a' else 't' end as kind, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) as tag from token),
walk as (
 select page_id, 0 as k, ''::varchar as kind, ''::varchar as tag, ''::varchar as said, null::bigint as node, []::varchar[] as tags, []::bigint[] as up, 0::bigint as n, 0::bigint as size, chr(10) as last, 0::bigint as start from source
 union all
 select page_id, k, kind, tag, said, node, tags, up, n + (node is not null)::int, size + length(said), case when said = '' then last else right(said, 1) end, size
 from (select w.page_id, t.k, t.tag,
  case when t.kind = 't' then 't' when t.kind = 'a' and t.tag != 'br' then 'e' else 'n' end as kind,
  case when t.kind = 't' then (case when w.last in (' ', chr(10), chr(9)) then ltrim(u, ' ') else u end)
       when t.tag = 'br' then chr(10) when t.tag in (BLOCKS) and w.size > 0 and w.last != chr(10) then chr(10) else '' end as said,
  case when t.kind = 'a' and t.tag != 'br' then w.n end as node,
  case when t.kind = 'a' and t.tag not in ('br', 'meta', 'link', 'img', 'hr') then w.tags || [t.tag] when t.kind = 'z' and list_contains(w.tags, t.tag) then w.tags[:len(w.tags) - list_position(list_reverse(w.tags), t.tag)] else w.tags end as tags,
  case when t.kind = 'a' and t.tag not in ('br', 'meta', 'link', 'img', 'hr') then w.up || [w.n] when t.kind = 'z' and list_contains(w.tags, t.tag) then w.up[:len(w.tags) - list_position(list_reverse(w.tags), t.tag)] else w.up end as up,
  w.n, w.size, w.last
  from walk w join (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '[ \n\t\r\f\x{a0}]+', ' ', 'g') as u from kinds) t on t.page_id = w.page_id and t.k = w.k + 1)),
element as (select page_id, node, tag, case when tag in ('meta', 'link', 'img', 'hr') then up else up[:len(up) - 1] end as path, k from walk where kind = 'e'),
stretch as (select page_id, up[-1] as node, up, start, start + length(said) as z, start + length(said) - length(ltrim(said)) as first, start + length(rtrim(said)) as last, said from walk where kind = 't' and said != '' and len(up) > 0)""".replace("BLOCKS", ", ".join(f"'{b}'" for b in sorted(html.BLOCK)))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages: parent, place among those of its tag, range of text."""
    table = nodes.nodes(marked(spark, sf_dir))
    return nodes.places(table).join(nodes.ranges(table), ["page_id", "node"], "left").select("page_id", "node", "parent", "tag", "nth", "of_type", "start", "end")


ELEMENTS_SQL = f"""with recursive {WALK},
held as (select page_id, unnest(up) as node, first, last from stretch where trim(said) != ''), span as (select page_id, node, min(first) as a, max(last) as z from held group by all)
select page_id, node::int as node, path[-1]::int as parent, tag, row_number() over w::int as nth, count(*) over (partition by page_id, path[-1], tag)::int as of_type, a::int as start, z::int as "end"
from element left join span using (page_id, node) window w as (partition by page_id, path[-1], tag order by node)"""


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of 10 letters and more of the pages' texts, from the one before to the one after: where in which elements they begin and end."""
    source = marked(spark, sf_dir)
    texts = source.select("page_id", html.text_of(F.col("html")).alias("text"))
    word = scan.matches(scan.marked(scan.clean(Q.col("text")), "[a-z]{10,}"))
    spans = texts.select("page_id", F.expr(f"inline({word.sql})")).selectExpr("page_id", "greatest(start - 30, 0) as start", "start + length(whole) + 30 as end", "whole as word", "start as place")
    return nodes.located(nodes.nodes(source), spans).select("page_id", "word", "place", "start_node", "start_at", "end_node", "end_at")


OFFSETS_SQL = f"""with recursive {WALK},
texts as (select page_id, string_agg(said, '' order by k) as text from walk group by page_id),
parts as (select page_id, string_split(regexp_replace(text, '[a-z]{{10,}}', chr(64976) || '\\0' || chr(64976), 'g'), chr(64976)) as p from texts),
word as (select page_id, p[i] as word, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::bigint as place from (select page_id, p, unnest(range(2, len(p) + 1, 2)) as i from parts)),
span as (select page_id, word, place, greatest(place - 30, 0) as a, place + length(word) + 30 as z from word),
b as (select span.page_id, place, arg_min(stretch.node, start) as node, min(start) as s from span join stretch on span.page_id = stretch.page_id and stretch.z > span.a group by all),
e as (select span.page_id, place, arg_max(stretch.node, start) as node, max(start) as s, arg_max(stretch.z, start) as z from span join stretch on span.page_id = stretch.page_id and stretch.start <= span.z - 1 group by all)
select page_id, word, place::int as place, b.node::int as start_node, (greatest(a, b.s) - b.s)::int as start_at, e.node::int as end_node, (least(span.z, e.z) - e.s)::int as end_at
from span join b using (page_id, place) join e using (page_id, place) where b.s <= e.s"""


def page_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short selector of each element."""
    return nodes.selectors(nodes.nodes(marked(spark, sf_dir)))


_ATTRIBUTE = "nullif(regexp_extract(t, '[ ]{0}=\"([^\"]*)\"', 1), '')"
SELECTORS_SQL = f"""with recursive {WALK},
a as (select e.page_id, e.node, e.path[-1] as parent, e.tag, e.path, {_ATTRIBUTE.format('id')} as id, {_ATTRIBUTE.format('name')} as name, replace({_ATTRIBUTE.format('class')}, ' ', '.') as class from element e join token using (page_id, k)),
c as (select *, tag || coalesce('.' || class, '') as plain, count(*) over (partition by page_id, id) as ids, count(*) over (partition by page_id, tag, name) as names, count(*) over (partition by page_id, tag, class) as classes,
 row_number() over (partition by page_id, parent, tag order by node) as nth, count(*) over (partition by page_id, parent, tag) as of_type from a),
o as (select c.*, case when id is not null and ids = 1 then '#' || id when name is not null and names = 1 then c.tag || '[name="' || name || '"]' when class is not null and classes = 1 then plain end as own,
 plain || case when of_type > 1 then ':nth-of-type(' || nth || ')' else '' end as step, u.above as over from c left join (select page_id, node as parent, tag as above from a) u using (page_id, parent)),
climb as (select page_id, node, 0 as k, node as at, ''::varchar as below, null::varchar as done from o
 union all
 select climb.page_id, climb.node, climb.k + 1, o.parent, ' > ' || o.step || below,
  case when own is not null then own || below when over is null or over = 'html' or climb.k >= 7 then plain || below when over = 'body' then 'body > ' || step || below end
 from climb join o on o.page_id = climb.page_id and o.node = climb.at where climb.done is null)
select page_id, node::int as node, done as selector from climb where done is not null"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = marked(spark, sf_dir)
    return nodes.label_ways(nodes.nodes(source), source.select("page_id", html.text_of(F.col("html")).alias("text")))


def page_label_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that pages carry, by attribute, class or badge."""
    return _ways(spark, sf_dir).select("page_id", "way", "name", "label", F.array_join("badges", ",").alias("badges"))


WAYS_SQL = " union all ".join(
    f"select page_id, {way} as way, {name} as name, '{label}' as label, '{badges}' as badges from pages where page_id % {len(MARKED)} = {k}" for k, (_, found) in enumerate(MARKED) for way, name, label, badges in found
)


def page_label_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How most labels of each page are carried, and its badges."""
    return nodes.patterns(_ways(spark, sf_dir)).select("page_id", "way", "count", F.array_join("badges", ",").alias("badges"))


PATTERNS_SQL = " union all ".join(f"select page_id, '{way}' as way, {n}::bigint as count, '{badges}' as badges from pages where page_id % {len(VOTED)} = {k}" for k, (way, n, badges) in enumerate(VOTED))

QUERIES = {f.__name__: f for f in (page_elements, page_offsets, page_selectors, page_label_ways, page_label_patterns)}
SQL = {"page_elements": ELEMENTS_SQL, "page_offsets": OFFSETS_SQL, "page_selectors": SELECTORS_SQL, "page_label_ways": WAYS_SQL, "page_label_patterns": PATTERNS_SQL}
