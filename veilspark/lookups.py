"""Queries that look names and values up in documents by joins, with their SQL: the sentence that each document gets, and
what documents have of their own, say what is to be found."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import made, planted
from veilspark.functions import known
from veilspark.functions.table import register_detector
from veilspark.made import N, quoted
from veilspark.operators import detect, lexicon, scan
from veilspark.plans.materialize import dealt, once


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _said(spark: SparkSession, sf_dir: str, **sentences: str) -> DataFrame:
    """doc_id and, for each name given, documents' texts with that sentence."""
    d = dealt(_table(spark, sf_dir, "documents").selectExpr("doc_id as n", "coalesce(text, '') as t"))
    return d.selectExpr("n as doc_id", *(f"{planted.around('(' + said + ')')} as {name}" for name, said in sentences.items()))


def _pieces(cases: list[list], columns) -> str:
    """Of each case the pieces that are to be found, at their places, in DuckDB: columns(piece) names what a row has besides."""
    parts = []
    for k, case in enumerate(cases):
        at = "said_at"
        for p in case:
            if not isinstance(p, str):
                parts.append(f"select n as doc_id, ({at})::int as start, ({at} + length({p[0]}))::int as \"end\", {p[0]} as text, {columns(p)} from placed where n % {len(cases)} = {k}")
            at += f" + length({p if isinstance(p, str) else p[0]})"
    return " union all ".join(parts)


def _sentence(cases: list[list]) -> str:
    return made.cases([" || ".join(f"({p if isinstance(p, str) else p[0]})" for p in case) for case in cases])


# names of a dictionary ----------------------------------------------------------------------------------------------

_CUSTOMER = "'Customer#' || lpad(cast(n % 100 + 1 as string), 9, '0')"
_BANKS, _IT = "Banks · Private", "Top MNCs · Indian IT"
#: Each case: plain text, or (text, name, category) of an entry that is to be found.
NAMED: list[list] = [
    ["'paid '", (f"{_CUSTOMER} || ' Pvt Ltd'", _CUSTOMER, "'Customers'"), "' today'"],
    ["'from '", ("'HDFC BANK'", "'HDFC Bank'", f"'{_BANKS}'"), "' and '", ("'Bank of Baroda'", "'Bank of Baroda'", "'Banks · Public Sector'"), "', not HDFC Banks or hdfc bank'"],
    ["'Ravi Infosys spoke and our '", ("'Infosys'", "'Infosys'", f"'{_IT}'"), "' did not'"],
    ["'see '", (f"upper({_CUSTOMER})", _CUSTOMER, "'Customers'"), "' or xWipro or '", ("'TCS Limited.'", "'TCS'", f"'{_IT}'"), "' Dell1 and Delhi'"],
]


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in names and all customers."""
    own = spark.createDataFrame([(n, c, k) for k, (n, c) in enumerate(known.entries(json.loads(known.BUILT_IN)))], "name string, category string, place long")
    return own.union(_table(spark, sf_dir, "customer").select(F.col("c_name"), F.lit("Customers"), F.col("c_custkey") + 1000))


def known_names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.known_names(_said(spark, sf_dir, text=_sentence(NAMED)), _dictionary(spark, sf_dir))


NAMES_SQL = f"with {planted.placed_sql(_sentence(NAMED))} {_pieces(NAMED, lambda p: f'{p[1]} as name, {p[2]} as category')}"


def known_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers as others write them, looked up."""
    written = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 4 when 0 then c_name when 1 then upper(c_name) || '  LTD' when 2 then c_name || ' Private Limited.' else 'No ' || c_name end as text")
    return lexicon.lookup(written, lexicon.dictionary_of(_dictionary(spark, sf_dir))).select("c_custkey", "text", "known_name", "known_category")


LOOKUP_SQL = """select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then upper(c_name) || '  LTD' when 2 then c_name || ' Private Limited.' else 'No ' || c_name end as text,
case when c_custkey % 4 < 3 then c_name end as known_name, case when c_custkey % 4 < 3 then 'Customers' end as known_category from customer"""


# values that leaked -------------------------------------------------------------------------------------------------

_MAIL, _HANDLE = f"'user' || {N} || '@gmail.com'", f"'@ravi' || {N}"
_LEFT = f"'Write to ' || {_MAIL} || ' or ping ' || {_HANDLE} || ' now'"
#: The same on the right: kept, removed, in capitals and glued to a word, run on. What leaks are tuples.
RIGHT: list[list] = [
    ["'Write to '", (_MAIL, "Person Email", "9", _MAIL), "' or ping '", (_HANDLE, "Person Username", f"9 + length({_MAIL}) + 9", _HANDLE), "' now'"],
    ["'Write to somebody or ping nobody now'"],
    ["'WRITE to '", (f"upper({_MAIL})", "Person Email", "9", _MAIL), f"' or x' || {_HANDLE} || ' now'"],
    [f"'Write to ' || {_MAIL} || 'z or ping ' || {_HANDLE} || '0 now'"],
]


def leaked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found in documents that stand in a rewritten version of them: those of the sentence by its rule, and all that documents have of their own."""
    pairs = _said(spark, sf_dir, left_text=_LEFT, right_text=_sentence(RIGHT))
    values = scan.detections(pairs, "doc_id", "left_text")
    return lexicon.leaks(values, pairs, "doc_id")


def _leaks_sql() -> str:
    right = _sentence(RIGHT)
    said = f"case when {planted.FIRST} then length(said) + 120 else 0 end"
    own = planted.own_sql(("address-ip", "card", "key", "phone"))
    parts = _pieces(RIGHT, lambda p: f"{quoted(p[1])} as label, {p[3]} as value, (left_at + {p[2]})::int as left_start, (left_at + {p[2]} + length({p[3]}))::int as left_end")
    return f"""with d as (select doc_id as n, coalesce(text, '') as t from documents),
placed as (select *, {said} as shift, case when {planted.FIRST} then length({_LEFT}) + 120 else 0 end as left_shift, case when {planted.FIRST} then 0 else length(t) + 120 end as said_at, case when {planted.FIRST} then 0 else length(t) + 120 end as left_at from (select *, {right} as said from d)),
own as ({own}), first as (select n, lower(text) as low, arg_min(label, start) as label, arg_min(text, start) as value, min(start) as a from own group by all)
select doc_id, label, value, left_start, left_end, start, "end", text from ({parts})
union all select own.n, first.label, first.value, (a - shift + left_shift)::int, (a - shift + left_shift + length(value))::int, start, "end", text from own join first on own.n = first.n and lower(own.text) = first.low join placed on placed.n = own.n"""


# repeats of names ---------------------------------------------------------------------------------------------------

_FIRST = "(case n % 4 when 0 then 'Ravi' when 1 then 'Asha' when 2 then 'Priya' else 'Arun' end)"
_LAST = "(case n % 4 when 0 then 'Kumar' when 1 then 'Shah' when 2 then 'Sharma' else 'Verma' end)"
_FULL = f"{_FIRST} || ' ' || {_LAST}"
REPEATED: list[list] = [
    [f"'Mr. ' || {_FULL} || ' met us. Then '", (_FULL, 0.8, "name-repeat-full"), "' and '", (_LAST, 0.65, "name-repeat-part"), f"' saw ' || {_FIRST} || 'x, and also '", (_FIRST, 0.65, "name-repeat-part"), "' twice'"],
    [f"'Mr. ' || {_FULL} || ' is not ' || lower({_FULL}) || ' nor ' || {_FIRST} || 'ji or a' || {_LAST}"],
    [f"'the dog saw '", f"'only cats '", f"{N}"],
]


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other places of the names that documents introduce, whole or in part."""
    docs = _said(spark, sf_dir, text=_sentence(REPEATED))
    found = once(detect.detections(docs, only=("name",), overlaps=True).where("rule not like 'name-repeat%'"))
    return lexicon.repeated_names(found, docs)


REPEATED_SQL = f"with {planted.placed_sql(_sentence(REPEATED))} {_pieces(REPEATED, lambda p: f'{p[1]}::double as confidence, {quoted(p[2])} as rule')}"

# a detector of one's own --------------------------------------------------------------------------------------------


def long_numbers(text: str):
    """Runs of five digits and more; the longer, the surer."""
    return [(*m.span(), 0.5 + 0.02 * len(m[0])) for m in re.finditer("[0-9]{5,}", text)]


def own_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector registered as a table function, over documents in SQL."""
    register_detector(spark, "find_long_numbers", "Ticket", long_numbers)
    docs = dealt(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return spark.sql("select * from find_long_numbers(table({docs}), text => 'text')", docs=docs)


OWN_SQL = r"""with p as (select doc_id, lang, string_split(regexp_replace(text, '[0-9]{5,}', chr(64976) || '\0' || chr(64976), 'g'), chr(64976)) as p from documents),
f as (select doc_id, lang, p[i] as found, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::int as start from (select doc_id, lang, p, unnest(range(2, len(p) + 1, 2)) as i from p))
select doc_id, lang, start, (start + length(found))::int as "end", 'Ticket' as label, round(least(0.99, 0.5 + 0.02 * length(found)), 2)::double as confidence, found from f"""

QUERIES = {f.__name__: f for f in (known_names_in_documents, known_name_lookup, leaked_values, repeated_names, own_detector)}
SQL = {"known_names_in_documents": NAMES_SQL, "known_name_lookup": LOOKUP_SQL, "leaked_values": _leaks_sql(), "repeated_names": REPEATED_SQL, "own_detector": OWN_SQL}
