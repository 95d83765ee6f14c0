"""Pages as a table of their elements, and what is asked of it: ranges, places of offsets, selectors, ways of labelling.

One narrow pass reads the markup and gives a row for each element: number in reading order, parent, ancestors, attributes,
and the stretches of the page's text that stand in it directly. All else are joins, windows and aggregates over rows:

- an element's range is the least and the greatest place of its own stretches and those of all elements inside it;
- an offset is looked up by cutting the stretches' reach into pieces of equal width, so that a page of any length is
  met by hash and no page is held by one task;
- `:nth-of-type` is a number within equal parents and tags;
- whether a selector is unique is a count, and the path up to the nearest unique ancestor a join of at most 8 levels;
- how labels are carried is judged element by element, voted on by page, with badges as a union without repeats.

Ids may be of any type; a null or empty page has no rows; rows that share an id share a page's number space, so ids have
to be unique."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.labels import resolve_column
from veilspark.plans import intervals
from veilspark.plans.materialize import once
from veilspark.sources.html import BLOCK, PLAIN_ATTRIBUTES, Page, parts

#: Levels above an element that a selector may go up.
LEVELS = 7
#: Characters of an element's text beyond which it is no labelled span.
LONGEST = 400

_SEGMENT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "first", "last")])
_NODE = [
    T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("tag", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("segments", T.ArrayType(_SEGMENT)),
]


def _rows(page: Page) -> list[tuple]:
    number = {id(e): k for k, e in enumerate(page.elements)}
    own: dict[int, list[dict]] = {}
    for start, end, e in page.segments:
        said = page.text[start:end]
        bare = len(said.strip())
        first = start + len(said) - len(said.lstrip())
        own.setdefault(number[id(e)], []).append({"start": start, "end": end, "first": first if bare else None, "last": first + bare if bare else None})
    paths: list[list[int]] = []
    for e in page.elements:
        up = number[id(e.parent)] if e.parent else None
        paths.append([] if up is None else [*paths[up], up])
    return [(k, p[-1] if p else None, p, e.tag, list(e.attributes.items()), own.get(k, [])) for k, (e, p) in enumerate(zip(page.elements, paths))]


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", ignore: tuple[str, ...] = ()) -> DataFrame:
    """(id, node, parent, path, tag, attributes, segments): a row for each element of each page; parent is null at the top.
    segments: (start, end) in the page's text (html.text_of), and first, last without white space around (null: nothing else).
    ignore: classes whose elements don't belong to the text."""
    out = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), *_NODE])
    left_out = frozenset(ignore)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            for part in parts(b):
                place, rows = [], []
                for k, html in enumerate(part.column(1).to_pylist()):
                    rows += _rows(Page(html, left_out))
                    place += [k] * (len(rows) - len(place))
                columns = zip(*rows) if rows else [()] * len(_NODE)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int32())), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return pages.select(F.col(id_col), F.col(html_col).cast("string").alias("_html")).mapInArrow(run, out)


def ranges(table: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, node, start, end): the text of each element, without white space around; elements without text have no row."""
    least, most = F.array_min(F.transform("segments", lambda s: s["first"])), F.array_max(F.transform("segments", lambda s: s["last"]))
    own = table.select(id_col, F.concat("path", F.array("node")).alias("_up"), least.alias("_a"), most.alias("_z")).where("_a is not null")
    return own.select(id_col, F.explode("_up").alias("node"), "_a", "_z").groupBy(id_col, "node").agg(F.min("_a").alias("start"), F.max("_z").alias("end"))


def places(table: DataFrame, id_col: str = "page_id") -> DataFrame:
    """table with nth and of_type: which of its parent's elements of its tag an element is, and of how many."""
    w = Window.partitionBy(id_col, "parent", "tag")
    return table.withColumns({"nth": F.row_number().over(w.orderBy("node")), "of_type": F.count("*").over(w).cast("int")})


def located(table: DataFrame, spans: DataFrame, id_col: str = "page_id") -> DataFrame:
    """spans (id, start, end, more) with the elements and places that they begin and end in: start_node, start_at, end_node,
    end_at, counted in the stretch of text found (start_from and end_from are where it begins in the page's text).

    A span that begins between stretches begins with the next one, one that ends there ends with the one before; a span
    that holds no stretch at all goes, as does one behind the last."""
    own = once(table.select(id_col, "node", F.inline("segments")).select(id_col, "node", F.col("start").alias("s"), F.col("end").alias("e")))
    w = Window.partitionBy(id_col).orderBy("s")
    # a stretch is the first that ends behind every place from the end of the one before, and the last to begin up to the next one's start
    reach = own.withColumns({"from": F.coalesce(F.lag("e").over(w), F.lit(0)), "to": F.coalesce(F.lead("s").over(w), F.col("e"))})
    last = own.groupBy(id_col).agg(F.max("e").alias("_last"))
    keyed = spans.where("start < end").withColumn("_span", F.monotonically_increasing_id()).join(last, id_col)

    def met(at: Column, a: str, z: str, name: str) -> DataFrame:
        points = keyed.select(id_col, "_span", at.alias("start"), (at + 1).alias("end"))
        hit = intervals.overlap_join(points, reach.select(id_col, "node", "s", "e", F.col(a).alias("b_start"), F.col(z).alias("b_end")), id_col)
        return hit.select("_span", F.col("node").alias(f"{name}_node"), F.col("s").alias(f"{name}_from"), F.col("e").alias(f"_{name}_e"))

    begins, ends = met(F.col("start"), "from", "e", "start"), met(F.least(F.col("end"), F.col("_last")) - 1, "s", "to", "end")
    both = keyed.join(begins, "_span").join(ends, "_span").where("start_from <= end_from")
    out = both.withColumns({"start_at": F.greatest("start", "start_from") - F.col("start_from"), "end_at": F.least("end", "_end_e") - F.col("end_from")})
    return out.select(*spans.columns, "start_node", "start_from", "start_at", "end_node", "end_from", "end_at")


# selectors ----------------------------------------------------------------------------------------------------------

#: FIXED VALUES: attributes that name an element, and what makes an id or a class one that a later page may not have
NAMING = ("data-testid", "data-test", "data-qa", "data-cy", "data-test-id", "data-panel", "data-role", "aria-label", "role", "name")
_SHIFTING_ID = r"(?i)\d{4,}|[0-9a-f]{8,}|^:r|^(?:ember|react|radix|headlessui|mui)"
_SHIFTING_CLASS = (
    r"(?i)^(?:css|sc|jsx|emotion|styled|tw|svelte|astro|chakra|mantine)-|^[a-z]{1,3}-?[a-z0-9]{5,}$|[0-9a-f]{6,}"
    r"|^(?:active|selected|hover|focus|focused|open|opened|closed|visible|hidden|show|disabled|is-|has-)"
)


def _escaped(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"([^A-Za-z0-9_\-\x{80}-\x{10FFFF}])", r"\\$1"), "^([0-9])", r"\\3$1 ")


def stable_classes(attributes: Column) -> Column:
    """Up to three classes that don't look made for one build or state."""
    names = F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: c != "")
    return F.slice(F.filter(F.array_distinct(names), lambda c: (F.length(c) < 40) & ~c.rlike(_SHIFTING_CLASS) & ~(c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.length(c) >= 6))), 1, 3)


def _with_classes(tag: Column, classes: Column) -> Column:
    return F.concat(tag, F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), _escaped(c))), ""))


def selectors(table: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, node, selector): a short selector for each element by what is likely to last: a unique id, naming attribute or
    set of classes, or else its step below the nearest ancestor that has one (or body)."""
    attributes = F.col("attributes")
    # read and dealt by pages once: windows, counts and joins are all within pages, so that nothing moves again
    base = places(table.select(id_col, "node", "parent", "path", "tag", "attributes").repartition(id_col), id_col).withColumns({
        "_id": F.when((F.length(attributes["id"]) < 60) & ~attributes["id"].rlike(_SHIFTING_ID), attributes["id"]),
        "_classes": stable_classes(attributes), "_given": F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: c != ""),
    }).withColumn("_plain", _with_classes(F.col("tag"), F.col("_classes")))
    base = once(base)
    # names by which an element may be the only one: (kind, what), counted within its page; an id counts whether stable or not
    named = F.array(F.struct(F.lit(-1).alias("k"), F.lit("").alias("a"), attributes["id"].alias("v")), *(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), attributes[a].alias("v")) for k, a in enumerate(NAMING)))
    each = base.select(id_col, "node", "tag", "_id", F.inline(F.filter(named, lambda x: x["v"].isNotNull() & (x["v"] != ""))))
    only = each.groupBy(id_col, F.when(F.col("k") < 0, "").otherwise(F.col("tag")).alias("t"), "k", "v").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("tag").alias("tag"), F.first("_id").alias("_id"), F.first("a").alias("a"))
    own = only.where("n = 1 and (k < 0 and _id is not null or k >= 0 and length(v) <= 60)").groupBy(id_col, "node").agg(
        F.min_by(F.when(F.col("k") < 0, F.concat(F.lit("#"), _escaped(F.col("v")))).otherwise(F.concat("tag", F.lit("["), "a", F.lit('="'), _escaped(F.col("v")), F.lit('"]'))), "k").alias("_named")
    )
    # a set of classes is unique if no other element of the tag has them all
    sets = base.where("size(_classes) > 0").groupBy(id_col, "tag", "_classes").agg(F.count("*").alias("n")).where("n = 1").select(id_col, "tag", "_classes", F.element_at("_classes", 1).alias("_c"))
    having = base.select(id_col, "tag", "node", "_given", F.explode(F.array_distinct("_given")).alias("_c")).join(sets, [id_col, "tag", "_c"]).where(F.size(F.array_except("_classes", "_given")) == 0)
    lone = having.groupBy(id_col, "tag", "_classes").agg(F.count("*").alias("n")).where("n = 1").select(id_col, "tag", "_classes", F.lit(True).alias("_lone"))
    known = base.join(own, [id_col, "node"], "left").join(lone, [id_col, "tag", "_classes"], "left")
    known = known.withColumn("_own", F.coalesce("_named", F.when(F.col("_lone"), F.col("_plain")))).withColumn("_step", F.when(F.col("of_type") > 1, F.concat("_plain", F.lit(":nth-of-type("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.col("_plain")))
    up = known.select(id_col, "node", F.posexplode(F.slice(F.reverse(F.concat("path", F.array("node"))), 1, LEVELS + 1)).alias("k", "above"))
    info = known.select(id_col, F.col("node").alias("above"), "_own", "_plain", "_step", "parent")
    over = base.select(id_col, F.col("node").alias("parent"), F.col("tag").alias("_over"))
    chain = up.join(info.join(over, [id_col, "parent"], "left"), [id_col, "above"])
    head = F.coalesce("_own", F.when(F.col("_over").isNull() | (F.col("_over") == "html") | (F.col("k") >= LEVELS), F.col("_plain")), F.when(F.col("_over") == "body", F.concat(F.lit("body > "), "_step")))
    steps = chain.groupBy(id_col, "node").agg(F.sort_array(F.collect_list(F.struct("k", head.alias("head"), F.col("_step").alias("step")))).alias("s"))
    at = F.array_min(F.transform(F.filter("s", lambda x: x["head"].isNotNull()), lambda x: x["k"]))
    said = F.concat(F.array(F.get("s", at)["head"]), F.transform(F.reverse(F.slice("s", F.lit(1), at)), lambda x: x["step"]))
    return steps.select(id_col, "node", F.array_join(said, " > ").alias("selector"))


# labels -------------------------------------------------------------------------------------------------------------


def _label(name: Column, aliases: Column | None) -> Column:
    own = resolve_column(name)
    return own if aliases is None else F.coalesce(F.try_element_at(aliases, F.regexp_replace(F.lower(name), "[^a-z0-9]", "")), own)


def carried(attributes: Column, aliases: Column | None = None) -> Column:
    """(way, name, label) of the label in attributes or classes, null where there is none. aliases: a map of more names, in
    small letters and digits."""
    said = lambda way, name: F.struct(way.alias("way"), name.alias("name"), _label(name, aliases).alias("label"))
    by_name = F.transform(F.filter(F.map_entries(attributes), lambda e: ~e["key"].isin(*sorted(PLAIN_ATTRIBUTES))), lambda e: said(F.concat(F.lit("attr:"), e["key"]), e["value"]))
    classes = F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: F.length(c) > 1)
    cuts = lambda c: F.filter(F.sequence(F.lit(1), F.length(c) - 1), lambda k: F.substr(c, k, F.lit(1)).isin("-", "_"))
    by_class = F.flatten(F.transform(classes, lambda c: F.transform(cuts(c), lambda k: said(F.concat(F.lit("class:"), F.left(c, k)), F.substr(c, k + 1)))))
    return F.get(F.filter(F.concat(by_name, by_class), lambda w: w["label"].isNotNull()), F.lit(0))


def label_ways(table: DataFrame, texts: DataFrame, id_col: str = "page_id", text_col: str = "text", aliases: Column | None = None) -> DataFrame:
    """(id, node, way, name, label, badges): elements that carry a label: in an attribute, in a class, or in a small child
    that names it (a badge); badges are the selectors of all such children, which labels in attributes may have too.
    texts: (id, text) of the pages."""
    table = once(table)
    kept = table.join(ranges(table, id_col), [id_col, "node"]).where(F.col("end") - F.col("start") <= LONGEST)
    kept = kept.select(id_col, "node", "parent", "tag", _with_classes(F.col("tag"), stable_classes(F.col("attributes"))).alias("sel"), carried(F.col("attributes"), aliases).alias("way"), "start", "end")
    inner = table.where("parent is not null").select(id_col, F.col("parent").alias("node")).distinct()
    said = F.substr(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start"))
    # elements without elements inside that carry no label themselves, and what they say
    small = kept.where("way is null").join(inner, [id_col, "node"], "left_anti").join(texts.select(id_col, text_col), id_col)
    small = small.select(id_col, F.col("parent").alias("node"), F.col("node").alias("child"), F.col("sel").alias("badge"), said.alias("name"))
    named = small.where(~F.col("name").rlike(r"^[\[<{(]")).withColumn("label", _label(F.col("name"), aliases)).where("label is not null")
    around = kept.where(~F.col("tag").isin(*sorted(BLOCK | {"body"}))).select(id_col, "node", (F.col("end") - F.col("start")).alias("_whole"))
    badges = named.join(around, [id_col, "node"]).where(F.col("_whole") > F.length("name")).groupBy(id_col, "node").agg(F.min_by(F.struct("badge", "name", "label"), "child").alias("b"), F.array_sort(F.collect_set("badge")).alias("badges"))
    both = kept.select(id_col, "node", "sel", "way").join(badges, [id_col, "node"], "left").where("way is not null or b is not null")
    way = F.coalesce(F.col("way"), F.struct(F.concat(F.lit("badge:"), "sel", F.lit(">"), F.col("b.badge")).alias("way"), F.col("b.name").alias("name"), F.col("b.label").alias("label")))
    return both.select(id_col, "node", way.alias("w"), F.coalesce("badges", F.array().cast("array<string>")).alias("badges")).select(id_col, "node", "w.way", "w.name", "w.label", "badges")


def patterns(ways: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, way, count, badges): how most labels of a page are carried (of equal ones attributes, then classes, then the
    first to be met), and the selectors of all badges, whose text doesn't belong to the document."""
    counts = ways.groupBy(id_col, "way").agg(F.count("*").alias("count"), F.min("node").alias("n"), F.flatten(F.collect_set("badges")).alias("b"))
    order = F.when(F.col("way").startswith("attr:"), 0).when(F.col("way").startswith("class:"), 1).otherwise(2)
    best = counts.groupBy(id_col).agg(F.min(F.struct((-F.col("count")).alias("c"), order.alias("o"), "n", "way")).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))).alias("badges"))
    return best.select(id_col, F.col("m.way").alias("way"), (-F.col("m.c")).alias("count"), "badges")
