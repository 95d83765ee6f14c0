"""Pages of HTML as text with a map back to their elements, and label spans read from the markup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.labels import is_placeholder, resolve, PLACEHOLDER

# FIXED VALUES: elements that begin a line, and those that hold no text of a document
BLOCK = set("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody thead tfoot tr ul caption".split())
SKIP = set("script style noscript template svg canvas iframe object button input select textarea img video audio".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PLAIN_ATTRIBUTES = set("class style id href src role type for name autocomplete rel target lang dir alt".split())
_SPACE = " \n\t\r\f\xa0"


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    start: int | None = None
    end: int | None = None
    own: str = ""
    children: list[Element] = field(default_factory=list)

    def covers(self, start: int, end: int) -> None:
        e: Element | None = self
        while e is not None:
            e.start = start if e.start is None else min(e.start, start)
            e.end = end if e.end is None else max(e.end, end)
            e = e.parent


#: Pages of a batch that are taken up at once.
STEP = 32


def parts(rows: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """A batch in parts, so that Python holds few of its texts at a time."""
    return (rows.slice(k, STEP) for k in range(0, len(rows), STEP))


class Page(HTMLParser):
    """text, elements with their ranges, and segments (start, end, element)."""

    def __init__(self, html: str | None, ignore: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.text, self.elements, self.segments, self.ignore = "", [], [], ignore
        self._open: list[Element] = []
        self._skipped: list[str] = []
        self._parts: list[str] = []
        self._size, self._last = 0, "\n"
        self.feed(html or "")
        self.close()
        self.text = "".join(self._parts)

    def _push(self, s: str) -> None:
        self._parts.append(s)
        self._size += len(s)
        self._last = s[-1]

    def _line(self) -> None:
        if self._size and self._last != "\n":
            self._push("\n")

    def handle_starttag(self, tag: str, attrs) -> None:
        given = {k: v or "" for k, v in attrs}
        if self._skipped or tag in SKIP or "hidden" in given or self.ignore & set(given.get("class", "").split()):
            if tag not in VOID:
                self._skipped.append(tag)
            return
        if tag == "br":
            self._push("\n")
            return
        if tag in BLOCK:
            self._line()
        if tag in ("td", "th") and self._size and self._last not in "\n\t":
            self._push("\t")
        e = Element(tag, given, self._open[-1] if self._open else None)
        if e.parent:
            e.parent.children.append(e)
        self.elements.append(e)
        if tag not in VOID:
            self._open.append(e)

    def handle_endtag(self, tag: str) -> None:
        if self._skipped:
            if tag in self._skipped:
                while self._skipped.pop() != tag:
                    pass
            return
        if any(e.tag == tag for e in self._open):
            while self._open.pop().tag != tag:
                pass
        if tag in BLOCK:
            self._line()

    def handle_data(self, data: str) -> None:
        if self._skipped or not data:
            return
        if any(e.tag == "pre" for e in self._open):
            out = data
        else:
            out = re.sub(f"[{_SPACE}]+", " ", data)
            if out[:1] == " " and self._last in " \n\t":
                out = out[1:]
        if out:
            at = self._size
            self._push(out)
            if self._open:
                self._open[-1].own += out
                self._open[-1].covers(at, self._size)
                self.segments.append((at, self._size, self._open[-1]))

    def range_of(self, e: Element) -> tuple[int, int] | None:
        """An element's part of the text, without white space around."""
        if e.start is None:
            return None
        said = self.text[e.start : e.end]
        a, z = e.start + len(said) - len(said.lstrip()), e.end - (len(said) - len(said.rstrip()))
        return (a, z) if z > a else None


def carried_label(e: Element, aliases: dict[str, str] | None = None) -> tuple[str, str] | None:
    """(how, name) of the label in an element's attributes or classes."""
    for k, v in e.attributes.items():
        if k not in PLAIN_ATTRIBUTES and resolve(v, aliases):
            return f"attr:{k}", v
    for c in e.attributes.get("class", "").split():
        for k in range(1, len(c)):
            if c[k - 1] in "-_" and resolve(c[k:], aliases):
                return f"class:{c[:k]}", c[k:]
    return None


def label_pattern(page: Page) -> tuple[str, int] | None:
    """The most common way in which labels are carried, and how often."""
    ways = Counter(w[0] for e in page.elements if (w := carried_label(e)))
    return min(ways.items(), key=lambda x: (-x[1], not x[0].startswith("attr:"))) if ways else None


def labels_of(page: Page, way: str | None = None, placeholder: str = PLACEHOLDER, aliases: dict[str, str] | None = None) -> list[dict]:
    """Spans of labelled elements, the outermost of nested ones, and free placeholders outside of them. aliases: more
    names (plain: small letters and digits) and the labels they stand for."""
    found = [(e, w[1]) for e in page.elements if (w := carried_label(e, aliases)) and (way is None or w[0] == way)]
    chosen = {id(e) for e, _ in found}

    def inner(e: Element) -> bool:
        up = e.parent
        while up is not None and id(up) not in chosen:
            up = up.parent
        return up is not None

    out = []
    for e, raw in found:
        if not inner(e) and (at := page.range_of(e)):
            said = page.text[slice(*at)]
            out.append({"label": resolve(raw, aliases) or raw, "raw_label": raw, "known": resolve(raw, aliases) is not None, "start": at[0], "end": at[1], "text": said, "placeholder": is_placeholder(said, placeholder)})
    covered = [(x["start"], x["end"]) for x in out]
    for m in re.finditer(placeholder, page.text) if placeholder else ():
        if resolve(m[1], aliases) and not any(m.start() < z and m.end() > a for a, z in covered):
            out.append({"label": resolve(m[1], aliases), "raw_label": m[1], "known": True, "start": m.start(), "end": m.end(), "text": m[0], "placeholder": True})
    return sorted(out, key=lambda x: x["start"])


def text_of(html: Column) -> Column:
    """The text of a column of pages, by Arrow batches, of which a few pages at a time are taken up."""

    @F.arrow_udf("string")
    def convert(pages: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([Page(h).text for h in part.to_pylist()], pa.string()) for part in parts(pages)] or [pa.array([], pa.string())])

    return convert(html)


def page_labels(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", placeholder: str = PLACEHOLDER, aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, label, raw_label, known, start, end, text, placeholder): the labels that the markup of pages carries, with their places in the page's text."""
    fields = "label string, raw_label string, known boolean, start int, end int, text string, placeholder boolean"

    @F.pandas_udf(f"array<struct<{fields}>>")
    def found(html: pd.Series) -> pd.Series:
        return html.map(lambda h: labels_of(Page(h), None, placeholder, aliases))

    return pages.select(F.col(id_col), F.inline(found(F.col(html_col))))
