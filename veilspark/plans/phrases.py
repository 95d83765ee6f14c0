"""Phrases of a table in texts, as an equi-join of token sequences.

A text's tokens stay where they are; which of its sequences can be a phrase is told in the row. Where phrases are the
same for all texts, such as a dictionary, by a table of slots, of a size that follows their number up to a bound (beyond
it all sequences are candidates), for their first tokens and for the whole of them; where each document has its own, such
as the values found in it, by the hashes of its own. Only candidates are exploded, and joined with the phrases by all of
their tokens; which side is broadcast, if any, is left to the sizes.

cover() then takes what is found from left to right, by preference where several begin at one place, and goes on behind
what it took: runs of overlapping phrases, which are short, are folded one by one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import scan
from veilspark.functions import sqltext as Q

#: Letters, marks and digits in a row, or one other sign.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
#: Slots (of a byte) for each phrase, and the smallest and largest table.
SLOTS, LEAST, MOST = 8, 1 << 16, 1 << 24
AROUND = 48


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column, block: int = 64) -> Column:
    """Where each piece begins, summed up by blocks."""
    summed = lambda values, of: F.aggregate(
        values, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a")), lambda acc, x: F.struct((acc["s"] + of(x)).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    )
    blocks = lambda all_of: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / block).cast("int")), lambda b: summed(F.slice(all_of, b * block + 1, block), lambda x: x))
    spread = lambda own: _let(summed(own, lambda x: x["s"])["a"], lambda base: F.flatten(F.transform(own, lambda x, i: F.transform(x["a"], lambda at: at + F.get(base, i)))))
    return _let(lengths, lambda all_of: _let(blocks(all_of), spread))


def sequence(name: str, pattern: str = TOKEN, normal: Callable[[Column], Column] = F.lower) -> Column:
    """The tokens of a column alone, as phrases have them."""
    return F.transform(F.regexp_extract_all(F.expr(scan.clean(Q.col(name)).sql), F.lit(pattern), F.lit(0)), normal)


def _slots(told: DataFrame) -> tuple[Column, int] | None:
    """The table of slots that hashes (h, distinct) fall into, as a literal, and its size; None where it would be too large."""
    count, size = told.count(), LEAST
    while size < SLOTS * count:
        size *= 2
    if size > MOST:
        return None
    at = told.select(F.pmod("h", F.lit(size)).alias("at")).distinct().toArrow()
    table = np.zeros(size, np.uint8)
    table[at.column(0).to_numpy()] = 1
    return F.lit(bytearray(table.tobytes())), size


def found(docs: DataFrame, phrases: DataFrame, on: list[str], text: str = "text", pattern: str = TOKEN, normal: Callable[[Column], Column] = F.lower, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Where phrases stand in docs (on, row, text): a row for each place: on, row, at (the place among the tokens), n, start,
    end, said, before, after (AROUND characters), and the columns of phrases.

    phrases: (on, toks, more), each sequence of tokens once for each `on`. row has to tell rows apart. normal: what
    is made of a text's tokens before they are compared; phrases have it done. keep: more columns of docs."""
    own = phrases.where("size(toks) > 0").withColumns({"n": F.size("toks"), "gram": F.array_join("toks", " ")})
    told_of = own.groupBy("n").agg(F.count("*").alias("c")).collect()
    lengths = sorted(r.n for r in told_of) or [1]
    if on:
        hashes = own.groupBy(*on).agg(F.collect_set(F.xxhash64(F.element_at("toks", 1))).alias("_heads"), F.collect_set(F.xxhash64("gram")).alias("_grams"))
        docs = docs.join(hashes, on)
        tables = {}
        told = lambda _, h, name: F.array_contains(name, h)
    else:
        # first tokens are few, so that hardly any other token is taken for one
        asked = {"_heads": F.element_at("toks", 1), "_grams": F.col("gram")}
        tables = {name: _slots(own.select(F.xxhash64(c).alias("h")).distinct()) for name, c in asked.items()}
        tables = {name: x for name, x in tables.items() if x}

        def told(taken: Column, h: Column, name: str) -> Column:
            if name not in tables:
                return F.lit(True)
            return F.substring(taken[name], F.pmod(h, F.lit(tables[name][1])).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

    def rows(parts: Column, taken: Column) -> Column:
        first, whole = (lambda h: told(taken, h, "_heads")), (lambda h: told(taken, h, "_grams"))

        # what lies between tokens and the tokens by turns; places are told only where a first token is met
        words = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k % 2 == 1), lambda k: normal(F.get(parts, k)))

        def met(toks: Column) -> Column:
            gram = lambda i, n: F.array_join(F.slice(toks, i, n), " ")
            heads = F.filter(F.sequence(F.lit(1), F.size(toks)), lambda i: first(F.xxhash64(F.element_at(toks, i))))
            grams = lambda i: F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: (i + n - 1 <= F.size(toks)) & whole(F.xxhash64(gram(i, n))))

            # the number of parts before a token, and what some of the parts say
            until = lambda i: 2 * i - 1
            said = lambda a, n: F.array_join(F.slice(parts, a + 1, n), "")

            def placed(some: Column) -> Column:
                # of the parts before each first token those since the one before it are measured, all at once
                since = F.transform(some, lambda x, k: _let(F.coalesce(until(F.get(some, k - 1)["i"]), F.lit(0)), lambda a: F.length(said(a, until(x["i"]) - a))))

                def one(i: Column, n: Column, start: Column) -> Column:
                    def hit(end: Column) -> Column:
                        return F.struct(
                            (i - 1).alias("at"), n.alias("n"), gram(i, n).alias("gram"), start.alias("start"), end.alias("end"), F.substring(F.col(text), start + 1, end - start).alias("said"),
                            F.substring(F.col(text), F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND))).alias("before"), F.substring(F.col(text), end + 1, F.lit(AROUND)).alias("after"),
                        )

                    return _let(start + F.length(said(until(i), 2 * n - 1)), hit)

                def at(since: Column) -> Column:
                    starts = lambda before: F.transform(some, lambda x, k: _let(F.get(before, k) + F.get(since, k), lambda start: F.transform(x["ns"], lambda n: one(x["i"], n, start))))
                    return F.flatten(_let(_starts(since), starts))

                return F.when(F.size(some) > 0, _let(since, at))

            return _let(F.filter(F.transform(heads, lambda i: F.struct(i.alias("i"), grams(i).alias("ns"))), lambda x: F.size(x["ns"]) > 0), placed)

        return F.when(F.size(parts) > 1, _let(words, met))

    marked = F.expr(Q.split(scan.marked(scan.clean(Q.col(text)), pattern), scan._CUT, -1).sql)
    # the tables stand in the plan once
    hits = _let(F.struct(marked.alias("_parts"), *(x[0].alias(name) for name, x in tables.items())), lambda x: rows(x["_parts"], x))
    # outer: else a filter would be inferred that computes the hits twice more
    could = docs.select(*dict.fromkeys([*on, "row", *keep]), F.inline_outer(hits)).where("n is not null")
    return could.join(own, [*on, "n", "gram"]).drop("gram")


def cover(hits: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Of overlapping hits (start, end) of each `on` those that a walk from left to right takes; of several at one place
    the first by `order`."""
    w = Window.partitionBy(*on).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.withColumn("_key", F.struct("start", *(c.alias(f"_{k}") for k, c in enumerate(order)))).withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    fields = [c for c in hits.columns if c not in on]
    runs = rows.groupBy(*on, "_run").agg(F.sort_array(F.collect_list(F.struct("_key", F.struct(*fields).alias("hit")))).alias("s"))
    nothing = F.struct(F.lit(0).cast(hits.schema["end"].dataType).alias("free"), F.slice(F.transform("s", lambda x: x["hit"]), 1, 0).alias("kept"))
    step = lambda acc, x: F.when(x["hit"]["start"] >= acc["free"], F.struct(x["hit"]["end"].alias("free"), F.concat(acc["kept"], F.array(x["hit"])).alias("kept"))).otherwise(acc)
    return runs.select(*on, F.inline(F.aggregate("s", nothing, step)["kept"]))
