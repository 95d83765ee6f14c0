"""Rows of text met by joins: the same line read twice with a letter or two misread, and where a read lies in its document.

Two keys are near if their digits agree, their lengths do within a band and nine tenths of their letter pairs. The pairs of
letters of near keys differ in few places, so of as many parts as that and one more, into which all letter pairs are dealt,
one holds the same of both: keys are looked up by what their parts hold, among those of the same document and digits, and
what meets is verified. Keys go to their document's task once, and a chunk of documents is judged at a time. An offset is a
vote: which rows a key may be is settled once a key, distances are summed by document, read and distance, and the heaviest
wins; all of it stays in the document's partition."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import rowmatch

#: FIXED VALUES: characters below which keys are only equal or not, the part of the length that may differ (3 at least),
#: the share of letter pairs that agree, and the characters of a row that is enough by itself
SHORTEST, BAND, ALIKE, ENOUGH, LEAST = 12, 0.08, 0.9, 25, 4
_NO_DIGIT = re.compile("[^0-9]+")
#: How far lengths that share their number of parts lie apart, characters of a chunk, and pairs judged at once.
STEP, CHUNK, AT_ONCE = 1.2, 1 << 20, 1 << 17


def row_key(text: Column) -> Column:
    """Letters and digits of a row in lower case, without accents (NFKD, which SQL doesn't have: a small Arrow function)."""

    @F.pandas_udf("string")
    def keys(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: rowmatch.key(t or ""))

    return keys(text)


def letter_pairs(key: Column) -> Column:
    """All pairs of neighbouring letters of a key."""
    return F.get(F.transform(F.array(F.split(key, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1)))), F.lit(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _class(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, SHORTEST) / SHORTEST) / np.log(STEP) + 1e-9).astype(np.int64)


def _parts(c: np.ndarray) -> np.ndarray:
    """In how many letter pairs a key of a length of class c and a near one may differ, and one more."""
    longest = SHORTEST * STEP ** (c + 1) + 1
    return np.floor((1 - ALIKE) * (2 * longest + np.maximum(3, BAND * longest)) + 1e-6).astype(np.int64) + 1


def _digits(key: str) -> str:
    return _NO_DIGIT.sub("", key)


def near_pairs(group: np.ndarray, keys: list[str], own: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of keys, own ones and read ones, of the same group, that are near and not the same; keys of a group are distinct."""
    size = np.array([len(k) for k in keys], np.int64)
    letters = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    n = np.maximum(size - 1, 0)
    at = _ranges(bounds[:-1], n)
    pairs, first = letters[at] << np.uint64(32) | letters[at + 1], np.concatenate([[0], np.cumsum(n)])
    here = _mixed(pairs)
    digits = np.array([hash(_digits(k)) for k in keys], np.int64)
    place = _mixed(_mixed(group.astype(np.uint64)) + digits.astype(np.uint64))

    def parts(rows: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each part of the rows' letter pairs holds, as a number, and whose it is; c: the class that is looked up."""
        many = _parts(c)
        begin = np.concatenate([[0], np.cumsum(many)])
        of = np.repeat(np.arange(len(rows)), n[rows])
        h = here[_ranges(first[rows], n[rows])]
        held = np.zeros(begin[-1], np.uint64)
        np.add.at(held, begin[of] + (h % many[of].astype(np.uint64)).astype(np.int64), _mixed(h))
        whose = np.repeat(np.arange(len(rows)), many)
        which = (np.arange(begin[-1]) - begin[whose]).astype(np.uint64) << np.uint64(16) | c[whose].astype(np.uint64)
        return _mixed(_mixed(held + place[rows][whose]) + which), rows[whose]

    long = size >= SHORTEST
    mine, theirs = np.flatnonzero(own & long), np.flatnonzero(read & long)
    a_hash, a_row = parts(mine, _class(size[mine]))
    order = np.argsort(a_hash, kind="stable")
    a_hash, a_row = a_hash[order], a_row[order]
    # a read key looks among all lengths in whose band it lies
    low = _class(np.minimum(size[theirs] - 3, np.floor(size[theirs] / (1 + BAND)).astype(np.int64)))
    high = _class(np.maximum(size[theirs] + 3, np.ceil(size[theirs] / (1 - BAND)).astype(np.int64)))
    b_hash, b_row = parts(np.repeat(theirs, high - low + 1), _ranges(low, high - low + 1))
    begin = np.searchsorted(a_hash, b_hash, "left")
    many = np.searchsorted(a_hash, b_hash, "right") - begin
    some = np.flatnonzero(many)
    begin, many, b_row = begin[some], many[some], b_row[some]
    # letter pairs of a row, each once, with how often it is there
    _, number = np.unique(pairs, return_inverse=True)
    kinds = int(number.max()) + 1 if len(number) else 1
    told, often = np.unique(np.repeat(np.arange(len(keys)), n) * kinds + number, return_counts=True)
    told_of = np.searchsorted(told, np.arange(len(keys) + 1) * kinds)
    out = [np.zeros((0, 2), np.int64)]
    ends = np.cumsum(many)
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 16 * AT_ONCE, "right")))
        # what many keys hold is met slice by slice
        for k in range(0, int(many[i:j].sum()), 16 * AT_ONCE):
            a, b = (a_row[begin[i] + k : begin[i] + min(k + 16 * AT_ONCE, many[i])], b_row[i]) if j == i + 1 else (a_row[_ranges(begin[i:j], many[i:j])], np.repeat(b_row[i:j], many[i:j]))
            b = np.broadcast_to(b, a.shape)
            ok = (a != b) & (group[a] == group[b]) & (digits[a] == digits[b]) & (np.abs(size[a] - size[b]) <= np.maximum(3.0, size[a] * BAND))
            met = np.unique(a[ok] * len(keys) + b[ok])
            step = max(1, AT_ONCE * 4 // int(np.diff(told_of).max(initial=1)))
            for m in range(0, len(met), step):
                x, y = np.divmod(met[m : m + step], len(keys))
                count = told_of[x + 1] - told_of[x]
                mine_at = _ranges(told_of[x], count)
                of = np.repeat(np.arange(len(x)), count)
                wanted = told[mine_at] - np.repeat(x, count) * kinds + np.repeat(y, count) * kinds
                there = np.minimum(np.searchsorted(told, wanted), len(told) - 1)
                common = np.where(told[there] == wanted, np.minimum(often[mine_at], often[there]), 0)
                shared = np.bincount(of, common, len(x))
                near = 2 * shared / (size[x] + size[y] - 2) >= ALIKE
                out.append(np.stack([x[near], y[near]], 1))
        i = j
    found = np.unique(np.concatenate(out), axis=0)
    same = np.array([_digits(keys[x]) == _digits(keys[y]) for x, y in found.tolist()], bool)
    return found[same, 0], found[same, 1]


def _paired(on: list[str]):
    """Of rows (on, key, own, read), those of one `on` after each other: which are equal or near, a chunk of whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            own, read = (t.column(c).to_numpy() for c in ("own", "read"))
            a, b = near_pairs(group, t.column("key").to_pylist(), own, read)
            same = np.flatnonzero(own & read)
            a, b = np.concatenate([same, a]), np.concatenate([same, b])
            return pa.Table.from_arrays([*(t.column(c).take(pa.array(a)) for c in on), *(t.column("key").take(pa.array(x)) for x in (a, b))], [*on, "a_key", "b_key"])

        def groups(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            for c in on:
                codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return np.cumsum(new)

        held, size, enough = [], 0, CHUNK
        for batch in batches:
            held, size = [*held, batch], size + batch.column("key").nbytes
            if size < enough:
                continue
            t = pa.Table.from_batches(held)
            group = groups(t)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield from judged(t.slice(0, whole), group[:whole]).to_batches()
            rest = t.slice(whole).combine_chunks()
            # a group of many chunks is looked at again when it has doubled
            held, size, enough = rest.to_batches(), rest.nbytes, max(CHUNK, 2 * rest.nbytes)
        if held:
            t = pa.Table.from_batches(held)
            yield from judged(t, groups(t)).to_batches()

    return run


def _together(df: DataFrame, on: list[str]) -> DataFrame:
    """df with all of one `on` in one partition, the same for all tables that are dealt so: joins on more columns leave it there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def near_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, a_key, b_key): distinct keys of a and of b (on, key), of the same `on`, that are equal or near, a's being the row
    of the document by whose length the band is measured. Keys of one `on` are held by one task at once."""
    told = lambda df, own: df.select(*on, "key", F.lit(own).alias("own"), F.lit(not own).alias("read"))
    known = told(a, True).union(told(b, False)).dropna(subset=[*on, "key"])
    each = _together(known, on).groupBy(*on, "key").agg(F.max("own").alias("own"), F.max("read").alias("read")).sortWithinPartitions(*on)
    schema = T.StructType([*(each.schema[c] for c in on), T.StructField("a_key", T.StringType()), T.StructField("b_key", T.StringType())])
    return each.mapInArrow(_paired(on), schema)


def could_be(rows: DataFrame, reads: DataFrame, on: list[str]) -> DataFrame:
    """(on, read, i, key, j): rows j of documents (on, j, key) that rows i of reads (on, read, i, key) may be: all that are
    equal and not too short, or else the only near one."""
    # settled by the key alone: its equal rows, or how many there are of all and the first
    own = _together(rows, on).groupBy(*on, F.col("key").alias("a_key")).agg(F.collect_list("j").alias("js"))
    met = _together(near_keys(rows, reads, on), on).join(own, [*on, "a_key"])
    equal = (F.col("a_key") == F.col("b_key")) & (F.length("b_key") >= LEAST)
    each = met.groupBy(*on, F.col("b_key").alias("key")).agg(F.first(F.when(equal, F.col("js")), ignorenulls=True).alias("same"), F.sum(F.size("js")).alias("n"), F.min(F.get("js", F.lit(0))).alias("only"))
    js = each.withColumn("js", F.when(F.col("same").isNotNull(), F.col("same")).when(F.col("n") == 1, F.array("only"))).where("js is not null").select(*on, "key", "js")
    return _together(reads, on).join(js, [*on, "key"]).select(*on, "read", "i", "key", F.explode("js").alias("j"))


def offsets(rows: DataFrame, reads: DataFrame, on: list[str]) -> DataFrame:
    """(on, read, offset, votes, hits): how far the rows of a read lie behind the document's, by votes of its rows, long ones
    counting more; null where under two rows agree, or one of no more than a few words. Of equal ones the first to be met."""
    votes = could_be(rows, reads, on).withColumn("d", F.col("j") - F.col("i"))
    summed = votes.groupBy(*on, "read", "d").agg(F.sum(1 + F.length("key") / 40).alias("v"), F.count("*").alias("hits"), F.max(F.length("key")).alias("longest"), F.min(F.struct("i", "j")).alias("first"))
    best = summed.groupBy(*on, "read").agg(F.min(F.struct((-F.round("v", 9)).alias("v"), "first", "d", "hits", "longest")).alias("b"))
    enough = (F.col("b.hits") >= 2) | (F.col("b.longest") >= ENOUGH)
    every = _together(reads.select(*on, "read"), on).distinct()
    return every.join(best.where(enough).select(*on, "read", F.col("b.d").alias("offset"), (-F.col("b.v")).alias("votes"), F.col("b.hits").alias("hits")), [*on, "read"], "left")
