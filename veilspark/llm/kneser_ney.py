"""LM scoring by an interpolated modified Kneser-Ney model of any order.

Counting: each chunk of documents sends its distinct n-grams of the highest order, as compressed blocks with
dictionaries of their words, to the partition of the n-gram's hash, so that a frequent word spreads over all of them.
There the counts are summed and written as a shard of the model: ascending hashes and their counts. What the shard knows
of shorter n-grams is combined and sent on to their own shards, one order after the other down to single words: how
often an n-gram follows and after how many words (as the end of longer ones), how often it leads and to how many words
once, twice and more often (as their beginning). A shard is written under another name and then moved, so a repeated task
leaves the same file; every partition writes one, so a file that isn't there is an error and never an empty shard.

Scoring: workers memory-map the shards and look up the distinct n-grams of a chunk by binary search; nothing of the
model is loaded or broadcast but its counts of counts. The shared folder must be one that workers can open.

Model: p(w|h) = (a(hw) - D(a)) / sum(h) + g(h) p(w|h'), h' without its first word; a is the count of an n-gram at the
highest order and the number of distinct words before it below; D are the discounts of 1, 2 and 3 or more from the
counts of counts of each order, g what they set free. At the end p(w) = (n(w) - D(n)) / n + g' / (V + 1), n(w) the number
of distinct words before w. An unseen context gives the shorter one's probability; an unseen word has n(w) = 0. N-grams
are told apart by 64-bit hashes.

Defined cases: a null or empty text is its end token alone; texts of any length are scored whole; with nothing to learn
from every token has probability 1 / (V + 1) = 1; rows are scored one by one, whatever their ids, and keep all their
columns but those of the result's names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import shared, text
from veilspark.llm.shared import runs

BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
#: The order of the model where none is given.
ORDER = 2
_WIRE = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("blocks", T.ArrayType(T.BinaryType())), T.StructField("stats", T.ArrayType(T.LongType()))])
#: What is known of an n-gram: how often it follows, after how many words, how often it leads, and to how many words once, twice and more often.
FIELDS = ("count", "before", "leads", "once", "twice", "more")


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return text.mix(v * np.uint64(0xC6A4A7935BD1E995) + text.mix(w + np.uint64(0x632BE59BD9B4E019)))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """Of n-grams given by a column for each word; a word's is its own."""
    h = words[0]
    for w in words[1:]:
        h = pair_hash(h, w)
    return h


def sequences(hashes: np.ndarray, ptr: np.ndarray, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams that end at every word and each text's end, a column for each word, and each text's first."""
    n = len(ptr) - 1
    w = np.insert(hashes, ptr[1:], END)
    at = ptr + np.arange(n + 1)
    place = np.arange(len(w)) - np.repeat(at[:-1], np.diff(at))
    columns = [w]
    for k in range(1, order):
        v = np.full_like(w, BEGIN)
        v[k:] = np.where(place[k:] >= k, w[:-k], BEGIN)
        columns.insert(0, v)
    return columns, at


def _sent(words: list[np.ndarray], numbers: np.ndarray, n: int, stats: list[int] | None) -> pa.RecordBatch:
    """Distinct n-grams and their numbers, a row for each partition; stats go with the first."""
    part = (gram_hash(words) % np.uint64(n)).astype(np.int32)
    order = np.lexsort((words[0], part))
    words, numbers, part = [w[order] for w in words], numbers[..., order], part[order]
    at = runs(part)
    parts, blocks = [], []
    for i, j in zip(at[:-1], at[1:]):
        own = runs(words[0][i:j])
        made = [text.packed(words[0][i:j][own[:-1]], True), text.packed(np.diff(own).astype(np.uint32)), text.packed(np.ascontiguousarray(numbers[..., i:j]).ravel())]
        for w in words[1:]:
            known, place = np.unique(w[i:j], return_inverse=True)
            made += [text.packed(known, True), text.packed(place.astype(np.uint32))]
        parts.append(int(part[i]))
        blocks.append(made)
    return shared.batch(_WIRE, [parts, blocks, [stats] + [None] * (len(parts) - 1) if parts else []])


def _opened(blocks: list[bytes], order: int, kind) -> tuple[list[np.ndarray], np.ndarray]:
    words = [np.repeat(text.unpacked(blocks[0], np.uint64, True), text.unpacked(blocks[1], np.uint32))]
    for k in range(order - 1):
        words.append(text.unpacked(blocks[3 + 2 * k], np.uint64, True)[text.unpacked(blocks[4 + 2 * k], np.uint32)])
    return words, text.unpacked(blocks[2], kind)


def _grams(n: int, chunk: int, order: int):
    def flush(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(c) for c in zip(*columns)]
        h = gram_hash(words)
        by = np.argsort(h, kind="stable")
        at = runs(h[by])
        return _sent([w[by[at[:-1]]] for w in words], np.diff(at).astype(np.uint32), n, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data, bounds = text.text_buffer(b.column(0))
            starts, ends, ptr = text.split_words(data, bounds)
            columns, _ = sequences(text.hash_spans(data, starts, ends, fold=True), ptr, order)
            held.append(columns)
            size += len(columns[0])
            if size >= chunk:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _store(folder: str, name: str, hashes: np.ndarray, *numbers: np.ndarray) -> None:
    """A shard: its length, the hashes, and each row of numbers as bytes; numbers from 255 on follow by place."""
    path = f"{folder}/{name}"
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(np.array([len(hashes), len(numbers)], "<i8").tobytes() + hashes.astype("<u8").tobytes())
        for x in numbers:
            large = np.flatnonzero(x >= 255)
            small = np.where(x >= 255, 255, x).astype(np.uint8).tobytes()
            f.write(np.array([len(large)], "<i8").tobytes() + large.astype("<i8").tobytes() + x[large].astype("<i8").tobytes() + small + b"\0" * (-len(small) % 8))
    os.replace(made, path)


class Shard:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, k = np.frombuffer(self.map, "<i8", 2)
        self.hashes = np.frombuffer(self.map, "<u8", n, 16)
        at, self.numbers = 16 + 8 * int(n), []
        for _ in range(k):
            m = int(np.frombuffer(self.map, "<i8", 1, at)[0])
            large, values = np.frombuffer(self.map, "<i8", m, at + 8), np.frombuffer(self.map, "<i8", m, at + 8 + 8 * m)
            at += 8 + 16 * m
            self.numbers.append((np.frombuffer(self.map, "u1", n, at), large, values))
            at += int(n) + -int(n) % 8

    def find(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The numbers of ascending hashes; 0 where there is none."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        there = (self.hashes[at] == hashes) if len(self.hashes) else np.zeros(len(at), bool)
        out = []
        for small, large, values in self.numbers:
            x = np.zeros(len(hashes), np.int64)
            x[there] = small[at[there]]
            over = np.flatnonzero(x == 255)
            if len(over):
                x[over] = values[np.searchsorted(large, at[over])]
            out.append(x)
        return out


def _counted(n: int, folder: str, order: int, level: int):
    """Sums the n-grams of one length in a partition and writes their shard; what it tells of those one word shorter goes
    on. Single words give their stats instead: four counts of counts for each length, tokens, distinct pairs, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, stats = [], [], np.zeros(4 * order + 3, np.int64)
        for b in batches:
            for r in range(len(b)):
                words, own = _opened(b.column(1)[r].as_py(), level, np.uint32 if level == order else np.int64)
                held.append(words)
                numbers.append(own.astype(np.int64) if level == order else own.reshape(len(FIELDS), -1))
                if (told := b.column(2)[r].as_py()) is not None:
                    stats += np.array(told)
        shard = f"{level}-{TaskContext.get().partitionId()}"
        fields = 1 if level == order else len(FIELDS)
        if not held:
            _store(folder, shard, np.zeros(0, np.uint64), *np.zeros((fields, 0), np.int64))
            return
        words = [np.concatenate(c) for c in zip(*held)]
        total = np.concatenate(numbers, axis=-1)
        del held, numbers
        h = gram_hash(words)
        by = np.argsort(h, kind="stable")
        at = runs(h[by])
        first = by[at[:-1]]
        total = np.add.reduceat(total[..., by], at[:-1], axis=-1)
        h, words = h[first], [w[first] for w in words]
        _store(folder, shard, h, *np.atleast_2d(total))
        count, a = (total, total) if level == order else (total[0], total[1])
        stats[4 * (level - 1) : 4 * level] = [int((a == k).sum()) for k in (1, 2, 3, 4)]
        if level == order:
            stats[-3] = int(count.sum())
        if level == 1:
            stats[-2:] = [int(a.sum()), int((a > 0).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([stats.tolist()], pa.list_(pa.int64()))], names=["stats"])
            return
        able = np.flatnonzero(a > 0)  # the others are known as beginnings alone
        count, a, words = count[able], a[able], [w[able] for w in words]
        m = len(able)
        made = np.zeros((len(FIELDS), 2 * m), np.int64)
        made[0, :m], made[1, :m] = count, 1
        made[2, m:], made[3, m:], made[4, m:], made[5, m:] = a, a == 1, a == 2, a >= 3
        both = [np.concatenate(c) for c in zip(words[1:], words[:-1])]
        h = gram_hash(both)
        by = np.argsort(h, kind="stable")
        at = runs(h[by])
        first = by[at[:-1]]
        yield _sent([w[first] for w in both], np.add.reduceat(made[:, by], at[:-1], axis=1), n, stats.tolist())

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 0, 1, 2 and from 3."""
    if not n1 or not n2:
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    own = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [0.0, *(min(max(d, 0.05), k) for k, d in zip((1.0, 2.0, 3.0), own))]


class Model:
    def __init__(self, folder: str, about: dict):
        self.folder, self.about = folder, about

    def _found(self, kind: str, hashes: np.ndarray, fields: int) -> list[np.ndarray]:
        """Of distinct ascending hashes."""
        out = [np.zeros(len(hashes), np.int64) for _ in range(fields)]
        part = (hashes % np.uint64(self.about["shards"])).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = runs(part[order])
        for i, j in zip(at[:-1], at[1:]):
            own = order[i:j]
            for to, x in zip(out, _shard(f"{self.folder}/{kind}{part[own[0]]}").find(hashes[own])):
                to[own] = x
        return out

    def _known(self, level: int, hashes: np.ndarray, fields: int) -> list[np.ndarray]:
        """Of hashes in any order, repeated ones as well."""
        own, place = np.unique(hashes, return_inverse=True)
        return [x[place] for x in self._found(str(level) + "-", own, fields)]

    def score(self, hashes: np.ndarray, ptr: np.ndarray) -> dict[str, np.ndarray]:
        m = self.about
        order = m["order"]
        columns, at = sequences(hashes, ptr, order)
        count, before, *_ = self._known(1, columns[-1], len(FIELDS))
        e = np.array(m["discounts"][0])
        p = np.maximum(before - e[np.minimum(before, 3)], 0) / max(m["types"], 1) + m["spare"] / (m["vocabulary"] + 1)
        for k in range(2, order + 1):
            d = np.array(m["discounts"][k - 1])
            _, _, leads, once, twice, more = self._known(k - 1, gram_hash(columns[-k:-1]), len(FIELDS))
            c = self._known(k, gram_hash(columns[-k:]), 1)[0] if k == order else self._known(k, gram_hash(columns[-k:]), len(FIELDS))[1]
            total = np.maximum(leads, 1)
            free = np.where(leads > 0, (d[1] * once + d[2] * twice + d[3] * more) / total, 1.0)
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / total + free * p
        base = np.log10((count + 1) / (m["tokens"] + 1 * (m["vocabulary"] + 1)))
        return {"n_tokens": np.diff(at), "n_known": np.add.reduceat((count > 0).astype(np.int64), at[:-1]), "base_score": np.add.reduceat(base, at[:-1]), "score": np.add.reduceat(np.log10(p), at[:-1])}


@lru_cache(maxsize=4096)
def _shard(path: str) -> Shard:
    """A shard; every part of the model has a file, empty ones too, so that one that isn't there is an error."""
    return Shard(path)


def local_path(folder: str) -> str:
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"workers can't map files of {folder}; spark.checkpoint.dir has to be a mounted folder here")
    return at.path


def train(docs: DataFrame, text_col: str = "text", chunk: int = text.CHUNK_WORDS, order: int = ORDER) -> Model:
    """Learns from all rows of docs; order is at least 2."""
    if order < 2:
        raise ValueError("the order of the model is at least 2")
    spark = shared.prepared(docs.sparkSession)
    n = shared.parts(spark)
    folder = f"{local_path(shared.folder(spark))}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    at = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(_grams(n, chunk // (order - 1), order), _WIRE)
    for level in range(order, 0, -1):
        at = shared.routed(at, n).mapInArrow(_counted(n, folder, order, level), _WIRE if level > 1 else "stats array<bigint>")
    sums = [r.s or 0 for r in at.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s")).orderBy("k").collect()] or [0] * (4 * order + 3)
    tokens, types, vocabulary = sums[-3:]
    each = [discounts(*sums[4 * k : 4 * k + 4]) for k in range(order)]
    e, singles = each[0], sums[:4]
    rest = vocabulary - singles[0] - singles[1]
    spare = (e[1] * singles[0] + e[2] * singles[1] + e[3] * rest) / types if types else 1.0
    about = {"order": order, "shards": n, "types": types, "tokens": tokens, "vocabulary": vocabulary, "discounts": each, "spare": spare}
    with open(f"{folder}/about.json", "w") as f:
        json.dump(about, f)
    return Model(folder, about)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10); these replace columns of such names."""
    shared.prepared(docs.sparkSession)
    more = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    kept = [c for c in docs.columns if c not in more]
    packed = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in kept if c != text_col), F.lit(0).alias("_pad")).alias("_rest"))
    out = T.StructType([*packed.schema, *(T.StructField(k, t) for k, t in more.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            data, bounds = text.text_buffer(b.column(b.schema.get_field_index("_text")))
            starts, ends, ptr = text.split_words(data, bounds)
            s = model.score(text.hash_spans(data, starts, ends, fold=True), ptr)
            yield shared.batch(out, [*b.columns, s["n_tokens"], s["n_known"], np.full(len(b), model.about["tokens"]), s["base_score"], s["score"]])

    scored = packed.mapInArrow(run, out)
    return scored.select(*(F.col("_text").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in kept), *more)
