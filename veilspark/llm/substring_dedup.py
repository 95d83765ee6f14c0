"""Substring dedup: every repeated passage stays only in the document of the smallest id.

Rabin-Karp hashes of all windows of consecutive words go, as compressed blocks of (hash, smallest document of the
chunk), to the partition their bits choose; there the smallest document of the whole corpus is known and every other
holder is told, by document. What a chunk sees twice itself needs no shuffle: all but its first holder are marked at
once, so a passage in a third of all documents costs one entry a chunk. Marked windows merge into maximal intervals.

Windows are taken as equal if their 64-bit hashes are: among n distinct windows that errs about n^2/2^65 times.

Defined cases: a null, empty or blank text has no words; a text of fewer words than a window keeps all; equal ids do
not remove from one another; a row whose id is null keeps all its words and removes none from others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import shared, text

WINDOW = 13
_WIRE = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_kind", T.IntegerType()), T.StructField("_ids", T.BinaryType()), T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])
#: Kinds of blocks: hashes with their holder; intervals [a, b) of words by document; hashes to look for by document; a row of the table.
_HASHES, _SPANS, _MARKS, _ROW = 0, 1, 2, 3


def _blocks(part: np.ndarray, kind: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray | None, delta: bool) -> pa.RecordBatch:
    """Entries that are sorted by part, as a block for each."""
    at = shared.runs(part)
    each = list(zip(at[:-1], at[1:]))
    return shared.batch(_WIRE, [[int(part[i]) for i, _ in each], [kind] * len(each), [text.packed(ids[i:j]) for i, j in each], [text.packed(a[i:j], delta) for i, j in each], [text.packed(b[i:j]) if b is not None else None for i, j in each]])


def _spread(n: int, window: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([h[0] for h in held])
        words = [h[1] for h in held]
        counts = np.concatenate([np.diff(h[2]) for h in held])
        ptr = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(ids, kind="stable")
        if len(order) and (np.diff(order) < 0).any():
            place = np.repeat(ptr[order], counts[order]) + np.arange(ptr[-1]) - np.repeat(np.concatenate([[0], np.cumsum(counts[order])])[:-1], counts[order])
            words, ids, counts = [np.concatenate(words)[place]], ids[order], counts[order]
            ptr = np.concatenate([[0], np.cumsum(counts)])
        found, first = text.doc_windows(np.concatenate(words), ptr, window)
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), np.diff(first))
        order = np.argsort(found, kind="stable")
        found, doc = found[order], doc[order]
        at = shared.runs(found)
        heads = at[:-1]
        holder = np.repeat(ids[doc[heads]] if len(heads) else ids[:0], np.diff(at))
        later = np.flatnonzero(ids[doc] > holder) if len(doc) else heads
        if len(later):
            place = np.sort(order[later])  # windows of the chunk, in its order of documents
            own = np.searchsorted(first, place, "right") - 1
            start = place - first[own]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + window)])
            i = np.flatnonzero(new)
            last = np.append(i[1:], len(start)) - 1
            who = ids[own[i]]
            part = shared.part_of(who, n)
            s = np.argsort(part, kind="stable")
            yield _blocks(part[s], _SPANS, who[s], start[i][s], (start[last] + window)[s], False)
        if len(heads):
            unique, who = found[heads], ids[doc[heads]]
            part = (unique % np.uint64(n)).astype(np.int32)
            s = np.argsort(part, kind="stable")
            yield _blocks(part[s], _HASHES, who[s], unique[s], None, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = text.text_buffer(b.column(1))
            starts, ends, ptr = text.split_words(data, bounds)
            held.append((ids, text.hash_spans(data, starts, ends), ptr))
            size += len(starts)
            if size >= text.CHUNK_WORDS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _told(n: int):
    """In the partition of some hashes: every holder but the smallest is told so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, holders = [], []
        for b in batches:
            kind = b.column(1).to_numpy()
            for i in np.flatnonzero(kind == _HASHES):
                holders.append(text.unpacked(b.column(2)[i].as_py(), np.int64))
                hashes.append(text.unpacked(b.column(3)[i].as_py(), np.uint64, True))
            if (kind == _SPANS).any():
                yield b.filter(pa.array(kind == _SPANS))
        if not hashes:
            return
        h, who = np.concatenate(hashes), np.concatenate(holders)
        del hashes, holders
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        at = shared.runs(h)
        least = np.minimum.reduceat(who, at[:-1])
        later = np.flatnonzero(who > np.repeat(least, np.diff(at)))
        h, who = h[later], who[later]
        if not len(h):
            return
        part = shared.part_of(who, n)
        order = np.lexsort((h, part))
        yield _blocks(part[order], _MARKS, who[order], h[order], None, False)

    return run


def _grouped(ids: np.ndarray, *values: np.ndarray) -> dict[int, tuple]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = shared.runs(ids)
    return {int(ids[i]): tuple(v[order[i:j]] for v in values) for i, j in zip(at[:-1], at[1:])} if len(ids) else {}


def _cut(window: int, schema: T.StructType):
    """In the partition of some documents: blocks come first, then the rows they speak of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, spans = ([], []), ([], [], [])
        told: dict[int, tuple] | None = None
        known: dict[int, tuple] = {}
        for b in batches:
            kind = b.column("_kind").to_numpy()
            for i in np.flatnonzero(kind == _MARKS):
                marks[0].append(text.unpacked(b.column("_ids")[i].as_py(), np.int64))
                marks[1].append(text.unpacked(b.column("_a")[i].as_py(), np.uint64))
            for i in np.flatnonzero(kind == _SPANS):
                for to, name in zip(spans, ("_ids", "_a", "_b")):
                    to.append(text.unpacked(b.column(name)[i].as_py(), np.int64))
            rows = b.filter(pa.array(kind == _ROW))
            if not len(rows):
                continue
            if told is None:
                told = _grouped(*(np.concatenate(x) for x in marks)) if marks[0] else {}
                known = _grouped(*(np.concatenate(x) for x in spans)) if spans[0] else {}
                marks = spans = ([], [], [])
            ids = rows.column("_id").to_pylist()
            texts = rows.column("_text").to_pylist()
            kept, n_words, n_removed = [], [], []
            for one, said in zip(ids, texts):
                words = (said or "").encode().split()
                out = np.zeros(len(words), bool)
                edge = np.zeros(len(words) + 1, np.int64)
                if one in known:
                    np.add.at(edge, known[one][0], 1)
                    np.add.at(edge, known[one][1], -1)
                if one in told:
                    data, bounds = text.text_buffer(pa.array([said]))
                    starts, ends, _ = text.split_words(data, bounds)
                    hit = np.flatnonzero(np.isin(text.windows(text.hash_spans(data, starts, ends), window), told[one][0]))
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                if one in known or one in told:
                    out = np.cumsum(edge)[: len(words)] > 0
                    words = [w for w, gone in zip(words, out.tolist()) if not gone]
                n_words.append(len(out))
                n_removed.append(int(out.sum()))
                kept.append(b" ".join(words).decode())
            yield shared.batch(schema, [rows.column("_id"), rows.column("_text"), rows.column("_rest"), kept, n_words, n_removed])

    return run


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _text, _rest, kept_text, n_words, n_removed) for every row of docs."""
    spark = shared.prepared(docs.sparkSession)
    n = shared.parts(spark)
    packed = shared.kept_aside(docs, id_col, text_col)
    sent = packed.where("_id is not null").select("_id", "_text").mapInArrow(_spread(n, window), _WIRE)
    told = shared.routed(sent, n).mapInArrow(_told(n), _WIRE).checkpoint()
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in [*_WIRE, *packed.schema]}
    both = [*_WIRE.names, *packed.columns]
    own = {"_part": shared.part_column(n), "_kind": F.lit(_ROW).alias("_kind")}
    rows = packed.select(*(own[c] if c in own else F.col(c) if c in packed.columns else nothing[c].alias(c) for c in both))
    blocks = told.select(*(F.col(c) if c in told.columns else nothing[c].alias(c) for c in both))
    out = T.StructType([*packed.schema, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return shared.routed(blocks.union(rows), n).sortWithinPartitions("_kind").mapInArrow(_cut(window, out), out)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with its text replaced by the words it keeps, joined by one space, wherever any were removed."""
    out = removed_passages(docs, id_col, text_col, window).withColumn("_text", F.expr("if(n_removed > 0, kept_text, _text)"))
    return out.select(*shared.put_back(out, docs, id_col, text_col, "n_words", "n_removed"))


def left_over(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, length_col: str | None = None) -> DataFrame:
    """docs without the rows of which nothing is left, with the columns of docs alone; length_col, where given, is set to the length of a text that was cut."""
    out = removed_passages(docs, id_col, text_col, window).where("not (n_removed > 0 and n_removed = n_words)")
    text = F.expr("if(n_removed > 0, kept_text, _text)")
    own = {id_col: F.col("_id"), text_col: text}
    if length_col:
        own[length_col] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("_rest").getField(length_col)).cast(docs.schema[length_col].dataType)
    return out.select(*(own.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns))
