"""Hierarchical multi-length packing.

A document's ids, with one end id, go into windows of the largest size as far as they fill them; what is left is routed
to the smallest tier that holds it. Tiers are packed from the largest to the smallest: every window starts with the
longest rest of its tier, its gap takes the longest rests of shorter tiers that fit whole, and only when none fits is
one cut. So all windows but the very last are full; that one is dealt into powers of two, which need no padding.
Sequences are then dealt to step groups, the longest first to the group with the fewest tokens.

Each task packs what it reads, by chunks of bounded size, without a shuffle; the number of leftovers grows with the
number of chunks only. Sequence and group ids start with the task's partition.

Defined cases: a null or empty text is one end id; rows are packed one by one, whatever their ids; a special token's
text inside a text is that token, as the library has it by default.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import pieces, shared, text

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of a step group, and of a chunk that is packed at once.
STEP_TOKENS, CHUNK_TOKENS = 1 << 16, 1 << 22

PIECE = T.StructType([T.StructField("_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")), T.StructField("token_ids", T.BinaryType())])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the lengths of sequences."""
    out: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    top = tiers[-1]

    def tier(n: int) -> int:
        return next(t for t in tiers if n <= t)

    for d, n in enumerate(lengths):
        for k in range(n // top):
            out.append((d, k * top, top, len(sizes), 0))
            sizes.append(top)
        if n % top:
            pools[tier(n % top)].append((n % top, d, n - n % top))
    for pool in pools.values():
        pool.sort()

    def taken(gap: int) -> tuple[int, int, int] | None:
        """The longest rest of at most gap; else the beginning of the shortest."""
        for t in reversed(tiers):
            if i := bisect_right(pools[t], (gap, 1 << 62, 0)):
                return pools[t].pop(i - 1)
        for t in tiers:
            if pools[t]:
                n, d, s = pools[t].pop(0)
                insort(pools[tier(n - gap)], (n - gap, d, s + gap))
                return gap, d, s
        return None

    for t in reversed(tiers):
        while pools[t]:
            n, d, s = pools[t].pop()
            begun = len(out)
            out.append((d, s, n, len(sizes), 0))
            while n < t and (more := taken(t - n)):
                out.append((more[1], more[2], more[0], len(sizes), n))
                n += more[0]
            if n == t:
                sizes.append(t)
                continue
            last, out[begun:] = out[begun:], []  # nothing is left to fill it with
            for bit in reversed(range(n.bit_length())):
                if not n >> bit & 1:
                    continue
                at = 0
                while at < 1 << bit:
                    d, s, m, _, _ = last[0]
                    m = min(m, (1 << bit) - at)
                    out.append((d, s, m, len(sizes), at))
                    at += m
                    last[0] = (d, s + m, last[0][2] - m, 0, 0)
                    if not last[0][2]:
                        last.pop(0)
                sizes.append(1 << bit)
    return out, sizes


def step_groups(sizes: list[int], step: int = STEP_TOKENS) -> list[int]:
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, g = groups[0]
        heapq.heapreplace(groups, (held + sizes[i], g))
        out[i] = g
    return out


def _packed(path: str, end_id: int, tiers: tuple[int, ...], step: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.Encoder(path, keep_ids=True)
        base = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        n_sequences = n_groups = 0

        def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences, n_groups
            ids = [i for h in held for i in h[0]]
            tokens, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            first = np.concatenate([[0], np.cumsum(counts)])
            out, sizes = pack(counts.tolist(), tiers)
            group = np.array(step_groups(sizes, step), np.int64)
            d, s, n, q, o = np.array(out, np.int64).T
            data = tokens.astype("<u4").tobytes()
            a = 4 * (first[d] + s)
            own = [data[i:j] for i, j in zip(a.tolist(), (a + 4 * n).tolist())]
            columns = [pa.array(ids, pa.int64()).take(pa.array(d)), s, n, counts[d], base + n_sequences + q, o, np.array(sizes)[q], base + n_groups + group[q], own]
            n_sequences, n_groups = n_sequences + len(sizes), n_groups + int(group.max()) + 1
            for i in range(0, len(d), shared.BATCH_ROWS):
                yield shared.batch(PIECE, [c[i : i + shared.BATCH_ROWS] for c in columns])

        held, size = [], 0
        for b in batches:
            data, bounds = text.text_buffer(b.column(1))
            alone = pieces.texts_with(data.tobytes(), bounds, path, other_space=False)
            starts, ends, ptr = pieces.pieces(data, bounds, with_space=False)
            place = encoder.places(data, starts, ends)
            own = encoder.counts[place].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(own)])
            flat = encoder.ids[np.repeat(encoder.starts[place] - total[:-1], own) + np.arange(total[-1])]
            begin = total[ptr]
            each = [flat[i:j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]
            for i in np.flatnonzero(alone):
                each[i] = np.array(encoder.library.encode(data[bounds[i] : bounds[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint16)
            counts = np.array([len(x) + 1 for x in each], np.int64)
            end = np.array([end_id], np.uint16)
            held.append((b.column(0).to_pylist(), np.concatenate([y for x in each for y in (x, end)]) if each else end[:0], counts))
            size += int(counts.sum())
            if size >= chunk:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step: int = STEP_TOKENS, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """A row for each piece: its document, its place there and in its sequence, its step group, and its ids as little-endian unsigned 32-bit numbers."""
    shared.prepared(docs.sparkSession)
    packed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = packed.mapInArrow(_packed(path, end_id, tiers, step, chunk), PIECE)
    return out.withColumnRenamed("_id", id_col)
