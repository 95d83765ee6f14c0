"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, its code points. On every level runs of one symbol become one, then deterministic coin
tossing colours the symbols with three colours by themselves and a few neighbours alone: a symbol's label is the lowest
bit in which it differs from its left neighbour, with that bit; four rounds leave six labels, three more steps three
colours, no two alike beside each other. Peaks of colour begin phrases of two to four symbols (up to five at a text's
start), and the hash of a phrase's symbols is its name and a symbol of the next level, up to one symbol for the whole
text. Where a phrase ends depends on the symbols around it and not on the offset, so equal substrings have the same
names inside, on every level, but for a few symbols at their ends.

The signatures of a text are the names from the second level on (7 characters and more; of a text of under `SHORT`
characters from the first on) and the name of the whole. A name that a text has again counts again, by its number. The
`SIZE` smallest of them in hexadecimal are its fingerprint. likeness() estimates from two fingerprints which share of
two texts' signatures agree (Dice), exactly if both have no more than SIZE together.

edited() lays rows in order of their ids: they are dealt by bounds from a bounded sample of ids (rows that share an id:
of id and text hash), each part is sorted, and the first row of each part is sent along to the part before it, so that
every row meets the next one and texts are shuffled once.

Defined cases: a null text counts as empty; an empty text has one signature, 0, is like empty texts (1) and like no
other (0); a text of under 4 characters is edited to itself; a text is read whole, whatever its length (a worker holds
some 25 bytes a character of one text); rows that share an id are ordered by their text, rows without an id come before all others;
a single row is its own next; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import shared
from veilspark.llm.text import mix

#: Signatures of a fingerprint, the level of the shortest phrases among them, and the length below which it is the first.
SIZE, LEVEL, SHORT = 128, 2, 64
#: Symbols that are coloured or hashed at once, and characters of texts that are parsed together.
BLOCK, TOGETHER = 1 << 20, 1 << 17
#: Rows of the sample from which bounds are taken, for each part.
SAMPLE = 32

#: How many symbols to the left and right a peak depends on: four labels and three recolourings, then a comparison.
_NEAR = 9
_PLACE = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_RUN, _WHOLE = np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)
_BITS, _REST, _NAME = np.uint64(48), np.uint64(16), np.uint64((1 << 48) - 1)
_LOWEST = np.array([((i & -i).bit_length() - 1) & 7 for i in range(256)], np.uint8)
#: The smallest colour that neither neighbour has, by (left, right) with 3 and more for none of the three.
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(4)] for a in range(4)], np.uint8)


def _tossed(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A round of coin tossing; a text's first symbol differs from nothing at its lowest bit."""
    apart = np.empty_like(label)
    apart[0] = 1
    np.bitwise_xor(label[1:], label[:-1], out=apart[1:])
    apart[first] = 1
    if label.dtype == np.uint8:
        k = _LOWEST[apart]
    else:
        one = label.dtype.type(1)
        k = np.bitwise_count((apart & (~apart + one)) - one)
    return (2 * k + ((label >> k.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def colours(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One of three colours for each symbol, neighbours of a text differ. first: where texts begin."""
    label = symbols.astype(np.uint32)  # names are hashes, so that half of their bits tell neighbours apart
    for _ in range(4):
        label = _tossed(label, first)
    for colour in (5, 4, 3):
        at = np.flatnonzero(label == colour)
        left = np.where(first[at] | (at == 0), 3, label[at - 1])
        after = np.minimum(at + 1, len(label) - 1)
        right = np.where((after == at) | first[after], 3, label[after])
        label[at] = _FREE[np.minimum(left, 3), np.minimum(right, 3)]
    return label


def _peaks(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    colour = colours(symbols, first).astype(np.int8)
    left, right = np.empty_like(colour), np.empty_like(colour)
    left[0], left[1:] = -1, colour[:-1]
    right[-1], right[:-1] = -1, colour[1:]
    left[first] = -1
    right[:-1][first[1:]] = -1
    return (colour > left) & (colour > right)


def phrases(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: at texts' starts and at peaks that are not a text's second symbol."""
    n = len(symbols)
    starts = first.copy()
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        lo, hi = max(0, a - _NEAR), min(n, b + _NEAR)
        peak = _peaks(symbols[lo:hi], first[lo:hi])[a - lo : b - lo]
        peak[1:] &= ~first[a : b - 1]
        if a:
            peak[0] &= not first[a - 1]
        starts[a:b] |= peak
    return np.flatnonzero(starts)


def _named(symbols: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    stops = np.append(starts[1:], len(symbols))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + BLOCK, "right")))
        a, b = int(starts[i]), int(stops[j - 1])
        place = np.arange(a, b) - np.repeat(starts[i:j], stops[i:j] - starts[i:j])
        sums = np.add.reduceat(mix(symbols[a:b] ^ _PLACE[place]), starts[i:j] - a)
        out[i:j] = mix(sums + np.uint64(level))
        i = j
    return out


def _collapsed(symbols: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol as one symbol, named by what repeats and how often."""
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[ptr[:-1]] = True
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(symbols)))
    out = symbols[starts]
    long = np.flatnonzero(length > 1)
    out[long] = mix(out[long] * _RUN + length[long].astype(np.uint64))
    return out, np.searchsorted(starts, ptr)


def names(texts: list[str], level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """(text, name): the signatures of fewer than 65536 texts, each text's ascending, in 48 bits."""
    size = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    own = np.flatnonzero(size)
    ptr = np.concatenate([[0], np.cumsum(size[own])])
    # a text without symbols has the one signature 0
    found = [(np.flatnonzero(size == 0), np.zeros(int((size == 0).sum()), np.uint64))]
    k = 0
    while len(own):
        symbols, ptr = _collapsed(symbols, ptr)
        many = np.diff(ptr) > 1
        if not many.all():
            found.append((own[~many], mix(symbols[ptr[:-1][~many]] ^ _WHOLE)))
            symbols = symbols[np.repeat(many, np.diff(ptr))]
            own, ptr = own[many], np.concatenate([[0], np.cumsum(np.diff(ptr)[many])])
        if not len(own):
            break
        first = np.zeros(len(symbols), bool)
        first[ptr[:-1]] = True
        starts = phrases(symbols, first)
        k += 1
        symbols, ptr = _named(symbols, starts, k), np.searchsorted(starts, ptr)
        text = np.repeat(own, np.diff(ptr))
        if k >= level:
            found.append((text, symbols))
        elif (some := size[text] < SHORT).any():
            found.append((text[some], symbols[some]))
    text, name = (np.concatenate(x) for x in zip(*found))
    top = text.astype(np.uint64) << _BITS
    both = np.sort(top | (name >> _REST))
    again = np.flatnonzero(both[1:] == both[:-1]) + 1
    if len(again):
        # the k-th of equal names is told from the first by k
        first = np.arange(len(both))
        first[again] = 0
        k = again - np.maximum.accumulate(first)[again]
        both[again] = (both[again] & ~_NAME) | (mix((both[again] & _NAME) + k.astype(np.uint64) * _RUN) >> _REST)
        both.sort()
    return (both >> _BITS).astype(np.int64), both & _NAME


def fingerprints_of(texts: list[str], size: int = SIZE, level: int = LEVEL) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(texts):
        j, total = i + 1, len(texts[i])
        while j < min(len(texts), i + 65535) and total + len(texts[j]) <= TOGETHER:
            total += len(texts[j])
            j += 1
        text, name = names(texts[i:j], level)
        bounds = np.searchsorted(text, np.arange(j - i + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x = name[a : min(b, a + size)].astype(">u8").tobytes().hex()
            out.append(",".join([x[p : p + 12] for p in range(4, len(x), 16)]))
        i = j
    return out


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Of two fingerprints: twice the shared signatures over those of both, estimated from the smallest of the union."""
    x, y = F.split(a, ","), F.split(b, ",")
    least = F.slice(F.sort_array(F.array_union(x, y)), 1, size)
    both = F.size(F.array_intersect(least, F.array_intersect(x, y))) / F.size(least)
    return F.when(a == b, F.lit(1.0)).otherwise(2 * both / (1 + both))


def _fingerprinted(size: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(texts, size, level), pa.string())], names=["id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, level: int = LEVEL) -> DataFrame:
    """(id, fingerprint) of every row, for likeness(); one narrow pass."""
    shared.prepared(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprinted(size, level), "id long, fingerprint string").withColumnRenamed("id", id_col)


_FIRST = np.iinfo(np.int64).min


def _part(ids: np.ndarray, h: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """For each (id, hash) how many bounds it reaches."""
    by_id, by_hash = np.array([x for x, _ in bounds], np.int64), np.array([x for _, x in bounds], np.int64)
    lo, hi = np.searchsorted(by_id, ids, "left"), np.searchsorted(by_id, ids, "right")
    out = lo.copy()
    tied = np.flatnonzero(lo != hi)
    for a, b in set(zip(lo[tied].tolist(), hi[tied].tolist())):
        at = tied[(lo[tied] == a) & (hi[tied] == b)]
        out[at] = a + np.searchsorted(by_hash[a:b], h[at], "right")
    return out.astype(np.int32)


def _key(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).fill_null(int(_FIRST)).to_numpy(zero_copy_only=False)
    return ids, batch.column(1).to_numpy(zero_copy_only=False)


def _least(bounds: list[tuple[int, int]]):
    """The smallest key of each part that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for b in batches:
            ids, h = _key(b)
            part = _part(ids, h, bounds)
            order = np.lexsort((h, ids, part))
            for at in order[shared.runs(part[order])[:-1]].tolist():
                k = (int(ids[at]), int(h[at]))
                least[int(part[at])] = min(k, least.get(int(part[at]), k))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([k[0] for k in least.values()], pa.int64()), pa.array([k[1] for k in least.values()], pa.int64())], names=["part", "id", "h"])

    return run


def _dealt(bounds: list[tuple[int, int]], guests: dict[tuple[int, int], int]):
    """Rows with their part; the first rows of parts a second time, as guests of the part before."""
    ids_of = np.array(sorted({i for i, _ in guests}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h = _key(b)
            part = _part(ids, h, bounds)
            again = [(k, guests[x]) for k in np.flatnonzero(np.isin(ids, ids_of)).tolist() if (x := (int(ids[k]), int(h[k]))) in guests]
            at = pa.array([*range(len(ids)), *(k for k, _ in again)], pa.int64())
            to = np.concatenate([part, np.array([p for _, p in again], np.int32)]).astype(np.int32)
            guest = np.arange(len(to)) >= len(ids)
            rows = b.take(at)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), *rows.columns], names=["_part", "guest", "id", "h", "text"])

    return run


def _edited(size: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []  # the row before, which waits for its next: id, text, fingerprint
        for b in batches:
            guest = b.column(1).to_pylist()
            own = guest.index(True) if True in guest else len(guest)
            stop = min(len(guest), own + 1)  # the first guest is the next of the last row
            rows = list(zip(b.column(2)[:stop].to_pylist(), (t or "" for t in b.column(4)[:stop].to_pylist())))
            if own < len(guest) and not last and not own:
                continue  # guests beyond the first
            prints = fingerprints_of([t for _, t in rows], size, level)
            rows = last + [(i, t, f) for (i, t), f in zip(rows, prints)]
            pairs = list(zip(rows[:-1], rows[1:]))
            last = [] if own < len(guest) else rows[-1:]
            edited = []
            for (_, text, _), (_, following, _) in pairs:
                gone = len(text) // 4
                edited.append(text[: len(text) - gone] + following[:gone])
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x, _ in pairs], pa.int64()), pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array([x[2] for x, _ in pairs], pa.string()),
                pa.array(fingerprints_of(edited, size, level), pa.string()), pa.array([y[2] for _, y in pairs], pa.string()),
            ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    return run


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, level: int = LEVEL) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint): each row beside itself with its
    last quarter replaced by the beginning of the next, and beside the next."""
    spark = shared.prepared(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys, n = rows.select("id", "h"), shared.parts(spark)
    sample = sorted((_FIRST if r.id is None else r.id, r.h) for r in keys.orderBy(F.xxhash64("id", "h")).limit(SAMPLE * n).collect())
    bounds = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
    least = {r.part: (r.k.id, r.k.h) for r in keys.mapInArrow(_least(bounds), "part int, id long, h long").groupBy("part").agg(F.min(F.struct("id", "h")).alias("k")).collect()}
    filled = sorted(least)
    guests = {least[p]: before for p, before in zip(filled, filled[-1:] + filled[:-1])}
    dealt = rows.mapInArrow(_dealt(bounds, guests), "_part int, guest boolean, id long, h long, text string")
    laid = shared.routed(dealt, n).sortWithinPartitions("guest", F.col("id").asc_nulls_first(), "h", "text")
    out = laid.mapInArrow(_edited(size, level), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return out.withColumnRenamed("id", id_col)
