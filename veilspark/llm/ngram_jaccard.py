"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct shingles. They are ordered by document frequency, so that a prefix holds a
document's rarest; two documents of overlap o share a token within their first n - o + 1. Tokens of few documents are
indexed alone. Frequent ones fall by their hash into classes, a prefix is extended until its classes hold enough of
them, and only pairs of one class are indexed: to share no signature, two documents would have to differ in more tokens
than the threshold lets them. The number of classes follows the size of a set by powers of two; a document emits the
signatures of every power that a partner's size may have.

1. Shingle hashes go in compressed blocks to the partition of their bits, which knows their frequencies; each document
   gets back those of two documents or more, the only ones that can match, and falls out if they can't reach the
   threshold. A chunk that sees a hash in HOT documents or more tells its own documents itself and sends one entry.
2. Equal sets are one class from here on; one copy stands for all.
3. Every document is verified against the most central pivot of its signatures, and what is linked gets one component.
   Only members of a signature that are in another component than most of its members are then verified against those
   and one another, in tiles, so that no link between components is lost and pairs within a linked group are not made.

Defined cases: null, empty or blank texts have an empty set and link with nothing, not even with one another; fewer
words than a shingle make one shingle; rows that share an id are one document with the union of their sets; rows
without an id are left out. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import shared, text
from veilspark.llm.shared import runs

SHINGLE, PERCENT = 5, 75
#: Documents of a chunk from which a token is told to them at once; documents up to which a token is rare.
HOT, RARE = 32, 8
#: Documents of a tile's side, and tokens that a tile's matrices hold at once.
BLOCK, _COLUMNS = 128, 1 << 14
_EVERYWHERE = np.int32(2**31 - 1)

_WIRE = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_kind", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("_ids", "_a", "_b", "_c"))])
#: Blocks: tokens with a document; tokens that are hot somewhere; frequencies by document; size and fingerprint of sets.
_TOKENS, _HOTTEST, _TOLD, _SETS = range(4)
_SET = T.StructType([T.StructField("_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("rare", T.IntegerType()), T.StructField("central", T.DoubleType()), T.StructField("tokens", T.ArrayType(T.LongType()))])


def _blocks(part: np.ndarray, kind: int, *columns: np.ndarray, delta: int = -1) -> pa.RecordBatch:
    at = runs(part)
    each = list(zip(at[:-1], at[1:]))
    made = [[text.packed(c[i:j], k == delta) for i, j in each] for k, c in enumerate(columns)]
    return shared.batch(_WIRE, [[int(part[i]) for i, _ in each], [kind] * len(each), *made, *([[None] * len(each)] * (4 - len(made)))])


def shingles(words: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, place of its document), each once, by token and place."""
    found, first = text.doc_windows(words, ptr, k)
    doc = np.repeat(np.arange(len(ptr) - 1, dtype=np.int32), np.diff(first))
    size = np.diff(ptr)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        own = np.array([text.windows(words[ptr[i] : ptr[i + 1]], int(size[i]))[0] for i in short], np.uint64)
        found = np.concatenate([found, text.mix(own + size[short].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))])
        doc = np.concatenate([doc, short.astype(np.int32)])
    order = np.argsort(doc, kind="stable") if len(short) else np.arange(len(doc))
    found, doc = found[order], doc[order]
    order = np.argsort(found, kind="stable")
    found, doc = found[order], doc[order]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])])
        found, doc = found[new], doc[new]
    return found, doc


def _spread(n: int, k: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([h[0] for h in held])
        ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
        found, doc = shingles(np.concatenate([h[1] for h in held]), ptr, k)
        sizes = np.bincount(doc, minlength=len(ids)).astype(np.int64)
        f0, f1 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        by = np.argsort(doc, kind="stable")
        at = runs(doc[by])
        if len(found):
            who = doc[by][at[:-1]]
            f0[who] = np.add.reduceat(found[by], at[:-1])
            f1[who] = np.add.reduceat(text.mix(found[by] + np.uint64(0x632BE59BD9B4E019)), at[:-1])
        part = shared.part_of(ids, n)
        s = np.argsort(part, kind="stable")
        yield _blocks(part[s], _SETS, ids[s], sizes[s], f0[s], f1[s])
        at = runs(found)
        hot = np.repeat(np.diff(at) >= HOT, np.diff(at))
        if hot.any():
            part = shared.part_of(ids[doc[hot]], n)
            s = np.argsort(part, kind="stable")
            yield _blocks(part[s], _TOLD, ids[doc[hot]][s], found[hot][s], np.full(len(s), _EVERYWHERE))
            keys = found[at[:-1]][np.diff(at) >= HOT]
            part = (keys % np.uint64(n)).astype(np.int32)
            s = np.argsort(part, kind="stable")
            yield _blocks(part[s], _HOTTEST, np.zeros(len(s), np.int64), keys[s])
            found, doc = found[~hot], doc[~hot]
        if len(found):
            part = (found % np.uint64(n)).astype(np.int32)
            s = np.argsort(part, kind="stable")
            yield _blocks(part[s], _TOKENS, ids[doc[s]], found[s], delta=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data, bounds = text.text_buffer(b.column(1))
            starts, ends, ptr = text.split_words(data, bounds)
            held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), text.hash_spans(data, starts, ends, fold=True), ptr))
            size += len(starts) + len(bounds)
            if size >= text.CHUNK_WORDS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _frequencies(n: int):
    """In the partition of some tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, tokens, hottest = [], [], []
        for b in batches:
            kind = b.column(1).to_numpy()
            for i in np.flatnonzero(kind == _TOKENS):
                who.append(text.unpacked(b.column(2)[i].as_py(), np.int64))
                tokens.append(text.unpacked(b.column(3)[i].as_py(), np.uint64, True))
            for i in np.flatnonzero(kind == _HOTTEST):
                hottest.append(text.unpacked(b.column(3)[i].as_py(), np.uint64))
            if (kind >= _TOLD).any():
                yield b.filter(pa.array(kind >= _TOLD))
        if not tokens:
            return
        t, w = np.concatenate(tokens), np.concatenate(who)
        del tokens, who
        order = np.argsort(t, kind="stable")
        t, w = t[order], w[order]
        at = runs(t)
        df = np.diff(at).astype(np.int32)
        if hottest:
            df[np.isin(t[at[:-1]], np.concatenate(hottest))] = _EVERYWHERE
        df = np.repeat(df, np.diff(at))
        many = df >= 2
        t, w, df = t[many], w[many], df[many]
        if len(t):
            part = shared.part_of(w, n)
            s = np.argsort(part, kind="stable")
            yield _blocks(part[s], _TOLD, w[s], t[s], df[s])

    return run


def _sets(percent: int):
    """In the partition of some documents: a row for each, with the tokens that may match, by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, sets = ([], [], []), ([], [], [], [])
        for b in batches:
            kind = b.column(1).to_numpy()
            for wanted, to, types in ((_TOLD, told, (np.int64, np.uint64, np.int32)), (_SETS, sets, (np.int64, np.int64, np.uint64, np.uint64))):
                for i in np.flatnonzero(kind == wanted):
                    for k, (x, t) in enumerate(zip(to, types)):
                        x.append(text.unpacked(b.column(2 + k)[i].as_py(), t))
        if not sets[0]:
            return
        ids, n, f0, f1 = (np.concatenate(x) for x in sets)
        order = np.argsort(ids, kind="stable")
        at = runs(ids[order])[:-1]
        ids, n, f0, f1 = ids[order][at], np.add.reduceat(n[order], at), np.add.reduceat(f0[order], at), np.add.reduceat(f1[order], at)
        w, t, df = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(told, (np.int64, np.uint64, np.int32)))
        order = np.lexsort((t, w))
        w, t, df = w[order], t[order], df[order]
        place = np.searchsorted(ids, w)
        if len(w):
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])])
            np.subtract.at(n, place[~new], 1)  # what two rows of one id have in common
            np.subtract.at(f0, place[~new], t[~new])
            np.subtract.at(f1, place[~new], text.mix(t[~new] + np.uint64(0x632BE59BD9B4E019)))
            w, t, df, place = w[new], t[new], df[new], place[new]
        held = np.bincount(place, minlength=len(ids)).astype(np.int64)
        able = (held > 0) & (100 * held >= percent * n)
        keep = able[place]
        t, df, place = t[keep], df[keep], place[keep]
        order = np.lexsort((t, df, place))
        t, df, place = t[order], df[order], place[order]
        rare = np.bincount(place[df <= RARE], minlength=len(ids)).astype(np.int32)
        central = np.bincount(place, np.log2(np.minimum(df, 4096)), len(ids)) / np.maximum(n, 1)
        offsets = np.concatenate([[0], np.cumsum(np.where(able, held, 0))]).astype(np.int32)
        for i in range(0, len(ids), shared.BATCH_ROWS):
            j = min(len(ids), i + shared.BATCH_ROWS)
            a, z = int(offsets[i]), int(offsets[j])
            lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[i:j] - a, z - a).astype(np.int32), mask=np.append(~able[i:j], False)), pa.array(t[a:z].view(np.int64)))
            yield shared.batch(_SET, [ids[i:j], n[i:j], f0[i:j].view(np.int64), f1[i:j].view(np.int64), rare[i:j], central[i:j], lists.cast(pa.list_(pa.int64()))])

    return run


def signatures(n: int, rare: int, tokens: np.ndarray, percent: int) -> np.ndarray:
    """Of a set of n tokens of which those given, by frequency, may match."""
    need = -(-percent * n // 100)
    prefix = len(tokens) - need + 1
    single = text.mix(tokens[: min(prefix, rare)] ^ np.uint64(0x8CB92BA72F3D8DD7))
    if rare >= prefix:
        return single
    out = [single]
    frequent = tokens[rare:]
    least, most = need, 100 * n // percent
    for level in range(int(least).bit_length(), int(most).bit_length() + 1):
        if level < 4:  # sizes under 8
            out.append(text.mix((frequent[: prefix - rare] ^ np.uint64(0x8CB92BA72F3D8DD7)) + np.uint64(level)))
            continue
        kind = (frequent >> np.uint64(40)) & np.uint64((1 << (level - 3)) - 1)
        again = np.ones(len(kind), bool)
        again[np.unique(kind, return_index=True)[1]] = False
        end = int(np.searchsorted(np.cumsum(again), prefix - rare)) + 1
        order = np.argsort(kind[:end], kind="stable")
        token, kind = frequent[:end][order], kind[:end][order]
        step = 1
        while True:
            same = np.flatnonzero(kind[step:] == kind[:-step]) if step < len(kind) else ()
            if not len(same):
                break
            a, b = token[same], token[same + step]
            out.append(text.mix(a * np.uint64(0xC6A4A7935BD1E995) + text.mix(b + np.uint64(level))))
            step += 1
    return np.unique(np.concatenate(out))


def _signed(percent: int):
    """(signature, id, n, own, central) for documents; own: how many of the n tokens no other document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, rare, central = (b.column(i).to_numpy() for i in range(4))
            lists = b.column(4)
            flat, held = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            at = np.concatenate([[0], np.cumsum(held)])
            each = [signatures(int(n[i]), int(rare[i]), flat[at[i] : at[i + 1]], percent) for i in range(len(ids))]
            times = np.array([len(x) for x in each])
            if not times.sum():
                continue
            columns = [np.concatenate(each).view(np.int64), *(np.repeat(x, times) for x in (ids, n, n - held, central))]
            for i in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in columns], names=["sig", "id", "n", "own", "central"])

    return run


def _able(percent: int, n: str = "n", own: str = "own", m: str = "nx", other: str = "ownx") -> str:
    """SQL: whether sets of n and m tokens may link. What either alone has is in the union and not in the intersection,
    so that of at most c common tokens c / (c + own + other) has to reach the threshold."""
    common = f"least({n} - {own}, {m} - {other})"
    return f"100 * {common} >= {percent} * ({common} + {own} + {other}) and 100 * {common} >= {percent} * greatest({n}, {m})"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    one = sets.select(F.col("_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def _tile(percent: int):
    """Links between a block of outsiders and a block of documents of other components, one for each component."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, n, own, part = (table.column(c).to_numpy() for c in ("side", "id", "n", "own", "component"))
        lists = table.column("tokens").combine_chunks()
        flat, held = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(ids)), held)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[int, int]] = []
        if len(x) and len(y):
            most = np.minimum((n - own)[x][:, None], (n - own)[y][None, :])
            able = (100 * most >= percent * (most + own[x][:, None] + own[y][None, :])) & (part[x][:, None] != part[y][None, :])
            x, y = x[able.any(1)], y[able.any(0)]
        if len(x) and len(y):
            place = np.full(len(ids), -1)
            place[x], place[y] = np.arange(len(x)), np.arange(len(y))
            keep = place[row] >= 0
            flat, row = flat[keep], row[keep]
            vocabulary, code = np.unique(flat, return_inverse=True)
            first = side[row] == 0
            common = np.zeros((len(x), len(y)), np.float32)
            order = np.argsort(code, kind="stable")
            code, row, first = code[order], row[order], first[order]
            for c in range(0, len(vocabulary), _COLUMNS):
                i, j = np.searchsorted(code, [c, c + _COLUMNS])
                left, right = np.zeros((len(x), _COLUMNS), np.float32), np.zeros((len(y), _COLUMNS), np.float32)
                f = first[i:j]
                left[place[row[i:j][f]], code[i:j][f] - c] = 1
                right[place[row[i:j][~f]], code[i:j][~f] - c] = 1
                common += left @ right.T
            whole = n[x][:, None] + n[y][None, :] - common
            hits = np.argwhere((100 * common >= percent * whole) & (part[x][:, None] != part[y][None, :]))
            seen = set()
            for i, j in hits.tolist():
                if (key := (i, part[y[j]])) not in seen:
                    seen.add(key)
                    found.append((int(ids[x[i]]), int(ids[y[j]])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _across(signed: DataFrame, reps: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components. Of the members of a signature, those outside its most common component are
    compared with that component and with one another, in tiles of BLOCK x BLOCK documents whose token sets meet as
    matrices: every pair of one signature and two components is in some tile, rows are made for blocks and not for pairs."""
    named = signed.select("sig", "id").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = named.groupBy("sig", "component").agg(F.count("*").alias("c"))
    mixed = each.groupBy("sig").agg(F.max_by("component", F.struct("c", "component")).alias("home"), F.count("*").alias("kinds")).where("kinds > 1")
    outside = named.join(mixed.select("sig", "home"), "sig").where("component != home").select("home", "id").distinct().checkpoint()
    sets = reps.selectExpr("_id as id", "n", "n - size(tokens) as own", "tokens").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    homes = outside.groupBy("home").agg(F.count("*").alias("s"))
    inside = sets.select("id", "component").join(homes.select(F.col("home").alias("component")), "component", "left_semi").select(F.col("component").alias("home"), "id")
    everyone = inside.union(outside)
    sizes = everyone.groupBy("home").agg(F.count("*").alias("g")).join(homes, "home").selectExpr("home", f"ceil(s / {BLOCK}) as rows", f"ceil(g / {BLOCK}) as cols")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = outside.join(sizes, "home").select("home", "id", F.lit(0).alias("side"), block("rows").alias("i"), F.explode(F.expr("sequence(0, cast(cols as int) - 1)")).alias("j"))
    right = everyone.join(sizes, "home").select("home", "id", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, cast(rows as int) - 1)")).alias("i"), block("cols").alias("j"))
    tiles = left.union(right.select(*left.columns)).join(sets, "id")
    return tiles.groupBy("home", "i", "j").applyInArrow(_tile(percent), "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each id."""
    spark = shared.prepared(docs.sparkSession)
    n = shared.parts(spark)
    packed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    sent = packed.where("_id is not null").mapInArrow(_spread(n, k), _WIRE)
    told = shared.routed(sent, n).mapInArrow(_frequencies(n), _WIRE)
    sets = shared.routed(told, n).mapInArrow(_sets(percent), _SET).checkpoint()
    able = sets.where("tokens is not null")
    copies = able.groupBy("n", "f0", "f1").agg(F.min("_id").alias("rep"), F.count("*").alias("c")).checkpoint()
    reps = able.join(copies.select(F.col("rep").alias("_id")), "_id", "left_semi").select("_id", "n", "rare", "central", "tokens").checkpoint()
    signed = reps.mapInArrow(_signed(percent), "sig long, id long, n long, own long, central double")
    # the pivot of a signature is its most central document, which copies that differ in different places still link to
    place = F.struct("central", (-F.col("id")).alias("less"), F.col("n").alias("nx"), F.col("own").alias("ownx"))
    pivots = signed.groupBy("sig").agg(F.max(place).alias("p"), F.count("*").alias("c")).where("c > 1").select("sig", "p")
    tried = signed.join(pivots, "sig").selectExpr("id as b", "n", "own", "p", "-p.less as a", "p.nx", "p.ownx").where(f"a != b and {_able(percent)}")
    first = tried.groupBy("b").agg(F.max("p").alias("p")).selectExpr("b", "-p.less as a")
    links = _verified(first, reps, percent).checkpoint()
    label = shared.components(links)
    more = _across(signed, reps, label, percent).checkpoint()
    if not more.isEmpty():
        label = shared.components(links.union(more))
    copies = shared.joined_spread(able.select("_id", "n", "f0", "f1"), copies.where("c > 1"), ["n", "f0", "f1"], "c").select("_id", "rep")
    own = sets.select("_id", "n").join(copies, "_id", "left").withColumn("rep", F.coalesce("rep", "_id"))
    out = own.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without those that are not the smallest id of their component; rows without an id stay."""
    found = grouped(docs, id_col, text_col, k, percent)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
