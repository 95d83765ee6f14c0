"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label are compared exactly. Equal vectors are one class first. All unit vectors are turned onto the
principal axes of the whole table (its second moments are summed in Spark), which keeps their products and puts most of
them into the leading dimensions. Vectors are laid out along the first axis in cells so wide that vectors which may
link lie at most two cells apart, cells are cut into blocks by the hash of the id, and blocks meet in tiles: products
are accumulated over leading dimensions, what is left is bounded by the product of the suffix norms, and a row, column
or tile stops when none of its cosines can reach the threshold. What remains is decided by the double-precision cosine
of the original vectors.

A tile returns for each vector its number of links and its component in the tile, never its pairs, so a group of near
copies costs rows in proportion to its size.

Defined cases: a vector that is null, empty, zero or holds a null or a component that isn't finite, and one without a
label or id, links with nothing and is kept; vectors of different lengths don't link; rows that share an id are rows of
their own and count as other vectors; cosines at the threshold link; other columns are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import shared

COSINE, BLOCK = 0.93, 512
#: Leading dimensions after which a tile looks whether to go on.
STAGES = (8, 16, 32)
_SLACK = 1e-9


def axes_of(moments: np.ndarray) -> np.ndarray:
    """Columns: the principal axes, by falling variance, each with a fixed sign."""
    _, v = np.linalg.eigh(moments)
    v = v[:, ::-1]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float, stages: tuple[int, ...] = STAGES) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b, both original vectors, whose cosine reaches the threshold."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ axes, ub @ axes
    i, j = np.arange(len(a)), np.arange(len(b))
    sums = np.zeros((len(a), len(b)))
    at = 0
    for end in [*(s for s in stages if s < ra.shape[1]), ra.shape[1]]:
        sums += ra[i, at:end] @ rb[j, at:end].T
        at = end
        rest = np.sqrt((ra[i, at:] ** 2).sum(1))[:, None] * np.sqrt((rb[j, at:] ** 2).sum(1))[None, :]
        able = sums + rest >= cosine - _SLACK
        rows, cols = able.any(1), able.any(0)
        if not rows.any():
            return i[:0], j[:0]
        i, j, sums, able = i[rows], j[cols], sums[np.ix_(rows, cols)], able[np.ix_(rows, cols)]
    x, y = np.nonzero(able)
    x, y = i[x], j[y]
    exact = np.concatenate([(ua[x[k : k + 65536]] * ub[y[k : k + 65536]]).sum(1) for k in range(0, len(x), 65536)] or [np.zeros(0)])
    return x[exact >= cosine], y[exact >= cosine]


def _settled(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of their component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, x in _by_length(b.column(0)):
            u = unit(x)
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(s.ravel())], names=["d", "k", "v"])


def _by_length(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    size, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out.append((d, rows, flat[at[rows][:, None] + np.arange(d)]))
    return out


def _placed(axes: dict[int, np.ndarray], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            raw: list = [None] * len(b)
            for n, rows, x in _by_length(b.column(3)):
                d[rows] = n
                cell[rows] = np.floor((unit(x) @ axes[n][:, 0]) / width).astype(np.int64)
                for r, v in zip(rows.tolist(), x):
                    raw[r] = v.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d), pa.array(cell), pa.array(raw, pa.binary()), b.column(4)], names=["label", "rep", "m", "d", "cell", "raw", "own"])

    return run


def _block(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("rep", "ascending"), ("own", "ascending")])
    blob = lambda c: table.column(c).to_numpy().astype("<i8").tobytes()
    own = {c: table.column(c).slice(0, 1) for c in ("label", "d", "cell", "blk")}
    return pa.table({**own, "ids": pa.array([blob("rep")], pa.binary()), "owns": pa.array([blob("own")], pa.binary()), "ms": pa.array([blob("m")], pa.binary()), "x": pa.array([b"".join(table.column("raw").to_pylist())], pa.binary())})


def _tiled(axes: dict[int, np.ndarray], cosine: float):
    """(node, links, root) for the classes that have links in a tile; a node is an id and the hash of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d, same = r["d"], r["same"]
                ids, owns, ms = ([np.frombuffer(r[k], "<i8") for k in (c, c + "2")] for c in ("ids", "owns", "ms"))
                x, y = linked(np.frombuffer(r["x"], "<f8").reshape(-1, d), np.frombuffer(r["x2"], "<f8").reshape(-1, d), axes[d], cosine)
                if same:
                    x, y = x[x != y], y[x != y]
                if not len(x):
                    continue
                n = len(ids[0])
                links = np.concatenate([np.bincount(x, ms[1][y], n), np.bincount(y, ms[0][x], len(ids[1]))]).astype(np.int64)
                node, own = np.concatenate(ids), np.concatenate(owns)
                if same:
                    node, own, links = node[:n], own[:n], links[:n]
                else:
                    y = y + n
                order = np.lexsort((own, node))  # so that the smallest label is the smallest node
                place = np.empty(len(node), np.int64)
                place[order] = np.arange(len(node))
                root = order[_settled(len(node), place[x], place[y])][place]
                some = links > 0
                pair = lambda at: pa.StructArray.from_arrays([pa.array(node[at]), pa.array(own[at])], ["id", "own"])
                yield pa.RecordBatch.from_arrays([pair(some), pa.array(links[some]), pair(root[some])], names=["node", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    spark = shared.prepared(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x.cast("double"))))
    able = rows.where("v is not null")
    # a class of equal vectors is a node: its smallest id, and a hash that tells classes of one id apart
    classes = able.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("own", F.xxhash64("label", "v")).checkpoint()
    sums: dict[int, np.ndarray] = {}
    for r in classes.select("v").mapInArrow(_moments, "d long, k long, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.d, np.zeros(r.d * r.d))[r.k] = r.v
    axes = {d: axes_of(s.reshape(d, d)) for d, s in sums.items()}
    # unit vectors of cosine c are sqrt(2 - 2c) apart, and no further along an axis; twice a cell holds that
    width = max(np.sqrt(max(2 - 2 * cosine, 0.0)) / 2 + 1e-9, 1e-3)
    label_type = dict(classes.dtypes)["label"]
    placed = classes.select("label", "rep", "m", "v", "own").mapInArrow(_placed(axes, width), f"label {label_type}, rep long, m long, d long, cell long, raw binary, own long").checkpoint()
    size = placed.groupBy("label", "d", "cell").agg(F.count("*").alias("c")).checkpoint()
    keyed = shared.joined_spread(placed, size, ["label", "d", "cell"], "c").withColumn("blk", F.pmod(F.xxhash64("rep", "own"), F.ceil(F.col("c") / block)))
    blocks = keyed.repartition("label", "d", "cell", "blk").groupBy("label", "d", "cell", "blk").applyInArrow(_block, f"label {label_type}, d long, cell long, blk long, ids binary, owns binary, ms binary, x binary").checkpoint()
    keys = blocks.select("label", "d", "cell", "blk")
    ahead = keys.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("cell2", F.col("cell") + F.col("step"))
    pairs = ahead.join(keys.select("label", "d", F.col("cell").alias("cell2"), F.col("blk").alias("blk2")), ["label", "d", "cell2"]).where("step > 0 or blk2 >= blk")
    other = blocks.select("label", "d", F.col("cell").alias("cell2"), F.col("blk").alias("blk2"), F.col("ids").alias("ids2"), F.col("owns").alias("owns2"), F.col("ms").alias("ms2"), F.col("x").alias("x2"))
    tiles = pairs.join(blocks, ["label", "d", "cell", "blk"]).join(other, ["label", "d", "cell2", "blk2"]).select("d", (F.expr("step = 0 and blk = blk2")).alias("same"), "ids", "owns", "ms", "x", "ids2", "owns2", "ms2", "x2")
    found = tiles.mapInArrow(_tiled(axes, cosine), "node struct<id: long, own: long>, links long, root struct<id: long, own: long>").checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = shared.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    keyed = classes.withColumn("node", F.struct(F.col("rep").alias("id"), "own"))
    named = keyed.join(links, "node", "left").join(label, "node", "left").select("label", "own", "v", "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component.id", "rep").alias("component_id"))
    named = named.withColumnRenamed("v", "_v").checkpoint()
    # rows find their class by its hash, and are its members if the vectors are equal
    there = shared.joined_spread(able.withColumn("own", F.xxhash64("label", "v")).withColumn("label", F.col("label")), named, ["label", "own"], "m").where("v = _v")
    out = there.select("id", "n_links", "component_id").union(rows.where("v is null").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
