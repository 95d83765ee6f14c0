"""What the operators share: session settings, the shared folder, passing other columns through, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.plans.materialize import with_folder

#: Rows and bytes of an Arrow batch; long texts make batches of few rows.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, drops shuffle files when a query ends, and sets a checkpoint folder where there is none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return with_folder(spark)


def folder(spark: SparkSession) -> str:
    """The shared folder: the setting's, or the one that was made in local mode."""
    prepared(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def first_ids(counted: DataFrame, most: int) -> DataFrame:
    """Of (_id, count, ...) the first ids in the order of their hashes whose rows sum up to at most `most`; an id of more
    rows is passed over. At most `most` rows go through the driver."""
    rows = [r for r in counted.where(F.col("_id").isNotNull()).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()]
    kept, n = [], 0
    for r in rows:
        if n + r["count"] <= most:
            n += r["count"]
            kept.append(tuple(r))
    return counted.sparkSession.createDataFrame(kept, counted.schema)


#: Keys of more than a share of 1 / HEAVY of all rows are fewer than HEAVY: small enough to broadcast, whatever the size of the data.
HEAVY = 4096


def joined_spread(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row a key and in `count` its number of rows. Keys with more than a share of
    1 / HEAVY of the counted rows, at most HEAVY of them, are looked up in a broadcast, so that none of their rows move;
    what is shuffled has no key of more rows than that share. how: inner or left. Groups should be checkpointed."""
    total = groups.agg(F.sum(count).alias("n")).first()["n"] or 0
    heavy = groups.where(F.col(count) > total / HEAVY)
    more = [c for c in groups.columns if c not in keys]
    marked = heavy.select(*keys, F.struct(*more).alias("_heavy"))
    there = rows.join(F.broadcast(marked), keys, "left")
    found = there.where("_heavy is not null").select(*rows.columns, *(F.col("_heavy").getField(c).alias(c) for c in more))
    rest = there.where("_heavy is null").select(*rows.columns).join(groups.where(F.col(count) <= total / HEAVY), keys, how).select(*rows.columns, *more)
    return found.union(rest)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_aside(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _rest): all other columns in one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*rest, F.lit(0).alias("_pad")).alias("_rest"))


def put_back(df: DataFrame, like: DataFrame, id_col: str, text_col: str, *more: str) -> list:
    """The columns of like, in its order, out of (_id, _text, _rest), then more under their own names where free."""
    own = {id_col: F.col("_id"), text_col: F.col("_text")}
    cols = [own.get(c, F.col("_rest").getField(c)).alias(c) for c in like.columns]
    return [*cols, *(F.col(m) for m in more if m not in like.columns)]


def routed(df: DataFrame, n: int, key: str = "_part") -> DataFrame:
    """Rows to the partition that _part names: one exchange, no hashing, so that n keys fill n partitions evenly."""
    return df.repartitionById(n, F.col(key))


def part_of(ids: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(id), n) as Spark has it, so that rows and blocks of a document meet without a pass over the rows."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = (p5 + np.uint64(42 + 8)) ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return (h.view(np.int64) % n).astype(np.int32)


def part_column(n: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("_id"), F.lit(0).cast("long"))), F.lit(n)).cast("int").alias("_part")


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins, and the length of keys."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node that has one.

    Alternating large and small stars: first all larger neighbours of a node move to its smallest neighbour, then all
    smaller ones and the node itself. Neither step adds links, and the stars are final when a round changes nothing.
    Links stay distributed and every round is checkpointed; minima combine before they are shuffled, so a hub costs
    one row a task there, and the joins have one row for a key on one side, which lets Spark split a hub's links."""
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == seen or not now["n"]:
            break
        seen = now
        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = small.where("a < b").distinct().checkpoint()
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
