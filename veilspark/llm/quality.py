"""Quality by a weak-label model.

Overlapping heuristics vote good, bad or nothing on every document. Their votes are counted by pattern over all
documents in Spark (at most 3^heuristics patterns), and expectation-maximisation over these counts estimates how common
good documents are, how common each kind of bad ones, and how often each heuristic is right on every kind: heuristics
are taken as independent given the kind. There is a kind of bad documents for each heuristic's defect, as documents of
one defect look good to the other heuristics; the estimate starts with each vote against a document as a sign of its own
defect, and nothing is held fixed after that. The posterior of a pattern labels its documents. A hashed linear scorer is
fitted to the posteriors of a bounded sample, documents in the order of their ids' hashes while their rows sum up to at
most SAMPLE, and scores all documents, each whole.

Features of the scorer: the shapes of words (runs of lower case, capitals, digits and each sign), hashed into BUCKETS,
by the root of their share among a document's words; and the hashed steps of length, repetition and word length.

Defined cases: a null, empty or blank text has no words, gets no vote and is not kept; texts of any length are read
whole; a score at the threshold is kept; rows are judged one by one, whatever their ids, and keep all their columns but
those of the result's names; an id of more than SAMPLE rows is not learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import linear, shared, text

SAMPLE, BUCKETS, THRESHOLD, ROUNDS = 6000, 1 << 12, 0.5, 100
#: What is added to the counts that accuracies are estimated from.
PSEUDO = 0.1
SIGNS = np.zeros(256, bool)
SIGNS[[*b"#$%&*|^~<>=+_@\\{}[]"]] = True
UPPER, LETTER = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: lower case and bytes from 0x80 are alike, so are capitals and digits; signs stand for themselves
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97
HEURISTICS = ("signs", "capitals", "shouts", "columns", "repeats", "letters")


def measures(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, ptr: np.ndarray) -> dict[str, np.ndarray]:
    """Of every text."""
    def over(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])

    n = np.diff(ptr)
    some = np.maximum(n, 1)
    last = data[ends - 1] if len(ends) else data[:0]
    size = ends - starts
    before = data[np.maximum(ends - 2, starts)] if len(ends) else last
    letters = over(LETTER[data], bounds)
    hashes = text.hash_spans(data, starts, ends, fold=True)
    pairs, first = text.doc_windows(hashes, ptr, 3)
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    order = np.lexsort((pairs, doc))
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(n)) if len(pairs) else np.zeros(len(n))
    held = np.diff(first)
    alone = (size == 1) & SIGNS[last]
    return {
        "n": n, "letters": letters, "signs": over(SIGNS[last] & (size > 1), ptr) / some, "capitals": over(UPPER[data], bounds) / np.maximum(letters, 1),
        "shouts": over((last == 33) & (before == 33), ptr) / some, "columns": over(alone, ptr) / some, "repeats": np.where(held > 0, 1 - distinct / np.maximum(held, 1), 0.0),
        "length": over(np.ones(len(data), bool), bounds) / some, "letter_share": letters / np.maximum(np.diff(bounds), 1),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """1 good, 0 bad, -1 nothing; a column for each heuristic."""
    long = m["n"] >= 8
    two = lambda x, bad, good, on=True: np.where(on & (x >= bad), 0, np.where(on & (x <= good), 1, -1))
    return np.column_stack([
        two(m["signs"], 0.15, 0.02, m["n"] > 0), two(m["capitals"], 0.5, 0.15, m["letters"] >= 20), two(m["shouts"], 0.1, 0.01, m["n"] > 0),
        two(m["columns"], 0.1, 0.01, m["n"] > 0), two(m["repeats"], 0.35, 0.12, long),
        np.where(long & ((m["length"] < 2) | (m["length"] > 25) | (m["letter_share"] < 0.5)), 0, np.where(long & (m["letter_share"] > 0.7), 1, -1)),
    ]).astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The posterior that documents of each pattern are good; and by class (good ones, then a class for each heuristic's
    defect) how common it is, and how often each heuristic that votes votes good."""
    k = patterns.shape[1]
    classes = k + 1
    good, bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    if not len(patterns):
        return np.zeros(0), np.full(classes, 1 / classes), np.full((classes, k), 0.5)
    # at first whoever has a vote against it is in that heuristic's class, shared if several speak up
    q = np.column_stack([np.where(bad.any(1), 1e-3, 1.0), bad / np.maximum(bad.sum(1, keepdims=True), 1) + 1e-3])
    q /= q.sum(1, keepdims=True)
    own = np.zeros((classes, k))
    own[1:] = np.eye(k)
    for _ in range(rounds):
        w = counts[:, None] * q
        prior = (w.sum(0) + 1) / (counts.sum() + classes)
        # chance of a good vote, given that it votes; one vote's weight for what the class is, so that none is certain
        right = (w.T @ good + PSEUDO * (1 - own)) / (w.T @ (good + bad) + PSEUDO * (2 - own))
        right = np.clip(right, 1e-4, 1 - 1e-4)
        z = np.log(prior) + good @ np.log(right).T + bad @ np.log(1 - right).T
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q[:, 0], prior, right


def shape_features(data: np.ndarray, bounds: np.ndarray, m: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, ptr: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value), each pair once."""
    kind = SHAPE[data]
    keep = ~text.SPACE[data]
    new = keep.copy()
    new[1:] &= (kind[1:] != kind[:-1])
    if len(starts):
        new[starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    short = kind[new]
    h = text.hash_spans(short, at[starts], at[ends])
    n_docs = len(ptr) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(ptr))
    code, times = np.unique(doc * buckets + (h % np.uint64(buckets)).astype(np.int64), return_counts=True)
    doc, bucket = code // buckets, code % buckets
    value = np.sqrt(times / np.maximum(m["n"], 1)[doc])
    steps = [np.minimum(np.log2(m["n"] + 1), 15).astype(np.int64), (m["repeats"] * 8).astype(np.int64), np.minimum(m["length"], 30).astype(np.int64) // 3]
    more = [(text.mix((s + 100 * (k + 1)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) for k, s in enumerate(steps)]
    return np.concatenate([doc, *([np.arange(n_docs)] * 3)]), np.concatenate([bucket, *more]), np.concatenate([value, *([np.full(n_docs, 0.5)] * 3)])


def _read(column: pa.Array):
    data, bounds = text.text_buffer(column)
    starts, ends, ptr = text.split_words(data, bounds)
    return data, bounds, starts, ends, ptr


@dataclass
class Scorer:
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        data, bounds, starts, ends, ptr = _read(column)
        m = measures(data, bounds, starts, ends, ptr)
        doc, bucket, value = shape_features(data, bounds, m, starts, ends, ptr, len(self.weights))
        z = self.intercept + np.bincount(doc, self.weights[bucket] * value, len(column))
        return np.where(m["n"] > 0, linear.sigmoid(z), 0.0)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds, starts, ends, ptr = _read(b.column(0))
        v = votes(measures(data, bounds, starts, ends, ptr)).astype(np.int64) + 1
        codes, counts = np.unique(v @ (3 ** np.arange(v.shape[1])), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["pattern", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[Scorer, dict[int, float]]:
    """The scorer, and the posterior of each pattern of votes."""
    shared.prepared(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{id_col}`").cast("long").alias("_id"))
    rows = texts.select("_text").mapInArrow(_voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes = np.array([r.pattern for r in rows], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3 - 1) if len(codes) else np.zeros((0, len(HEURISTICS)))
    posterior = dict(zip(codes.tolist(), estimate(patterns, np.array([r.n for r in rows], float))[0].tolist()))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds, starts, ends, ptr = _read(b.column(0))
            m = measures(data, bounds, starts, ends, ptr)
            code = (votes(m).astype(np.int64) + 1) @ (3 ** np.arange(len(HEURISTICS)))
            doc, bucket, value = shape_features(data, bounds, m, starts, ends, ptr, buckets)
            order = np.argsort(doc, kind="stable")
            at = np.searchsorted(doc[order], np.arange(len(b) + 1))
            both = [(bucket[order[i:j]].astype(np.int64).tobytes(), value[order[i:j]].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["pattern", "buckets", "amounts"])

    ids = shared.first_ids(texts.groupBy("_id").count(), sample)
    got = texts.join(F.broadcast(ids.select("_id")), "_id", "left_semi").select("_text").mapInArrow(sampled, "pattern long, buckets binary, amounts binary").collect()
    got.sort(key=lambda r: (r.pattern, r.buckets, r.amounts))
    used = np.unique(np.concatenate([np.frombuffer(r.buckets, np.int64) for r in got])) if got else np.zeros(0, np.int64)
    x = np.zeros((len(got), len(used)), np.float32)
    for i, r in enumerate(got):
        np.add.at(x[i], np.searchsorted(used, np.frombuffer(r.buckets, np.int64)), np.frombuffer(r.amounts))
    y = np.array([posterior.get(r.pattern, 0.5) for r in got])
    w, b = linear.fit(x, y, np.ones(len(got)), ridge=1e-6, steps=1000)
    weights = np.zeros(buckets)
    weights[used] = w
    return Scorer(weights, b), posterior


def score(docs: DataFrame, scorer: Scorer, posterior: dict[int, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality (the scorer's), posterior (of its votes) and keep; these replace columns of such names."""
    more = ("quality", "posterior", "keep")
    kept = [c for c in docs.columns if c not in more]
    packed = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in kept if c != text_col), F.lit(0).alias("_pad")).alias("_rest"))
    out = T.StructType([*packed.schema, T.StructField("quality", T.DoubleType()), T.StructField("posterior", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("_text"))
            data, bounds, starts, ends, ptr = _read(column)
            code = (votes(measures(data, bounds, starts, ends, ptr)).astype(np.int64) + 1) @ (3 ** np.arange(len(HEURISTICS)))
            q = scorer.score(column)
            yield shared.batch(out, [*b.columns, q, [posterior.get(c, 0.5) for c in code.tolist()], q >= threshold])

    scored = packed.mapInArrow(run, out)
    return scored.select(*(F.col("_text").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in kept), *more)
