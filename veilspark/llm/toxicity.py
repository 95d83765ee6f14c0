"""Toxicity by a classifier chain.

Categories are predicted one after the other: the model of each is linear in the features of a text and in the log-odds
of the categories before it. While the chain is fitted, those come from models that did not see the row (folds by the
hash of the id), so later models learn how reliable earlier ones are on unseen rows. Category columns of the label table
come first, in the order given. Where the table tells positive rows only as a whole, KINDS categories are found in it:
the positive rows are grouped by the features that speak for the label (spherical k-means), so that insults of one
vocabulary, such as a language's, are one kind. The label itself ends the chain.

Features: whole words (runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased) and their beginnings of
PREFIXES bytes, which rare and unseen words share with others; each once, twice and four times or more in a text. Those
that tell most about the label (likelihood ratio, counted in Spark over the sample) enter the models, at most WORDS.

The chain is fitted on a bounded sample of labelled rows: ids in the order of their hashes while their rows sum up to at
most SAMPLE. Rows that share their SKETCH smallest feature hashes count as one, so that copies of one text don't teach
its own words. A text is toxic from the cut on at which at most FALSE_ALARMS of the sample's negative rows would be, by the
log-odds of models that did not see them, a quarter of the way to the next positive row above, and never for want of features. All documents are then scored, each whole.

Defined cases: null and empty texts, and those without words, get the intercepts and are not toxic; texts of any length are read whole;
labels that are null are left out, as are labelled ids without a document and rows without an id; of several labels for
an id the largest counts; an id of more than SAMPLE rows is not learnt from; with no labelled rows or one class all
probabilities are 0 and nothing is toxic; ties at the cut are toxic; rows are scored one by one, whatever their ids, and
keep all their columns but those of the result's names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import linear, shared, text

SAMPLE, WORDS, LEAST, FOLDS, KINDS, FALSE_ALARMS = 6000, 1024, 3, 5, 4, 0.01
#: The least likelihood ratio of a feature.
GAIN = 2.0
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
LEVELS = (1, 2, 4)
#: Smallest feature hashes that texts which count as copies have in common.
SKETCH = 8

SPLIT = np.ones(256, bool)
SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of every word and beginning of a word."""
    data, bounds = text.text_buffer(column)
    blank = np.where(SPLIT[data], np.uint8(32), text.LOWER[data])
    starts, ends, ptr = text.split_words(blank, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(ptr))
    docs, hashes = [doc], [text.hash_spans(blank, starts, ends)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        docs.append(doc[long])
        hashes.append(text.mix(text.hash_spans(blank, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def level_of(times: np.ndarray) -> np.ndarray:
    """How many of LEVELS a count reaches."""
    return np.searchsorted(np.array(LEVELS), times, "right")


@dataclass
class Chain:
    """words: ascending hashes; slots: the feature of each word and level, or -1; a model's weights: those of the features, then of the log-odds before it."""

    categories: list[str]
    words: np.ndarray
    slots: np.ndarray
    weights: list[np.ndarray]
    intercepts: list[float]
    cut: float

    def features(self, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature), each pair once."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        hit = np.flatnonzero(self.words[at] == hashes)
        pair, times = np.unique(doc[hit] * len(self.words) + at[hit], return_counts=True)
        doc, at, level = pair // len(self.words), pair % len(self.words), level_of(times)
        slots = self.slots[at]
        able = (np.arange(len(LEVELS)) < level[:, None]) & (slots >= 0)
        row, _ = np.nonzero(able)
        return doc[row], slots[able]

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        n = len(column)
        out = np.zeros((n, len(self.categories)))
        if not self.weights:
            return out
        doc, hashes = occurrences(column)
        doc, feature = self.features(doc, hashes)
        size = int(self.slots.max(initial=-1)) + 1
        odds = np.zeros((n, 0))
        for k, (w, b) in enumerate(zip(self.weights, self.intercepts)):
            z = b + np.bincount(doc, w[:size][feature], n) + odds @ w[size:]
            out[:, k] = linear.sigmoid(z)
            odds = np.column_stack([odds, np.clip(z, -6, 6)])
        return out


def kinds_of(x: np.ndarray, positive: np.ndarray, speaks: np.ndarray, kinds: int, rounds: int = 20) -> np.ndarray:
    """A kind for each positive row, else -1. x: rows by features; speaks: the weight with which a feature says positive (0: it doesn't)."""
    out = np.full(len(x), -1)
    rows = np.flatnonzero(positive)
    v = x[rows] * np.maximum(speaks, 0)
    size = np.linalg.norm(v, axis=1)
    v = v / np.where(size > 0, size, 1)[:, None]
    if not len(rows):
        return out
    centres = [v[int(np.argmax(size))]]
    for _ in range(kinds - 1):  # the row least like the centres so far
        centres.append(v[int(np.argmin(np.max(v @ np.array(centres).T, axis=1) + (size == 0)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        sums = np.array([v[own == k].sum(0) for k in range(kinds)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
        if np.allclose(new, c):
            break
        c = new
    out[rows] = np.argmax(v @ c.T, axis=1)
    return out


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray, weight: np.ndarray, folds: int = FOLDS, false_alarms: float = FALSE_ALARMS) -> tuple[list[np.ndarray], list[float], float]:
    """Weights and intercepts by category, in the chain's order, and the last one's cut as a probability."""
    masks = np.column_stack([*(weight * (fold != f) for f in range(folds)), weight])
    weights, intercepts, odds, unseen, bare = [], [], np.zeros((len(x), 0), x.dtype), np.zeros(len(x)), np.zeros(0)
    for target in labels.values():
        own = np.column_stack([x, odds])
        w, b = linear.fit(own, target, masks)
        z = own @ w + b
        unseen = z[np.arange(len(x)), fold].astype(float)
        weights.append(w[:, -1].astype(float))
        intercepts.append(float(b[-1]))
        bare = np.append(bare, b[-1] + np.clip(bare, -6, 6) @ weights[-1][x.shape[1] :])
        odds = np.column_stack([odds, np.clip(unseen, -6, 6).astype(x.dtype)])
    negative = np.sort(unseen[target == 0])[::-1]
    cut = max(negative[min(int(false_alarms * len(negative)), len(negative) - 1)], bare[-1])
    above = unseen[(target > 0) & (unseen > cut)]
    cut = cut + max((above.min() - cut) / 4 if len(above) else 0.0, 1e-3)
    return weights, intercepts, float(linear.sigmoid(cut))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, hashes = occurrences(b.column(2))
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, np.int64)
        level = level_of(np.diff(np.append(at, len(doc)))).astype(np.uint8)
        ptr = np.searchsorted(doc[at], np.arange(len(b) + 1))
        own = hashes[at]
        # copies of a text, also with a few words changed, have the same smallest hashes
        least = np.array([text.mix(own[i : min(j, i + SKETCH)]).sum(dtype=np.uint64) for i, j in zip(ptr[:-1], ptr[1:])], np.uint64)
        blobs = lambda v: pa.array([v[i:j].tobytes() for i, j in zip(ptr[:-1], ptr[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least.view(np.int64)), blobs(own), blobs(level)], names=["id", "label", "least", "hashes", "levels"])


def _tallied(weight: dict[int, float]):
    """Of every feature the weight of rows with a positive and with a negative label, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [len(v) for v in b.column(4).to_pylist()]
            level = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).astype(np.int64)
            hashes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64)
            own = np.repeat([weight[k] for k in b.column(2).to_pylist()], size)
            label = np.repeat(b.column(1).to_numpy(), size)
            known, place = np.unique(hashes, return_inverse=True)
            for k in range(len(LEVELS)):
                on = level > k
                n = np.bincount(place[on], minlength=len(known))
                pos, neg = (np.bincount(place[on], own[on] * (label[on] == y), len(known)) for y in (1, 0))
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(np.full(some.sum(), k, np.int32)), pa.array(pos[some], pa.float64()), pa.array(neg[some], pa.float64()), pa.array(n[some])], names=["word", "level", "pos", "neg", "n"])

    return run


def _reduced(words: np.ndarray, slots: np.ndarray):
    """The features of each row that a chain knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, level in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                h, level = np.frombuffer(h, np.uint64), np.frombuffer(level, np.uint8)
                at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                hit = words[at] == h if len(words) else np.zeros(len(h), bool)
                own = slots[at[hit]]  # a row for each word, a column for each level
                out.append(own[(np.arange(len(LEVELS)) < level[hit, None]) & (own >= 0)].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["id", "label", "least", "features"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", categories: Sequence[str] = (), sample: int = SAMPLE, words: int = WORDS, kinds: int = KINDS
) -> Chain:
    """The chain of the columns categories of labels, or of kinds found among the positive rows where there are none, and of label_col."""
    spark = shared.prepared(docs.sparkSession)
    names = [*(categories or [f"kind{k + 1}" for k in range(kinds)]), label_col]
    nothing = Chain(names, np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)), np.int64), [], [], 1.0)
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("_id"))
    known = known.agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("_label"), *(F.coalesce(F.max(F.col(f"`{c}`").cast("int")), F.lit(0)).alias(f"_c{k}") for k, c in enumerate(categories)))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    counted = texts.select("_id").join(F.broadcast(known), "_id").groupBy(*known.columns).count()
    chosen = {r["_id"]: r for r in shared.first_ids(counted, sample).collect()}
    if len({r["_label"] > 0 for r in chosen.values()}) < 2:
        return nothing
    ids = F.broadcast(spark.createDataFrame([(i, int(r["_label"] > 0)) for i, r in chosen.items()], "_id long, _label int"))
    sampled = texts.join(ids, "_id").select("_id", "_label", "_text").mapInArrow(_prepared, "id long, label int, least long, hashes binary, levels binary").checkpoint()
    about = sampled.groupBy("least").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()  # at most sample rows
    weight = {r.least: 1.0 / r.n for r in about}
    pos, neg = (sum(x * weight[r.least] for r in about for x in [r.p if y else r.n - r.p]) + 1.0 for y in (1, 0))
    share = pos / (pos + neg)
    tallied = sampled.mapInArrow(_tallied(weight), "word long, level int, pos double, neg double, n long").groupBy("word", "level").agg((F.sum("pos") + 0.5).alias("a"), (F.sum("neg") + 0.5).alias("c"), F.sum("n").alias("n"))
    a, c = F.col("a"), F.col("c")
    gain = F.round(a * F.log(a / ((a + c) * share)) + c * F.log(c / ((a + c) * (1 - share))), 6)
    best = tallied.where((F.col("n") >= LEAST) & (a + c >= LEAST)).select("word", "level", gain.alias("gain"), "a", "c").where(F.col("gain") > GAIN).orderBy(F.desc("gain"), "word", "level").limit(words).collect()
    hashes = np.array([r.word for r in best], np.int64).view(np.uint64)
    order = np.unique(hashes)
    slots = np.full((len(order), len(LEVELS)), -1, np.int64)
    slots[np.searchsorted(order, hashes), [r.level for r in best]] = np.arange(len(best))
    got = sampled.mapInArrow(_reduced(order, slots), "id long, label int, least long, features binary").collect()  # at most sample rows of words features
    got.sort(key=lambda r: (r.id, r.label, r.features))
    x = np.zeros((len(got), len(best)), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.features, "<i4")] = 1
    y = np.array([r.label for r in got], float)
    if categories:
        by = {c: np.array([chosen[r.id][f"_c{k}"] > 0 for r in got], float) for k, c in enumerate(categories)}
    else:
        kind = kinds_of(x, y > 0, np.array([np.log(r.a / pos) - np.log(r.c / neg) for r in best]), kinds)
        by = {f"kind{k + 1}": (kind == k).astype(float) for k in range(kinds)}
    fold = shared.part_of(np.array([r.id for r in got], np.int64), FOLDS)
    return Chain(names, order, slots, *fit_chain(x, {**by, label_col: y}, fold, np.array([weight[r.least] for r in got])))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with a column p_<category> for each and is_toxic (from threshold on, or from the chain's own cut); these replace columns of such names."""
    shared.prepared(docs.sparkSession)
    more = [f"p_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c not in (*more, "is_toxic")]
    packed = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in kept if c != text_col), F.lit(0).alias("_pad")).alias("_rest"))
    scored = _scored(packed, chain, threshold)
    return scored.select(*(F.col("_text").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in kept), *(F.get("_p", F.lit(k)).alias(m) for k, m in enumerate(more)), F.col("_toxic").alias("is_toxic"))


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns, of whatever names."""
    shared.prepared(docs.sparkSession)
    packed = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_rest"))
    return _scored(packed, chain, threshold).where("not _toxic").select(*(F.col("_rest").getField(c).alias(c) for c in docs.columns))


def _scored(packed: DataFrame, chain: Chain, threshold: float | None) -> DataFrame:
    cut = chain.cut if threshold is None else threshold
    out = T.StructType([*packed.schema, T.StructField("_p", T.ArrayType(T.DoubleType())), T.StructField("_toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.score(b.column(b.schema.get_field_index("_text")))
            flat = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
            yield shared.batch(out, [*b.columns, flat, (p[:, -1] >= cut) & bool(chain.weights)])

    return packed.mapInArrow(run, out)
