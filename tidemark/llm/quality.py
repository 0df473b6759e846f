"""Quality scores from random-indexing word vectors and a small network.

Words and punctuation marks fall into a fixed number of hash buckets. Every bucket has a sparse ternary index vector; its context
vector is the sum of the index vectors of what stands within two places of it, over all documents. That table has a fixed size
whatever the corpus: tasks add up their own part, Spark sums the parts per bucket. A document is the mean and the spread of its
words' vectors. A two-layer network, trained on a bounded labelled sample, gives the logit; a temperature fitted on a part
of the sample that the training did not see turns it into a probability.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, slices

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
WINDOW = 2
#: Most labelled documents that the network learns from.
FIT_ROWS = 20_000
HIDDEN = 24
EPOCHS = 400
THRESHOLD = 0.3
#: Tokens worked on at once.
_CHUNK = 1 << 16
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Buckets(dict):
    """Token -> bucket, remembered for the frequent tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
        return b


_BUCKETS = _Buckets()


def buckets(text: str) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(_BUCKETS.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> np.ndarray:
    """Buckets x dimensions, ``NONZERO`` entries of +1 or -1 a row; one more row of zeros stands for a text's edge."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.int16)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:-1], places, rng.choice(np.array([-1, 1], np.int16), (BUCKETS, NONZERO)), axis=1)
    return out


def add_contexts(ids: np.ndarray, index: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``totals`` the index vectors of the neighbours of every token; ``BUCKETS`` in ``ids`` marks edges."""
    for start in range(0, len(ids), _CHUNK):
        low, high = max(0, start - WINDOW), min(len(ids), start + _CHUNK + WINDOW)
        own = index[ids[low:high]]
        near = np.zeros_like(own)
        for d in range(1, WINDOW + 1):
            near[d:] += own[:-d]
            near[:-d] += own[d:]
        near = near[start - low : len(near) - (high - min(len(ids), start + _CHUNK))]
        part = ids[start : start + _CHUNK]
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        which = part[order][first]
        totals[which] += np.add.reduceat(near[order].astype(np.int64), first, axis=0)
        counts[which] += np.diff(np.r_[first, len(part)])


def context_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets x dimensions sums, bucket counts) over all rows of ``docs`` (text)."""
    names = ["bucket", "n", *(f"v{i}" for i in range(DIMENSIONS))]

    def run(batches):
        index = index_vectors()
        totals, counts = np.zeros((BUCKETS + 1, DIMENSIONS), np.int64), np.zeros(BUCKETS + 1, np.int64)
        gap = np.full(WINDOW, BUCKETS)
        for part in slices(batches):
            pieces = [x for t in part.column(0).to_pylist() if t for x in (buckets(t), gap)]
            if pieces:
                add_contexts(np.concatenate(pieces), index, totals, counts)
        some = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *(pa.array(totals[some, i]) for i in range(DIMENSIONS))], names=names)

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    totals, counts = np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64)
    at = rows.column("bucket").to_numpy()
    counts[at] = rows.column("n").to_numpy()
    for i in range(DIMENSIONS):
        totals[at, i] = rows.column(f"v{i}").to_numpy()
    return totals, counts


def word_vectors(totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit context vector next to the unit index vector of every bucket."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.hstack([unit(totals / np.maximum(counts, 1)[:, None]), unit(index_vectors()[:-1].astype(np.float64))]).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text, then the logarithm of its length; zeros if it is empty."""
    width = vectors.shape[1]
    out = np.zeros((len(texts), 2 * width + 1), np.float32)
    for i, text in enumerate(texts):
        ids = buckets(text)
        if not len(ids):
            continue
        total, square = np.zeros(width), np.zeros(width)
        for start in range(0, len(ids), _CHUNK):
            v = vectors[ids[start : start + _CHUNK]]
            total += v.sum(axis=0)
            square += np.einsum("ij,ij->j", v, v)
        mean = total / len(ids)
        out[i, :width], out[i, width:-1], out[i, -1] = mean, np.sqrt(np.maximum(square / len(ids) - mean**2, 0)), np.log1p(len(ids))
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, full batches of a bounded sample; every fifth row is kept for the temperature.

    Without rows the probability is 1/2, with one class only it is that class's smoothed share.
    """
    width = x.shape[1] if x.ndim == 2 else 0
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    flat.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(y.tolist())) < 2:
        return flat
    x = x.astype(np.float64)
    check = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    if check.any() and len(set(y[~check].tolist())) < 2:
        check[:] = False
    flat.centre, flat.scale = x[~check].mean(axis=0), x[~check].std(axis=0) + 1e-3
    z, t = (x[~check] - flat.centre) / flat.scale, y[~check].astype(np.float64)
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(flat.b2)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum()]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(flat.centre, flat.scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if check.any():
        logit, t = net.logits(x[check]), y[check]
        loss = lambda s: np.logaddexp(0, np.where(t > 0, -logit, logit) / s).mean()
        net.temperature = float(min(np.geomspace(0.25, 20, 200), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text); learned from ``labels`` (doc_id, quality).

    Held-out documents are never learned from, nor labels that are null; of several labels of a document the highest counts. The
    sample is the ``fit_rows`` labelled ids with the smallest hashes. Null text is empty text and gets a score like any other.
    Repeated rows stay repeated.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs)
    vectors = word_vectors(*context_table(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where(
        "quality is not null and id is not null").where(~held_out(F.col("id")))
    sample = known.groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = {r.id: int(r.quality > 0) for r in sample.collect()}
    shared = spark.sparkContext.broadcast((vectors, rows))

    def features(batches):
        vectors, rows = shared.value
        for part in slices(batches):
            part = part.filter(pa.array([d in rows for d in part.column(0).to_pylist()], pa.bool_()))
            ids = part.column(0).to_pylist()
            x = pooled(part.column(1).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    # one row per sampled id comes back, however often its document is repeated
    fitted = docs.mapInArrow(features, "doc_id long, x array<float>").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    fitted.sort(key=lambda r: r.doc_id)
    order = np.random.default_rng(11).permutation(len(fitted))
    x = np.array([fitted[i].x for i in order], np.float32).reshape(len(order), 2 * vectors.shape[1] + 1)
    network = spark.sparkContext.broadcast(train(x, np.array([rows[fitted[i].doc_id] for i in order], np.int64)))

    def run(batches):
        for part in slices(batches):
            p = network.value.probabilities(pooled(part.column(1).to_pylist(), shared.value[0]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
