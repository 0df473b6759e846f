"""Toxicity by compression distance.

Two zstandard dictionaries are learned from labelled text: one of ordinary words, one of the words that toxic documents hold far
more often. A window is a word with the blanks around it, behind a fixed carrier that both dictionaries hold too: the carrier
makes every window long enough to be compressed at all, so lengths differ by what the word itself costs. Each window is compressed
with the ordinary dictionary and with the ordinary and the toxic one together; the bytes that the toxic one saves are the window's
margin. A document counts its different windows from a margin on. That threshold, the size of the toxic dictionary and the
logistic curve that turns counts into a probability are calibrated on labelled documents the dictionaries were not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, slices
from tidemark.session import cut_lineage

#: Most labelled documents that are learned from; every fourth different text of them calibrates.
FIT_ROWS = 20_000
CALIBRATION = 4
#: Bounds of the dictionaries: words taken from the labelled sample, and bytes. Several sizes of the toxic one are tried.
ORDINARY_WORDS, TOXIC_WORDS = 20_000, 2_000
ORDINARY_BYTES, TOXIC_BYTES = 1 << 17, (512, 1024, 2048, 4096)
#: How many times more often toxic documents must hold a word, and how many of them.
LIFT, LEAST_DOCUMENTS = 4.0, 2
MARGINS = (1, 2, 3, 4, 5)
THRESHOLD = 0.5
LEVEL = 19
CARRIER = b"0123456789 abcdefghijklmnopqrstuvwxyz "
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Longer words are compressed in parts, and so many words are remembered by a task.
_LONGEST, _REMEMBERED = 256, 500_000


def windows(text: str) -> set[bytes]:
    """The different words of a text, lower-cased; a very long one in parts."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        b = w.encode("utf-8", "replace")
        out.update(b[i : i + _LONGEST] for i in range(0, len(b), _LONGEST))
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Dictionaries:
    """An ordinary dictionary and toxic ones of several sizes; compressors are built where they are used."""

    ordinary: bytes
    toxic: list[bytes]
    _built: list = field(default_factory=list, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_built": [], "_known": {}}

    def margins(self, words: set[bytes]) -> np.ndarray:
        """Words x toxic dictionaries: bytes that each of these saves."""
        if not self._built:
            # the toxic part goes first: places in the ordinary one then cost the same with and without it
            self._built = [_compressor(t + self.ordinary + CARRIER) for t in (b"", *self.toxic)]
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        for w in words:
            if w not in self._known:
                n = [len(c.compress(CARRIER + w + b" ")) for c in self._built]
                self._known[w] = [n[0] - x for x in n[1:]]
        return np.array([self._known[w] for w in words], np.int64).reshape(len(words), len(self.toxic))

    def counts(self, text: str) -> list[int]:
        """How many windows the text has, then for every toxic dictionary and margin how many reach it."""
        words = windows(text)
        m = self.margins(words)
        return [len(words), *(int((m[:, k] >= x).sum()) for k in range(len(self.toxic)) for x in MARGINS)]


def learn(ordinary: list[bytes], toxic: list[bytes]) -> Dictionaries:
    """Dictionaries from words in order of falling importance: the most important ones stand last, as close as can be."""
    text = lambda words, size: b" " + b" ".join(words[::-1])[-size:] + b" "
    return Dictionaries(text(ordinary, ORDINARY_BYTES), [text(toxic, size) for size in TOXIC_BYTES])


@dataclass
class Curve:
    """Logistic curve over (number of toxic windows, whether there is one, number of windows)."""

    size: int = 0
    margin: int = 1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    @staticmethod
    def design(windows: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(hits)), np.log1p(hits), hits > 0, np.log1p(windows) * (hits > 0)])

    def probabilities(self, windows: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(windows, hits) @ self.weights, -30, 30)))


def flat(ordinary: int, toxic: int) -> Curve:
    """The smoothed share of toxic documents, whatever a text holds."""
    return Curve(weights=np.array([math.log((toxic + 1) / (ordinary + 1)), 0.0, 0.0, 0.0]))


def calibrate(counts: np.ndarray, y: np.ndarray) -> Curve:
    """The size and margin whose logistic fit has the least log loss on rows (windows, hits by size and margin).

    Without rows the probability is 1/2, with one class only it is that class's smoothed share.
    """
    best = flat(int(len(y) - y.sum()), int(y.sum()))
    if len(set(y.tolist())) < 2:
        return best
    least = math.inf
    for k in range(len(TOXIC_BYTES)):
        for j, margin in enumerate(MARGINS):
            hits = counts[:, 1 + k * len(MARGINS) + j]
            x = Curve.design(counts[:, 0], hits)
            w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 0.1, 0.1, 0.1])
            w[0] = best.weights[0]
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
                w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            curve = Curve(k, margin, w)
            p = np.clip(curve.probabilities(counts[:, 0], hits), 1e-9, 1 - 1e-9)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if loss < least - 1e-12:
                best, least = curve, loss
    return best


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Dictionaries, Curve]:
    """Dictionaries and curve from the labelled documents that are not held out (``docs``: doc_id, text; ``labels``: doc_id, toxic).

    Of several labels of a document the highest counts, of equal texts too. The sample are the ``fit_rows`` labelled ids with the
    smallest hashes. Words are counted by Spark, once per document; only the bounded lists of words and one row of counts per calibrating text reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        "toxic is not null and id is not null").where(~held_out(F.col("id")))
    # at most fit_rows rows
    sample = known.groupBy("id").agg(F.max(F.least("toxic", F.lit(1))).alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    texts = cut_lineage(texts.withColumn("calibrates", F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0))
    sizes = {(r.toxic, r.calibrates): r["count"] for r in texts.groupBy("toxic", "calibrates").count().collect()}
    if not (sizes.get((0, False)) and sizes.get((1, False))):
        return learn([], []), flat(*(sum(n for (t, _), n in sizes.items() if t == k) for k in (0, 1)))

    def word_counts(batches):
        ordinary, toxic = Counter(), Counter()
        for part in slices(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                (toxic if label else ordinary).update(windows(text))
        words = list(ordinary.keys() | toxic.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([ordinary[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())],
                                         names=["word", "n0", "n1"])

    counted = cut_lineage(texts.where("not calibrates").select("text", "toxic").mapInArrow(word_counts, "word binary, n0 long, n1 long").groupBy("word").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    share = [F.lit(1.0 / sizes[k, False]) for k in (0, 1)]
    lift = (F.col("n1") * share[1]) / ((F.col("n0") + 0.5) * share[0])
    ordinary = [bytes(r.word) for r in counted.where("n0 > 0").orderBy(F.desc("n0"), "word").limit(ORDINARY_WORDS).collect()]
    toxic = [bytes(r.word) for r in counted.where((F.col("n1") >= LEAST_DOCUMENTS) & (lift > LIFT)).orderBy(F.desc(F.col("n1") * F.log(lift)), "word").limit(TOXIC_WORDS).collect()]
    dictionaries = learn(ordinary, toxic)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def features(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([shared.value.counts(t) for t in part.column(0).to_pylist()], pa.list_(pa.int64()))], names=["toxic", "counts"])

    both = all(sizes.get((k, True)) for k in (0, 1))
    rows = texts.where("calibrates" if both else "true").select("text", "toxic").mapInArrow(features, "toxic int, counts array<long>").collect()
    rows.sort(key=lambda r: (r.toxic, r.counts))
    return dictionaries, calibrate(np.array([r.counts for r in rows], np.float64), np.array([r.toxic for r in rows]))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text); learned from ``labels`` (doc_id, toxic).

    Held-out documents are never learned from, nor null labels. Null text is empty text: it has no window and gets the score of a
    text without a toxic one. Whole texts are read, however long; every different word of a text counts once. Repeated rows stay
    repeated, rows without an id are scored like others, and further columns of both tables are ignored. Without labels of both classes every text gets the same score.
    """
    docs = id_and_text(docs)
    dictionaries, curve = fit(docs, labels, fit_rows)
    chosen = Dictionaries(dictionaries.ordinary, [dictionaries.toxic[curve.size]])
    shared = docs.sparkSession.sparkContext.broadcast((chosen, curve))

    def run(batches):
        chosen, curve = shared.value
        at = 1 + MARGINS.index(curve.margin)
        for part in slices(batches):
            n = np.array([chosen.counts(t) for t in part.column(1).to_pylist()], np.float64).reshape(part.num_rows, 1 + len(MARGINS))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve.probabilities(n[:, 0], n[:, at]))], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
