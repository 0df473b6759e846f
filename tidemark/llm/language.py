"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (lengths 1 to 3, presence only, lower-cased letters with every other
run of characters read as one blank) that both have, normalised by the geometric mean of their own counts. A Nystroem map
on a few landmark texts of each language turns it into features, and one ridge regression per language scores them. Since the
kernel is linear in the presence vector, landmarks and weights fold into one matrix: a batch of texts is scored by the product
of its presence matrix with that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, small_batches

UNDETERMINED = "und"
#: Bounds of the labelled sample, per language: rows for the regression, and how many of them are landmarks.
FIT_ROWS = 1024
LANDMARKS = 64
RIDGE = 1e-3
_SALTS = 16
_BATCH = 64


@cache
def _letters() -> np.ndarray:
    table = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-gram codes of a text; empty if it has no letter."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]] if len(points) else points
    if not len(points) or (points == 32).all():
        return np.zeros(0, np.int64)
    c = np.r_[32, points, 32]
    two = c[:-1] << 21 | c[1:]
    return np.unique(np.concatenate([points, two, two[:-1] << 21 | c[2:]]))


@dataclass
class Presence:
    """Presence of the n-grams of a fixed vocabulary."""

    vocabulary: np.ndarray

    def matrix(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, g in enumerate(sets):
            at = np.searchsorted(self.vocabulary, g)
            at[at == len(self.vocabulary)] = 0
            out[i, at[self.vocabulary[at] == g]] = 1
        return out


@dataclass
class Model:
    languages: list[str]
    presence: Presence
    weights: np.ndarray  # n-grams x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score per text; the score is the winning regression's output, mapped from [-1, 1] to [0, 1]."""
        names, scores = [], []
        for start in range(0, len(texts), _BATCH):
            sets = [grams(t or "") for t in texts[start : start + _BATCH]]
            sizes = np.array([max(1, len(g)) for g in sets], np.float64)
            out = (self.presence.matrix(sets) @ self.weights) / np.sqrt(sizes)[:, None]
            for g, row in zip(sets, out):
                known = len(g) > 0 and len(self.languages) > 0
                k = int(row.argmax()) if known else -1
                names.append(self.languages[k] if known else UNDETERMINED)
                scores.append(float(min(1.0, max(0.0, (row[k] + 1) / 2))) if known else 0.0)
        return names, scores


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model:
    """A model from the rows (text, lang) with a language and at least one letter.

    At most ``fit_rows`` different texts per language, the ones with the smallest hashes, are used; the first ``landmarks`` of them
    are landmarks. The kernel rows of the sample are computed by Spark; the driver gets ``fit_rows x landmarks`` numbers per language.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    per_salt = -(-fit_rows // _SALTS)
    order = Window.partitionBy("lang", F.pmod("h", F.lit(_SALTS))).orderBy("h")
    picked = rows.select("lang", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_salt)
    picked = {(r.lang, r.h): (r["rank"], r.h) for r in picked.collect()}
    if not picked:
        return Model([], Presence(np.zeros(1, np.int64)), np.zeros((1, 0), np.float32))
    languages = sorted({lang for lang, _ in picked})
    chosen = set()
    for lang in languages:
        chosen.update(sorted((k for k in picked if k[0] == lang), key=picked.get)[:landmarks])
    wanted = spark.sparkContext.broadcast(set(picked))

    def sample(batches, only):
        for part in slices(batches):
            mask = [x in only for x in zip(part.column(0).to_pylist(), part.column(2).to_pylist())]
            yield part.filter(pa.array(mask, pa.bool_()))

    def landmark_grams(batches):
        for part in sample(batches, chosen):
            sets = [grams(t).tolist() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, pa.list_(pa.int64()))], names=["lang", "h", "g"])

    marks = rows.mapInArrow(landmark_grams, "lang string, h long, g array<long>").dropDuplicates(["lang", "h"]).where(F.size("g") > 0).collect()
    marks = [np.array(r.g, np.int64) for r in sorted(marks, key=lambda r: (r.lang, r.h))]
    if not marks:
        return Model([], Presence(np.zeros(1, np.int64)), np.zeros((1, 0), np.float32))
    presence = Presence(np.unique(np.concatenate(marks)))
    base = presence.matrix(marks) / np.sqrt([len(g) for g in marks])[:, None].astype(np.float32)
    shared = spark.sparkContext.broadcast((presence, base))

    def kernel_rows(batches):
        presence, base = shared.value
        for part in sample(batches, wanted.value):
            for small in slices([part], _BATCH):
                sets = [grams(t) for t in small.column(1).to_pylist()]
                k = (presence.matrix(sets) @ base.T) / np.sqrt([max(1, len(g)) for g in sets])[:, None]
                k = [x.astype(np.float32).tolist() if len(g) else None for x, g in zip(k, sets)]
                yield pa.RecordBatch.from_arrays([small.column(0), small.column(2), pa.array(k, pa.list_(pa.float32()))], names=["lang", "h", "k"])

    got = rows.mapInArrow(kernel_rows, "lang string, h long, k array<float>").dropDuplicates(["lang", "h"]).where("k is not null").collect()
    got.sort(key=lambda r: (r.lang, r.h))
    kernel = np.array([r.k for r in got], np.float64)
    languages = sorted({r.lang for r in got})
    target = np.where(np.array([r.lang for r in got])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    values, vectors = np.linalg.eigh(base.astype(np.float64) @ base.T.astype(np.float64))
    half = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = kernel @ half
    # every language weighs the same, however many rows it has
    weight = np.array([1 / sum(r.lang == x for r in got) for x in languages])[[languages.index(r.lang) for r in got]]
    gram = features.T @ (features * weight[:, None]) + RIDGE * np.eye(len(half))
    beta = np.linalg.solve(gram, features.T @ (target * weight[:, None]))
    return Model(languages, presence, (base.T.astype(np.float64) @ (half @ beta)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score as two more columns.

    A null text, a text without a letter, or a model without languages gives ``und`` with score 0. Repeated rows stay repeated.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for part in slices(batches):
            names, scores = shared.value.predict(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_col, score_col])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the labelled documents that are not held out."""
    labelled = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("text", "lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, fit(labelled)).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
