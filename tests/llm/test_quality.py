import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality as ql

DOCS = "doc_id long, text string, quality int, lang string, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def contexts_by_hand(texts):
    index = ql.index_vectors().astype(int)
    totals, counts = np.zeros((ql.BUCKETS, ql.DIMENSIONS), int), np.zeros(ql.BUCKETS, int)
    for t in texts:
        ids = ql.buckets(t or "").tolist()
        for i, b in enumerate(ids):
            counts[b] += 1
            for j in range(max(0, i - ql.WINDOW), min(len(ids), i + ql.WINDOW + 1)):
                if j != i:
                    totals[b] += index[ids[j]]
    return totals, counts


def test_context_table_against_loops(spark, monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("alpha beta, gamma! x1 (y)".split()) for _ in range(rnd.randint(0, 40))) for _ in range(30)] + [None, "", "one"]
    want = contexts_by_hand(texts)
    got = ql.context_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    monkeypatch.setattr(ql, "_CHUNK", 7)
    totals, counts = np.zeros((ql.BUCKETS + 1, ql.DIMENSIONS), int), np.zeros(ql.BUCKETS + 1, int)
    gap = np.full(ql.WINDOW, ql.BUCKETS)
    ql.add_contexts(np.concatenate([x for t in texts if t for x in (ql.buckets(t), gap)]), ql.index_vectors(), totals, counts)
    assert (totals[:-1] == want[0]).all() and (counts[:-1] == want[1]).all()


def test_gradient_by_training_a_separable_case():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # not linear
    net = ql.train(x, y)
    assert ((net.probabilities(x) > 0.5) == y).mean() > 0.9 and 0.2 <= net.temperature <= 20


def corpus(rnd, n):
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(rnd.randint(5, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w + rnd.choice(["%%", "$$"]) for w in words)))
        labels.append((i, int(good), 0, "clash"))
    return rows, labels


def test_held_out_scores_and_edges(spark):
    rnd = random.Random(3)
    rows, labels = corpus(rnd, 400)
    rows += [(1000, None), (1001, ""), (None, "ab cd"), (7, rows[7][1]), (1002, "abcd " * 20000)]
    labels += [(5000, 1, 0, ""), (None, 0, 0, ""), (3, None, 0, "")]
    df = spark.createDataFrame([(*r, 9, "en", "s") for r in rows], DOCS)
    out = ql.score(df, spark.createDataFrame(labels, LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {d: q for d, q, _, _ in labels if d is not None and q is not None}
    held = {r.doc_id for r in df.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("doc_id").collect()}
    assert {r.doc_id for r in got if r.held_out} == held
    test = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, t in test if t], [s for s, t in test if not t]
    assert len(bad) > 5 and min(good) > max(bad)
    same = [r.score for r in got if r.doc_id in (1000, 1001)]
    assert same[0] == same[1]


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(random.Random(4), 150)
    df = spark.createDataFrame([(*r, 1, "en", "s") for r in rows], DOCS)
    lab = spark.createDataFrame(labels, LABELS)
    other = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(ql.score(df, lab).collect()) == sorted(ql.score(df, other).collect())


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", 1, "en", "s")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in ql.score(df, none).collect()] == [0.5]
    assert ql.score(spark.createDataFrame([], DOCS), none).collect() == []
    one = spark.createDataFrame([(1, 1, 0, ""), (2, 1, 0, "")], LABELS)
    assert all(r.score > 0.5 for r in ql.score(df, one).collect())
