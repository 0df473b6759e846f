import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tx

DOCS = "doc_id long, text string, toxic int, lang string, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(rnd, n, share=0.2):
    """Random words; toxic texts hold a few of three fixed ones, or words with a stem that no ordinary word has."""
    rows, labels = [], []
    for i in range(n):
        bad = rnd.random() < share
        words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 80))]
        for _ in range(rnd.randint(2, 4) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Zounds!", "varlet", "knave,", "gromz" + rnd.choice(["ing", "er", "ed", "ish", "able"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad), "clash"))
    return rows, labels


def test_windows_are_whole_words():
    assert tx.windows("Ab, ab-cd É9\x00x_y " + "z" * 600) == {b"ab", b"cd", "é9".encode(), b"x", b"y", b"z" * 256, b"z" * 88}
    assert tx.windows("") == set() == tx.windows(" .,!")


def test_margins_are_the_bytes_saved_and_survive_pickling():
    d = tx.learn([f"ordinary{i}".encode() for i in range(300)], [b"abominable", b"wretch", b"scoundrel"])
    words = [b"abominable", b"scoundrels", b"ordinary7", b"unrelated"]
    got = d.margins(words)
    assert got[0, 0] >= 4 and got[1, 0] >= 3 and got[2, 0] <= 0 and got[3, 0] <= 1
    direct = [[len(a.compress(tx.CARRIER + w + b" ")) - len(b.compress(tx.CARRIER + w + b" "))
               for a, b in [(tx._compressor(d.ordinary + tx.CARRIER), tx._compressor(d.toxic[0] + d.ordinary + tx.CARRIER))]] for w in words]
    assert got[:, :1].tolist() == direct
    assert (pickle.loads(pickle.dumps(d)).margins(words) == got).all()
    assert d.counts("abominable abominable, wretch! other")[0] == 3 and d.counts("abominable wretch")[1] == 2 and d.counts("") == [0] * (1 + len(tx.TOXIC_BYTES) * len(tx.MARGINS))


def test_calibration_finds_the_informative_threshold():
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.2).astype(int)
    counts = rng.integers(0, 3, (600, 1 + len(tx.TOXIC_BYTES) * len(tx.MARGINS))).astype(float)
    counts[:, 0] = 50
    counts[:, 1 + 2 * len(tx.MARGINS) + 3] = y * rng.integers(1, 4, 600)
    curve = tx.calibrate(counts, y)
    assert (curve.size, curve.margin) == (2, tx.MARGINS[3])
    p = curve.probabilities(counts[:, 0], counts[:, 1 + 2 * len(tx.MARGINS) + 3])
    assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.1


def test_held_out_documents_and_edges(spark):
    rows, labels = corpus(random.Random(3), 900)
    extra = [(5000, None), (5001, ""), (None, "varlet knave gromzing zounds"), (7, rows[7][1]), (5002, "abcd " * 20000), (5003, "x" * 200_000)]
    labels += [(9000, 1, 1, ""), (None, 0, 1, ""), (3, 0, None, "")]
    df = spark.createDataFrame([(*r, 1, "en", "s") for r in rows + extra], DOCS)
    out = tx.score(df, spark.createDataFrame(labels, LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = {r.doc_id for r in df.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("doc_id").collect()}
    assert {r.doc_id for r in got if r.held_out} == held
    truth = {d: t for d, _, t, _ in labels if t is not None}
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(t for _, t in test) > 20 and np.mean([p == t for p, t in test]) > 0.97
    empty = {r.score for r in got if r.doc_id in (5000, 5001)}
    assert len(empty) == 1 and empty.pop() < 0.3 and next(r for r in got if r.doc_id is None).predicted == 1


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(random.Random(4), 200)
    df = spark.createDataFrame([(*r, 1, "en", "s") for r in rows], DOCS)
    lab = spark.createDataFrame(labels, LABELS)
    other = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(tx.score(df, lab).collect()) == sorted(tx.score(df, other).collect())


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", 1, "en", "s")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in tx.score(df, none).collect()] == [0.5]
    assert tx.score(spark.createDataFrame([], DOCS), none).collect() == []
    one = spark.createDataFrame([(1, 0, 1, ""), (2, 0, 1, "")], LABELS)
    assert all(r.score > 0.5 for r in tx.score(df, one).collect())
