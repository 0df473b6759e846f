import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language as lg

DOCS = "doc_id long, text string, lang string, lang_pred int, score string"
WORDS = {"aa": "kato mira sulo venta", "bb": "grøt frysh lønk", "cc": "chaque élan voilà très"}


def make(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


def test_grams_by_hand():
    def by_hand(text):
        s = "".join(c if c.isalpha() else " " for c in text.lower())
        s = " ".join(s.split()) if s.strip() else ""
        if not s:
            return 0
        points = set(s) | ({" "} if not text[0].isalpha() or not text[-1].isalpha() else set())
        pad = f" {s} "
        return len(points) + len({pad[i : i + 2] for i in range(len(pad) - 1)}) + len({pad[i : i + 3] for i in range(len(pad) - 2)})

    for t in ("abc", "a", "Hello, World", "été 12 là"):
        assert len(lg.grams(t)) == by_hand(t)
    assert len(lg.grams("")) == len(lg.grams("12 %% \n")) == 0
    assert (lg.grams("ABC") == lg.grams("abc")).all()


def test_folded_scores_equal_kernel_scores(spark):
    """W = M'K^(-1/2)b gives what the kernel expansion over landmarks gives."""
    rnd = random.Random(1)
    rows = [(make(rnd, x, 20), x) for x in WORDS for _ in range(30)]
    model = lg.fit(spark.createDataFrame(rows, "text string, lang string"), fit_rows=64, landmarks=8)
    texts = [make(rnd, x, 15) for x in WORDS]
    sets = [lg.grams(t) for t in texts]
    shared = [[len(np.intersect1d(s, [g])) for g in model.presence.vocabulary] for s in sets]
    want = np.array(shared) @ model.weights / np.sqrt([len(s) for s in sets])[:, None]
    names, scores = model.predict(texts)
    assert names == list(WORDS)
    assert np.allclose(scores, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    rnd = random.Random(2)
    rows = [(i, make(rnd, x := rnd.choice(list(WORDS)), rnd.choice([1, 3, 40])), x) for i in range(300)]
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (None, make(rnd, "bb", 9), "bb"), (1003, make(rnd, "cc", 3000), None), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows + extra], DOCS)
    got = lg.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows) + len(extra)
    truth = dict((r[0], r[2]) for r in rows)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    want = {r[0] for r in df.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).select("doc_id").collect()}
    assert {r.doc_id for r in out if r.held_out} == want and len(held) > 50
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) == len(held)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "cc" and by[None].lang_pred == "bb" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in out)


def test_predictions_ignore_labels_of_held_out_rows(spark):
    rnd = random.Random(3)
    rows = [(i, make(rnd, x := rnd.choice(list(WORDS)), 30), x) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spoiled = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(lg.identify(df).collect()) == sorted(lg.identify(spoiled).collect())


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None, 1, "s")], DOCS)
    assert [(r.lang_pred, r.score) for r in lg.identify(df).collect()] == [("und", 0.0)]
    assert lg.identify(spark.createDataFrame([], DOCS)).collect() == []
    junk = spark.createDataFrame([(2, "12", "aa", 1, "s"), (3, "words here", None, 1, "s")], DOCS)
    assert {r.lang_pred for r in lg.identify(junk).collect()} == {"und"}
