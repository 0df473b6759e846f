import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import minhash as mh

DOCS = "doc_id long, text string, key string, tie int, n_chars string"


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signature_against_big_integers():
    hashes = mh.shingles("a b c d e f g h " * 3 + "x y z")
    a, b = [int(x) for x in mh._A], [int(x) for x in mh._B]
    low = [min(((p * int(h) + q) % 2**64) >> 32 for h in hashes) for p, q in zip(a, b)]
    want = [max(1, (v * 0x9E3779B97F4A7C15 % 2**64) >> 48) for v in low]
    assert mh.signature(hashes).tolist() == want
    assert not mh.signature(mh.shingles(" \n")).any() and len(set(a)) == mh.PERMUTATIONS


def test_signature_in_chunks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = mh.signature(mh.shingles(text))
    monkeypatch.setattr(mh, "_CHUNK", 100)
    assert (mh.signature(mh.shingles(text)) == whole).all()


def test_estimates_follow_jaccard():
    rnd = random.Random(1)
    errors = []
    for _ in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        other = words[: rnd.randint(1, 199)] + [f"v{i}" for i in range(60)]
        a, b = " ".join(words), " ".join(other)
        errors.append(mh.likeness(mh.signature(mh.shingles(a)), mh.signature(mh.shingles(b))) - jaccard(a, b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_against_brute_force(spark, partitions):
    rnd = random.Random(2)
    ids = [rnd.randrange(-(2**62), 2**62) for _ in range(60)] + [2**53 + 1, 2**53, 2**53 + 2, 0, 0, 0, None, None]
    rows = [(d, "".join(rnd.choice("ab é日 ") for _ in range(rnd.choice([0, 1, 5, 200])))) for d in ids] + [(77, None), (78, "word " * 3000)]
    df = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], DOCS).repartition(partitions)
    out = mh.fingerprints(df).collect()
    from pyspark.sql import functions as F

    tie = {r.text: r.tie for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        s = [mh.signature(mh.shingles(x)) for x in (t, e, n)]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), mh.text_of(s[0]), mh.text_of(s[1]), mh.likeness(s[0], s[1]), mh.likeness(s[0], s[2])))
    assert {r.class_id for r in out if r.doc_id is None} == {None} and all(r.class_id <= r.doc_id for r in out if r.doc_id is not None)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:7] for r in out), key=key) == sorted(want, key=key)


def test_one_and_no_rows(spark):
    one = mh.fingerprints(spark.createDataFrame([(1, "abcd", "k", 1, "n")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert mh.fingerprints(spark.createDataFrame([], DOCS)).collect() == []


def test_classes_against_brute_force(spark):
    rnd = random.Random(7)
    rows, d = [], 0
    for _ in range(50):
        base = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(rnd.randint(40, 150))]
        for k in range(rnd.choice([1, 2, 5])):
            words = list(base)
            for _ in range(k and rnd.choice([0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
            rows.append((d := d + 3, " ".join(words)))
    df = spark.createDataFrame([(*r, "k", 1, "n") for r in [*rows, (900, None), (901, ""), (None, rows[0][1])]], DOCS).repartition(3)
    group = {d: d for d, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, t) in enumerate(rows):
        for b, u in rows[:i]:
            if jaccard(t, u) >= 0.8:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in mh.near_duplicate_links(df).collect()}
    want = {d: find(d) for d, _ in rows if find(d) != d} | {901: 900}
    assert got == want and len(want) > 20
    out = {r.doc_id: r.class_id for r in mh.fingerprints(df).collect() if r.doc_id is not None}
    assert out == {d: want.get(d, d) for d, _ in rows} | {900: 900, 901: 900}


def test_first_and_previous():
    import pyarrow as pa

    from tidemark.llm.common import first_and_previous

    rng = np.random.default_rng(2)
    key, rep = np.sort(rng.integers(-20, 20, 200)), np.arange(200)

    def run(size):
        parts = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(rep[i : i + size])], names=["key", "rep"]) for i in range(0, 200, size)]
        return {(u, v) for x in first_and_previous(parts) for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}

    want = set()
    for k in set(key.tolist()):
        mine = rep[key == k].tolist()
        want |= {(a, b) for i, a in enumerate(mine) if i for b in (mine[0], mine[i - 1])}
    assert run(200) == run(9) == run(1) == want
